"""Exact deduplication with Patricia tries over whole byte strings.

Every map task inserts its texts into a compressed radix trie whose terminal nodes
hold the owner so far, so that a text leaves a task once however often it occurs in
it.  Partitions by (length, content hash) then insert those texts into tries of their
own.  A trie that outgrows its budget spills its heaviest subtrees: a map task sends
them on as they are, an owner writes them for another round over finer partitions.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.shared import ascii_lower, partitions, settle, stage

#: Bytes of a batch that goes back to Spark.
OUT_BYTES = 8 << 20
#: What a node and a remembered row cost beside their bytes, roughly.
NODE_BYTES, ROW_BYTES = 300, 40


class Node:
    """``edge`` leads to the node; ``value`` is set where a text ends; a stub has been spilled."""

    __slots__ = ("edge", "children", "value", "stub")

    def __init__(self, edge: bytes):
        self.edge, self.children, self.value, self.stub = edge, {}, None, False


class Trie:
    """A compressed radix trie from byte strings to mutable values."""

    def __init__(self):
        self.root = Node(b"")
        self.held = 0

    def find(self, key: bytes) -> Node:
        """The node at which ``key`` ends, made if need be; or the stub that lies on its way."""
        node, at, end = self.root, 0, len(key)
        while at < end and not node.stub:
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.held += len(child.edge) + NODE_BYTES
                return child
            edge = child.edge
            if key.startswith(edge, at):
                node, at = child, at + len(edge)
                continue
            same, most = 1, min(len(edge), end - at)  # the first byte is the same
            while same < most:
                middle = (same + most + 1) // 2
                if key.startswith(edge[:middle], at):
                    same = middle
                else:
                    most = middle - 1
            fork = Node(edge[:same])
            child.edge = edge[same:]
            fork.children[child.edge[0]] = child
            node.children[key[at]] = fork
            self.held += NODE_BYTES
            node, at = fork, at + same
        return node

    @staticmethod
    def walk(node: Node, prefix: bytes) -> Iterator[tuple[bytes, Node]]:
        """Nodes at or below ``node`` with the whole string that leads to each."""
        todo = [(node, prefix)]
        while todo:
            node, prefix = todo.pop()
            yield prefix, node
            todo += [(child, prefix + child.edge) for child in node.children.values()]

    def spill(self, target: int, keep: Node | None = None) -> Iterator[tuple[bytes, list]]:
        """Take out heavy subtrees until ``target`` bytes are left; yields (text, value).

        With ``keep`` the subtrees' places stay behind as stubs, and that node with the
        way to it is left alone.
        """
        nodes, above = [self.root], {}
        for node in nodes:  # grows while it is read: parents before children
            for child in node.children.values():
                above[id(child)] = node
                nodes.append(child)
        weight: dict[int, int] = {}
        for node in reversed(nodes):
            own = NODE_BYTES + len(node.edge) + (ROW_BYTES * node.value[2] if node.value else 0)
            weight[id(node)] = own + sum(weight[id(c)] for c in node.children.values())
        self.held = weight[id(self.root)]
        spine = {id(self.root)}
        while keep is not None and keep is not self.root:
            spine.add(id(keep))
            keep = above[id(keep)]
        stubs = keep is not None
        heap = [(-weight[id(c)], id(c), c, c.edge) for c in self.root.children.values()]
        heapq.heapify(heap)
        while heap and self.held > target:
            _, _, node, prefix = heapq.heappop(heap)
            much = weight[id(node)] > 2 * (self.held - target)
            if id(node) in spine or (much and node.children):
                for c in node.children.values():
                    heapq.heappush(heap, (-weight[id(c)], id(c), c, prefix + c.edge))
                continue
            for text, below in self.walk(node, prefix):
                if below.value is not None:
                    yield text, below.value
            self.held -= weight[id(node)]
            if stubs:
                node.children, node.value, node.stub = {}, None, True
            else:
                del above[id(node)].children[node.edge[0]]

    def entries(self) -> Iterator[tuple[bytes, list]]:
        for text, node in self.walk(self.root, b""):
            if node.value is not None:
                yield text, node.value


# A value is [owner id, owner's entry, rows, ids or None, this entry].


def _better(smallest: bool, a: tuple, b: tuple) -> bool:
    """(id, entry) ``a`` goes before ``b``: ids first, a null id last, then the smaller entry."""
    if a[0] is None or b[0] is None:
        return (a[0] is not None, -a[1]) > (b[0] is not None, -b[1])
    if a[0] != b[0]:
        return a[0] < b[0] if smallest else a[0] > b[0]
    return a[1] < b[1]


def _batches(rows: Iterator[tuple[int, tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for weight, row in rows:
        out.append(row)
        size += weight
        if size > OUT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


ENTRY = pa.schema([
    ("n_bytes", pa.int64()), ("sha", pa.binary()), ("text", pa.binary()), ("entry", pa.int64()),
    ("owner", pa.int64()), ("owner_entry", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.int64())),
])
ENTRY_DDL = "n_bytes long, sha binary, text binary, entry long, owner long, owner_entry long, n long, ids array<long>"
OWNED = pa.schema([
    ("n_bytes", pa.int64()), ("sha", pa.binary()), ("text", pa.binary()),
    ("owner", pa.int64()), ("owner_entry", pa.int64()), ("n", pa.int64()), ("final", pa.bool_()),
])
OWNED_DDL = "n_bytes long, sha binary, text binary, owner long, owner_entry long, n long, final boolean"


def _combine(smallest: bool, budget: int):
    """Map side: (id, text) rows to one entry for each text that the trie held at a time."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        trie, count = Trie(), TaskContext.get().partitionId() << 40

        def entry(text: bytes, value: list) -> tuple[int, tuple]:
            owner, own_entry, n, ids, number = value
            sha = hashlib.sha256(text).digest()
            return len(text) + 8 * n + 100, (len(text), sha, text, number, owner, own_entry, n, ids)

        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                node = trie.find(text)
                if node.value is None:
                    count += 1
                    node.value = [row, count, 1, [row], count]
                else:
                    value = node.value
                    if _better(smallest, (row, value[4]), (value[0], value[1])):
                        value[0] = row
                    value[2] += 1
                    value[3].append(row)
                trie.held += ROW_BYTES
                if trie.held > budget:
                    for pair in trie.spill(budget // 2):
                        yield entry(*pair)
                    if trie.root.value is not None:  # the empty text ends at the root
                        yield entry(b"", trie.root.value)
                        trie.root.value = None
        for pair in trie.entries():
            yield entry(*pair)

    return lambda batches: _batches(rows(batches), ENTRY)


def _own(smallest: bool, budget: int):
    """Owner side: entries to owners; what does not fit is passed on, not final."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        trie, first = Trie(), None

        def owned(text: bytes, value: list, final: bool) -> tuple[int, tuple]:
            sha = hashlib.sha256(text).digest()
            return len(text) + 100, (len(text), sha, None if final else text, *value[:3], final)

        for batch in batches:
            for text, owner, entry, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
                node = trie.find(text)
                if node.stub:
                    yield owned(text, [owner, entry, n], False)
                    continue
                if node.value is None:
                    node.value = [owner, entry, 0]
                    first = first or node
                value = node.value
                if _better(smallest, (owner, entry), (value[0], value[1])):
                    value[:2] = [owner, entry]
                value[2] += n
                if trie.held > budget:
                    for pair in trie.spill(budget // 2, first):
                        yield owned(*pair, False)
        for pair in trie.entries():
            yield owned(*pair, True)

    return lambda batches: _batches(rows(batches), OWNED)


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    task_bytes: int = 128 << 20,
) -> DataFrame:
    """Groups of documents whose texts are equal but for the case of A-Z.

    One row per document, dropped ones too: the id column, ``keep_id`` (the id of the
    row that stays: the smallest, or the largest with ``keep='largest'``),
    ``group_size``, ``kept``, ``text_sha256`` (of the lower-cased text in UTF-8).
    ``task_bytes`` bounds a trie; beyond it subtrees spill.

    A null text counts as empty.  A null id never stays while its group has another
    id; a group of null ids keeps one of its rows.  Of rows that share the kept id one
    stays.  An empty table gives an empty result; other columns are not looked at.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"unknown keep: {keep}")
    smallest = keep == "smallest"
    spark = settle(docs.sparkSession)
    pairs = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        ascii_lower(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).cast("binary").alias("text"),
    )
    entries = stage(pairs.mapInArrow(_combine(smallest, task_bytes), ENTRY_DDL))
    owners = None
    todo = entries.select("n_bytes", "sha", "text", "owner", F.col("owner_entry").alias("entry"), "n")
    dealt = todo.repartition("n_bytes", "sha")
    parts = partitions(spark)
    while True:
        part = stage(
            dealt.select("text", "owner", "entry", "n").mapInArrow(_own(smallest, task_bytes), OWNED_DDL)
        )
        done = part.where("final").select("sha", "owner", "owner_entry", F.col("n").alias("size"))
        owners = done if owners is None else owners.unionByName(done)
        rest = part.where("not final")
        if rest.isEmpty():
            break
        parts *= 4  # finer parts, so that less meets in one
        dealt = rest.select("text", "owner", F.col("owner_entry").alias("entry"), "n", "n_bytes", "sha").repartition(
            parts, "n_bytes", "sha"
        )
    spread = entries.select("sha", "entry", "ids").join(owners, "sha")
    return spread.select(
        F.posexplode("ids").alias("pos", id_col),
        F.col("owner").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("entry") == F.col("owner_entry")).alias("_owns"),
        F.coalesce(F.array_position("ids", F.col("owner")), F.lit(1)).alias("_first"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    ).select(
        id_col, "keep_id", "group_size",
        (F.col("_owns") & (F.col("pos") + 1 == F.col("_first"))).alias("kept"),
        "text_sha256",
    )
