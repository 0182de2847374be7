"""Repair of conversations by the cheapest edits, with an audit of them.

A dynamic program runs over a conversation's rows and the four places that a repaired
conversation can be at.  Every cell keeps its cost and the node of a tree of edits: audits
share their beginnings, a node knows its ancestors at distances of powers of two and a
rolling hash of its letters.  Audits of equal cost are compared by a search for their
longest common beginning, which is then verified letter by letter.

Long conversations are cut into chunks.  A chunk is solved for every place it may begin
at; a chunk's audits are free of prefixes (each has as many letters that use up a row, and
ends with one), so the order of two audits is settled in the first chunk where they differ,
and chunks are put together from costs and ranks alone.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.shared import WHITE, settle, stage

#: Places: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = "sua"
#: What a row needs: nothing, or a deletion (blank, duplicate), or more care (truncated).
FAULTS = ("sound", "blank", "duplicate", "truncated")
DELETE, INSERT, REROLE, CUT = 2, 5, 1, 5
#: Cost and letters that end a conversation at each place.
ENDS = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))
AFTER = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
LEGAL = {"su", "ua", "au"}


def code_of(initial: str, fault: int) -> str:
    """One letter for the initial of a row's role and its fault."""
    return chr(65 + 4 * (INITIALS.find(initial) % 4 if initial else 3) + fault)


def _initial(code: str) -> str:
    return "suao"[(ord(code) - 65) // 4]


def _fault(code: str) -> int:
    return (ord(code) - 65) % 4


@functools.cache
def _moves(code: str) -> list[list[tuple[int, int, str]]]:
    """For each place, the cheapest way over a row to each next place: (next, cost, letters)."""
    initial, fault = _initial(code), _fault(code)
    forced, extra = fault in (1, 2), CUT if fault == 3 else 0
    out = []
    for place in range(4):
        best: dict[int, tuple[int, str]] = {}
        at = place
        for inserted in range(4):
            ways = [(at, DELETE, "D")]
            if not forced:
                if initial == "s" and at == START:
                    ways.append((SYSTEM, extra, "K"))
                if initial in "ua":
                    lands = USER if initial == "u" else ASSISTANT
                    if AFTER[at] == lands:
                        ways.append((lands, extra, "K"))
                ways.append((AFTER[at], REROLE + extra, "R"))
            for lands, cost, letter in ways:
                way = (cost + INSERT * inserted, "I" * inserted + letter)
                if lands not in best or way < best[lands]:
                    best[lands] = way
            at = AFTER[at]
        out.append([(lands, cost, letters) for lands, (cost, letters) in best.items()])
    return out


class EditTree:
    """Audits as paths from a root, with binary-lifting ancestors and rolling hashes."""

    BASE, MODULUS = 1_000_003, (1 << 61) - 1

    def __init__(self, modulus: int = MODULUS):
        self.modulus = modulus
        self.parent, self.letter, self.depth, self.hash = [0], [""], [0], [0]
        self.up: list[list[int]] = [[]]

    def grow(self, node: int, letters: str) -> int:
        for letter in letters:
            new = len(self.parent)
            self.parent.append(node)
            self.letter.append(letter)
            self.depth.append(self.depth[node] + 1)
            self.hash.append((self.hash[node] * self.BASE + ord(letter)) % self.modulus)
            up, at, k = [node], node, 0
            while len(self.up[at]) > k:
                at = self.up[at][k]
                up.append(at)
                k += 1
            self.up.append(up)
            node = new
        return node

    def path(self, node: int) -> str:
        letters = []
        while node:
            letters.append(self.letter[node])
            node = self.parent[node]
        return "".join(reversed(letters))

    def ancestor(self, node: int, depth: int) -> int:
        lift = self.depth[node] - depth
        while lift:
            step = lift.bit_length() - 1
            node = self.up[node][step]
            lift -= 1 << step
        return node

    def _same(self, a: int, b: int) -> bool:
        """Whether two paths of equal hash are equal, down to the node that they share."""
        while a != b:
            if self.letter[a] != self.letter[b]:
                return False
            a, b = self.parent[a], self.parent[b]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether the audit of ``a`` comes before that of ``b`` in ASCII order."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, depth), self.ancestor(b, depth)
        if self.hash[x] == self.hash[y]:
            if not self._same(x, y):
                return self.path(a) < self.path(b)
            return self.depth[a] < self.depth[b]
        for k in range(len(self.up[x]) - 1, -1, -1):
            if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                x, y = self.up[x][k], self.up[y][k]
        if not self._same(self.parent[x], self.parent[y]):
            return self.path(a) < self.path(b)
        return self.letter[x] < self.letter[y]


def solve(codes: str, entry: int, tree: EditTree | None = None) -> tuple[EditTree, list[tuple[int, int] | None]]:
    """The cheapest audit, ties ASCII-least, from a place over the rows to each place: (cost, node)."""
    tree = tree or EditTree()
    cells: list[tuple[int, int] | None] = [None] * 4
    cells[entry] = (0, 0)
    for code in codes:
        moves = _moves(code)
        new: list[tuple[int, int, str] | None] = [None] * 4
        for place, cell in enumerate(cells):
            if cell is None:
                continue
            for lands, cost, letters in moves[place]:
                total, held = cell[0] + cost, new[lands]
                if held is None or total < held[0] or (total == held[0] and tree.less(cell[1], held[1])):
                    new[lands] = (total, cell[1], letters)
        cells = [None if c is None else (c[0], tree.grow(c[1], c[2])) for c in new]
    return tree, cells


def _ordered(tree: EditTree, nodes: list[int]) -> list[int]:
    return sorted(nodes, key=functools.cmp_to_key(lambda a, b: 0 if a == b else -1 if tree.less(a, b) else 1))


@functools.lru_cache(maxsize=1 << 15)
def audit(codes: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    tree, cells = solve(codes, START)
    ends = [(cell[0] + ENDS[place][0], cell[1], ENDS[place][1]) for place, cell in enumerate(cells) if cell]
    least = min(e[0] for e in ends)
    first = _ordered(tree, [node for cost, node, _ in ends if cost == least])[0]
    tail = next(tail for cost, node, tail in ends if cost == least and node == first)
    return least, tree.path(first) + tail


def transfer(codes: str, entries: list[int]) -> tuple[list[int], list[int], list[str]]:
    """Costs (-1: no way), ranks and audits of a chunk, at ``4 * entry + exit``."""
    costs, ranks, audits = [-1] * 16, [0] * 16, [""] * 16
    for entry in entries:
        tree, cells = solve(codes, entry)
        order = _ordered(tree, [cell[1] for cell in cells if cell])
        for place, cell in enumerate(cells):
            if cell:
                at = 4 * entry + place
                costs[at], ranks[at], audits[at] = cell[0], order.index(cell[1]), tree.path(cell[1])
    return costs, ranks, audits


def join_chunks(chunks: list[tuple[list[int], list[int]]]) -> tuple[int, list[int], str]:
    """Cost, each chunk's ``4 * entry + exit`` and the letters at the end, from costs and ranks."""
    cost: list[int | None] = [0, None, None, None]
    rank, back = [0] * 4, []
    for costs, ranks in chunks:
        best: list[tuple[int, int, int] | None] = [None] * 4
        for out in range(4):
            ways = [
                (cost[p] + costs[4 * p + out], rank[p], p) for p in range(4) if cost[p] is not None and costs[4 * p + out] >= 0
            ]
            best[out] = min(ways) if ways else None
        open_places = [q for q in range(4) if best[q]]
        open_places.sort(key=lambda q: (best[q][1], ranks[4 * best[q][2] + q]))
        cost = [b[0] if b else None for b in best]
        rank = [open_places.index(q) if best[q] else 0 for q in range(4)]
        back.append([b[2] if b else -1 for b in best])
    total, _, place = min((cost[q] + ENDS[q][0], rank[q], q) for q in range(4) if cost[q] is not None)
    tail, picks = ENDS[place][1], []
    for came in reversed(back):
        picks.append(4 * came[place] + place)
        place = came[place]
    return total, picks[::-1], tail


def replay(codes: str, entry: int, letters: str) -> Iterator[tuple[str, int, str | None]]:
    """The rows that stay: (edit, which of the rows that may stay or -1, role or None for its own)."""
    place, row, free = entry, 0, 0
    for letter in letters:
        if letter == "I":
            place = AFTER[place]
            yield "I", -1, "user" if place == USER else "assistant"
            continue
        code = codes[row]
        row += 1
        if _fault(code) in (1, 2):
            continue
        free += 1
        if letter == "K":
            place = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[_initial(code)]
            yield "K", free - 1, None
        elif letter == "R":
            place = AFTER[place]
            yield "R", free - 1, "user" if place == USER else "assistant"


# ------------------------------------------------------------------ on Spark

FACTS = ["rows", "blank", "duplicate", "truncated", "illegal", "turns"]


class _Chunk:
    """Rows of one conversation that follow each other in a partition."""

    def __init__(self, conv, starts: bool):
        self.conv, self.starts = conv, starts
        self.codes: list[str] = []
        self.keys: list[bytes] = []
        self.low = self.high = None
        self.turns = 0

    def add(self, turn, code: str, key: bytes) -> None:
        self.codes.append(code)
        if _fault(code) in (0, 3):
            self.keys.append(key)
        if turn is not None:
            self.turns += turn != self.high or self.low is None
            self.low, self.high = turn if self.low is None else self.low, turn

    def row(self, part: int, ended: bool) -> tuple:
        codes = "".join(self.codes)
        whole = self.starts and ended
        if whole:
            cost, letters = audit(codes)
            costs, ranks, audits = [cost], [0], [letters]
        else:
            costs, ranks, audits = transfer(codes, [START] if self.starts else list(range(4)))
        initials = "".join(map(_initial, codes))
        faults = [_fault(c) for c in codes]
        illegal = sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1))
        return (
            self.conv, part, whole, len(codes), *[faults.count(k) for k in (1, 2, 3)], illegal, self.turns,
            self.low, self.high, initials[:1], initials[-1:], costs, ranks, audits, codes, self.keys,
        )


def _chunked(limit: int, schema: pa.Schema):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        part = TaskContext.get().partitionId() << 33
        held: _Chunk | None = None
        made = 0
        for batch in batches:
            for conv, turn, n, code, again, key in zip(*(c.to_pylist() for c in batch.columns)):
                if held is None or conv != held.conv:
                    if held is not None:
                        yield held.row(part + made, True)
                        made += 1
                    held = _Chunk(conv, held is not None)
                for copy in range(n):
                    if len(held.codes) >= limit:
                        yield held.row(part + made, False)
                        made += 1
                        held = _Chunk(conv, False)
                    held.add(turn, again if copy else code, key)
        if held is not None:  # the next partition may go on with it
            yield held.row(part + made, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for row in rows(batches):
            out.append(row)
            if len(out) >= 1024 or row[3] >= limit:
                yield _record(out, schema)
                out = []
        if out:
            yield _record(out, schema)

    return run


def _record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _resolved(schema: pa.Schema):
    """Chunks of a conversation in order to the way through each; facts with the last of them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        group: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and group[0][0] != row[0]:
                    yield from done(group)
                    group = []
                group.append(row)
        if group:
            yield from done(group)

    def done(group: list[tuple]) -> Iterator[tuple]:
        cost, picks, tail = join_chunks([(r[-2], r[-1]) for r in group])
        sums = [sum(r[2 + i] for r in group) for i in range(len(FACTS))]
        low = high = last = None
        for r in group:
            first_turn, last_turn, first_initial, last_initial = r[8:12]
            if last and first_initial and last + first_initial not in LEGAL:
                sums[4] += 1
            last = last_initial or last
            if first_turn is not None:
                sums[5] -= first_turn == high
                low, high = first_turn if low is None else low, last_turn
        for i, (r, pick) in enumerate(zip(group, picks)):
            ends = i == len(group) - 1
            facts = [*sums, low, high, cost] if ends else [None] * 9
            yield (r[0], r[1], pick, tail if ends else "", ends, *facts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for row in rows(batches):
            out.append(row)
            if len(out) >= 4096:
                yield _record(out, schema)
                out = []
        if out:
            yield _record(out, schema)

    return run


def _replayed(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, part, codes, keys, entry, letters in zip(*(c.to_pylist() for c in batch.columns)):
                for place, (edit, which, role) in enumerate(replay(codes, entry, letters)):
                    out.append((conv, part, place, edit, role, None if which < 0 else keys[which]))
            yield _record(out, schema) if out else pa.RecordBatch.from_pylist([], schema=schema)

    return run


@dataclass(frozen=True)
class Repair:
    """``conversations``: a row for each, with its faults, cost and audit.  ``turns``: the
    repaired rows (conversation, ``part`` and ``place`` that order them, role, text, edit)."""

    conversations: DataFrame
    turns: DataFrame


def repair_conversations(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    copies_col: str | None = None,
    chunk_rows: int = 4096,
) -> Repair:
    """Turn every conversation into ``(system? (user assistant)+)?`` at least cost.

    A row's first fault counts: blank (nothing but ASCII white space), duplicate (role and
    text of an earlier row), truncated (its last visible character is none of ``.!?``).
    Edits: keep (K, 0), change the role to user or assistant (R, 1), delete (D, 2; blank and
    duplicate rows must go), insert an empty user or assistant row (I, 5); a truncated row
    that stays costs 5 more.  Of the cheapest audits, the ASCII-least is taken.  A role
    counts by its first letter; a kept row keeps its role as it is.

    ``gaps`` counts the whole turn numbers between the least and the largest that no row has.
    ``illegal`` counts neighbours whose initials are not su, ua or au.  Rows go by turn, nulls
    first; rows that share a turn go by role, then by a digest of their text.  A null role or
    text counts as one space; rows of a null conversation are one conversation.  ``copies_col``
    names a column that says how often a row counts (0: its conversation is known, but not the
    row).  A conversation without rows has zeros and an empty audit; an empty table gives
    empty results.  Other columns are not looked at.

    Equal rows move as one with a count, texts only to meet their place.  A conversation of
    any length is cut into chunks of ``chunk_rows`` rows; only a chunk's costs and ranks meet
    in one task.
    """
    settle(turns.sparkSession)
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (role_col, text_col))
    read = turns.select(
        F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), role.alias("role"),
        text.alias("text"), (F.col(f"`{copies_col}`") if copies_col else F.lit(1)).cast("long").alias("n"),
    )
    bare = F.btrim("text", F.lit(WHITE))
    same = F.unhex(F.sha2(F.concat(
        F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("-")),
        F.lit(":"), F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"),
    ), 256))
    rows = stage(read.withColumns({"same": same}).withColumns({
        "key": F.unhex(F.sha2(F.concat(F.col("same"), F.coalesce(F.col("turn").cast("string"), F.lit("-")).cast("binary")), 256)),
        "bare": F.length(bare) == 0,
        "cut": ~F.right(bare, F.lit(1)).isin(".", "!", "?"),
    }))
    slim = rows.groupBy("conv", "turn", "role", "same", "key").agg(
        F.sum("n").alias("n"), F.max("bare").alias("bare"), F.max("cut").alias("cut")
    )
    slim = stage(slim)
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    seen = slim.where("n > 0").groupBy("same").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("held"))
    seen = stage(seen.where("held > 1").select(F.col("same").alias("again"), "first"))
    initial = F.pmod(F.instr(F.lit(INITIALS), F.left("role", F.lit(1))) - 1, F.lit(4))
    initial = F.when(F.length("role") == 0, F.lit(3)).otherwise(initial)

    def code(fault) -> F.Column:
        return F.char(F.lit(65) + 4 * initial + fault)

    late = F.coalesce(order > F.col("first"), F.lit(False))
    fault = F.when(F.col("bare"), 1).when(late, 2).when(F.col("cut"), 3).otherwise(0)
    coded = stage(
        slim.join(seen, F.col("same") == F.col("again"), "left").select(
            "conv", "turn", "role", "same", "n", code(fault).alias("code"),
            code(F.when(F.col("bare"), 1).otherwise(2)).alias("repeat"), "key",
        )
    )
    by = ["conv", "turn", "role", "same"]
    ordered = coded.repartitionByRange(*by).sortWithinPartitions(*by).select("conv", "turn", "n", "code", "repeat", "key")
    conv = T.StructField("conv", coded.schema["conv"].dataType)
    longs = [T.StructField(name, T.LongType()) for name in FACTS]
    made = T.StructType([
        conv, T.StructField("part", T.LongType()), T.StructField("whole", T.BooleanType()), *longs,
        T.StructField("low", T.LongType()), T.StructField("high", T.LongType()),
        T.StructField("head", T.StringType()), T.StructField("last", T.StringType()),
        T.StructField("costs", T.ArrayType(T.LongType())), T.StructField("ranks", T.ArrayType(T.IntegerType())),
        T.StructField("audits", T.ArrayType(T.StringType())), T.StructField("codes", T.StringType()),
        T.StructField("keys", T.ArrayType(T.BinaryType())),
    ])
    chunks = stage(ordered.mapInArrow(_chunked(chunk_rows, _arrow(made)), made))
    told = T.StructType([
        conv, T.StructField("part", T.LongType()), T.StructField("pick", T.IntegerType()), T.StructField("tail", T.StringType()),
        T.StructField("ends", T.BooleanType()), *longs, T.StructField("low", T.LongType()),
        T.StructField("high", T.LongType()), T.StructField("cost", T.LongType()),
    ])
    cut = chunks.where("NOT whole").select("conv", "part", *FACTS, "low", "high", "head", "last", "costs", "ranks")
    picked = stage(
        cut.repartition("conv").sortWithinPartitions("conv", "part").mapInArrow(_resolved(_arrow(told)), told)
    )
    whole = chunks.where("whole")
    parts = chunks.select("part", "codes", "keys", "audits").join(picked.select("conv", "part", "pick", "tail"), "part").select(
        "conv", "part", "codes", "keys", F.floor(F.col("pick") / 4).cast("int").alias("entry"),
        F.concat(F.element_at("audits", F.col("pick") + 1), "tail").alias("letters"),
    )
    alone = whole.select("conv", "part", "codes", "keys", F.lit(START).alias("entry"), F.col("audits")[0].alias("letters"))
    pieces = stage(alone.unionByName(parts))
    long_audits = pieces.join(picked.select("part"), "part", "left_semi").groupBy("conv").agg(
        F.array_sort(F.collect_list(F.struct("part", "letters"))).alias("found")
    ).select(F.col("conv").alias("of"), F.array_join("found.letters", "").alias("audit"))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    facts = [gaps, "blank", "duplicate", "truncated", "illegal"]
    ended = picked.where("ends").join(long_audits, F.col("conv").eqNullSafe(F.col("of")))
    found = whole.select(F.col("conv").alias(conv_col), *facts, F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit"))
    found = found.unionByName(ended.select(F.col("conv").alias(conv_col), *facts, "cost", "audit"))
    edit = T.StructType([
        conv, T.StructField("part", T.LongType()), T.StructField("place", T.LongType()), T.StructField("edit", T.StringType()),
        T.StructField("new_role", T.StringType()), T.StructField("at", T.BinaryType()),
    ])
    edits = pieces.mapInArrow(_replayed(_arrow(edit)), edit)
    texts = rows.where("n > 0").groupBy("key").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    # Inserted rows have no text to meet; a row without a key must not go to one task with all others.
    stay = edits.where("at IS NOT NULL").join(texts, F.col("at") == F.col("key")).select(
        "conv", "part", "place", F.coalesce("new_role", "role").alias("role"), "text", "edit"
    )
    added = edits.where("at IS NULL").select("conv", "part", "place", F.col("new_role").alias("role"), F.lit("").alias("text"), "edit")
    return Repair(found, stay.unionByName(added).withColumnRenamed("conv", conv_col))


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def conversation_digests(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """SHA-256 of each conversation's ``role:text`` lines, ``\\n`` between them.

    Lines stream through their conversation's digest in order, so that its length does not matter.
    """
    conv = turns.schema[conv_col]
    schema = T.StructType([conv, T.StructField("digest", T.StringType())])
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest, out = None, None, []
        for batch in batches:
            for owner, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if digest is None or owner != at:
                    if digest is not None:
                        out.append((at, digest.hexdigest()))
                    at, digest = owner, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(role.encode() + b":" + text.encode())
            if len(out) > 4096:
                yield _record(out, arrow)
                out = []
        if digest is not None:
            out.append((at, digest.hexdigest()))
        if out:
            yield _record(out, arrow)

    ordered = turns.repartition(conv_col).sortWithinPartitions(conv_col, "part", "place")
    return ordered.select(conv_col, "role", "text").mapInArrow(run, schema)
