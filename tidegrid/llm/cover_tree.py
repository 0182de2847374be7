"""Near-duplicate embeddings: exact threshold pairs by dual traversal of cover trees.

Equal vectors are one weighted point.  The points of a label are dealt to the nearest
of a few centres, the tree's top level, and large cells are cut by a hash.  Pairs of
blocks whose covering balls come near enough meet in a task, which builds a cover tree
for each side: nets whose radius halves from level to level.  Node pairs farther apart
than their covering radii and the threshold allow are pruned, node pairs close enough
to be linked throughout are counted whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.components import components
from tidegrid.llm.shared import settle, stage

LEAF = 32
#: Slack for rounding in distances, far above it and far below any pair's distance that counts.
SLACK = 1e-7


class Node:
    """Points ``start`` to ``end`` of the tree's order; all within ``radius`` of the first."""

    __slots__ = ("start", "end", "radius", "children")

    def __init__(self, start: int, end: int, radius: float, children: list[Node]):
        self.start, self.end, self.radius, self.children = start, end, radius, children


class CoverTree:
    """Nested nets of unit vectors: a node's first point is also its first child's."""

    def __init__(self, points: np.ndarray):
        self.points, self.order = points, np.arange(len(points))
        self.root = self._build(0, len(points), 2.0) if len(points) else None
        self.rows = points[self.order]

    def _distances(self, at: int, others: np.ndarray) -> np.ndarray:
        gap = self.points[others] - self.points[at]
        return np.sqrt(np.einsum("ij,ij->i", gap, gap))

    def _build(self, start: int, end: int, radius: float) -> Node:
        # Without recursion over halvings that split nothing, so the depth stays small.
        while True:
            mine = self.order[start:end]
            reach = self._distances(mine[0], mine)
            cover = float(reach.max())
            if end - start <= LEAF or radius < 1e-9:
                return Node(start, end, cover, [])
            if cover > radius / 2:
                break
            radius /= 2
        parts, rest = [], mine
        while len(rest):
            near = self._distances(rest[0], rest) <= radius / 2
            near[0] = True
            parts.append(rest[near])
            rest = rest[~near]
        self.order[start:end] = np.concatenate(parts)
        children, at = [], start
        for part in parts:
            children.append(self._build(at, at + len(part), radius / 2))
            at += len(part)
        return Node(start, end, cover, children)


class Links:
    """Counts of linked weight and local components, over two sides' points laid end to end."""

    def __init__(self, n: int):
        self.count, self.label = np.zeros(n, np.int64), np.arange(n)

    def join(self, i: int, j: int) -> None:
        a, b = sorted((self.label[i], self.label[j]))
        if a != b:
            self.label[self.label == b] = a


def dual_links(a: CoverTree, b: CoverTree, wa: np.ndarray, wb: np.ndarray, least: float, same: bool) -> Links:
    """Links of cosine ``least`` or more between the points of two trees (``same``: of one tree).

    Weights are the numbers of vectors at each point; results are in the points' own order,
    those of ``b`` after those of ``a`` unless it is the same tree.
    """
    na = len(a.points)
    out = Links(na if same else na + len(b.points))
    shift = 0 if same else na
    reach = float(np.sqrt(max(0.0, 2 - 2 * least)))
    wa, wb = wa[a.order], wb[b.order]
    ids_a, ids_b = a.order, b.order + shift
    todo = [(a.root, b.root)] if a.root and b.root else []

    def whole(x: Node, y: Node) -> None:
        xs, ys = slice(x.start, x.end), slice(y.start, y.end)
        if same and x is y:
            out.count[ids_a[xs]] += wa[xs].sum() - wa[xs]
        else:
            out.count[ids_a[xs]] += wb[ys].sum()
            out.count[ids_b[ys]] += wa[xs].sum()
        first = ids_a[x.start]
        for i in (*ids_a[xs], *ids_b[ys]):
            out.join(first, i)

    def single(x: Node, y: Node) -> None:
        xs, ys = slice(x.start, x.end), slice(y.start, y.end)
        linked = a.rows[xs] @ b.rows[ys].T >= least
        if same and x is y:
            np.fill_diagonal(linked, False)
            out.count[ids_a[xs]] += linked @ wb[ys]
        else:
            out.count[ids_a[xs]] += linked @ wb[ys]
            out.count[ids_b[ys]] += wa[xs] @ linked
        while True:
            la, lb = out.label[ids_a[xs]], out.label[ids_b[ys]]
            apart = np.argwhere(linked & (la[:, None] != lb[None, :]))
            if not len(apart):
                return
            out.join(ids_a[xs][apart[0, 0]], ids_b[ys][apart[0, 1]])

    while todo:
        x, y = todo.pop()
        if same and x is y:
            if 2 * x.radius < reach - SLACK:
                whole(x, y)
                continue
        if not x.children and not y.children:
            single(x, y)
            continue
        left, right = x.children or [x], y.children or [y]
        cx, cy = np.array([n.start for n in left]), np.array([n.start for n in right])
        rx, ry = np.array([n.radius for n in left]), np.array([n.radius for n in right])
        for at in range(0, len(cx), 1024):  # a node may have thousands of children
            dots = a.rows[cx[at : at + 1024]] @ b.rows[cy].T
            apart = np.sqrt(np.maximum(0.0, 2 - 2 * dots))
            cover = rx[at : at + 1024, None] + ry[None, :]
            near = apart <= cover + reach + SLACK
            if same and x is y:
                near &= np.arange(at, at + len(dots))[:, None] <= np.arange(len(cy))[None, :]
            inside = near & (apart + cover < reach - SLACK)
            for i, j in np.argwhere(near):
                u, v = left[at + i], right[j]
                if inside[i, j] and not (same and u is v):
                    whole(u, v)
                else:
                    todo.append((u, v))
    return out


# ------------------------------------------------------------------ on Spark


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(…, unit, centres) to cell and distance; no centres is cell 0."""
    for batch in batches:
        frame = batch.to_pandas()
        cells, far = np.zeros(len(frame), np.int64), np.zeros(len(frame))
        for _, rows in frame.groupby(["label", "dim"], sort=False):
            centres = rows["centres"].iloc[0]
            if centres is None or not len(centres):
                continue
            gap = np.stack(rows["unit"].to_numpy())[:, None, :] - np.stack(centres)[None]
            apart = np.sqrt((gap * gap).sum(axis=2))
            cells[rows.index] = apart.argmin(axis=1)
            far[rows.index] = apart.min(axis=1)
        keep = ["node", "label", "dim", "unit", "weight"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in keep), pa.array(cells), pa.array(far)], [*keep, "cell", "far"]
        )


def _block_pairs(reach: float, block_rows: int):
    """Cells of one label to pairs of blocks whose covering balls are near enough."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        cells = frame.sort_values("cell").reset_index(drop=True)
        blocks = [-(-int(n) // block_rows) for n in cells["n"]]
        out = []
        for i in range(len(cells)):
            for j in range(i, len(cells)):
                if i != j:
                    apart = np.linalg.norm(cells["centre"][i] - cells["centre"][j])
                    if apart > cells["radius"][i] + cells["radius"][j] + reach + SLACK:
                        continue
                for p in range(blocks[i]):
                    for q in range(p if i == j else 0, blocks[j]):
                        out.append((cells["cell"][i], p, cells["cell"][j], q))
        pairs = pd.DataFrame(out, columns=["cell_a", "salt_a", "cell_b", "salt_b"])
        pairs["label"], pairs["dim"] = cells["label"][0], cells["dim"][0]
        return pairs

    return run


def _meet(least: float):
    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        sides = np.flatnonzero(side <= 0), np.flatnonzero(side > 0)
        nodes, weights = table.column("node").to_numpy(), table.column("weight").to_numpy()
        dim = table.column("dim")[0].as_py()
        units = table.column("unit").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        same = not len(sides[1]) and side.max() < 0
        a = CoverTree(units[sides[0]])
        b = a if same else CoverTree(units[sides[1]])
        found = dual_links(a, b, weights[sides[0]], weights[sides[0] if same else sides[1]], least, same)
        order = nodes[sides[0]] if same else nodes[np.concatenate(sides)]
        some = found.count > 0
        return pa.table({
            "node": pa.array(order[some]), "links": pa.array(found.count[some]),
            "root": pa.array(order[found.label[some]]),
        })

    return run


def near_duplicate_links(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    least: float = 0.98, block_rows: int = 4096, max_centres: int = 64,
) -> DataFrame:
    """Links of cosine ``least`` or more (over 0) between vectors of one label, and their components.

    One row per vector: the id column, ``n_links`` (other vectors linked directly, copies
    included), ``component_id`` (the smallest id reachable, itself included), ``kept`` (the
    id is the component's).  Cosines are in double precision.

    Vectors link with nothing that are null or zero, hold null or non-finite components or
    have a null label; neither do vectors of different lengths.  Rows without an id count
    as linked vectors, but give no component its name; a component of such rows alone has
    a null name and keeps none.  Rows that share an id are vectors of their own.
    An empty table gives an empty result; other columns are not looked at.
    """
    if not 0 < least <= 1:
        raise ValueError("the least cosine must be over 0 and at most 1")
    spark = settle(vectors.sparkSession)
    reach = float(np.sqrt(2 - 2 * least))
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").alias("label"), vector.alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # Scaled by the largest component first, so that squares neither overflow nor vanish.
    top = F.array_max(F.transform("vec", F.abs))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("vec") > 0) & finite & (top > 0), F.lit(False))
    rows = rows.withColumn("ok", usable)
    linkable = rows.where("ok")
    classes = linkable.groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    scaled = F.transform("vec", lambda x: x / top)
    norm = F.sqrt(F.aggregate("_s", F.lit(0.0), lambda n, x: n + x * x))
    points = stage(
        classes.withColumn("_s", scaled).withColumn("_n", norm).select(
            F.monotonically_increasing_id().alias("node"), "label", F.size("vec").alias("dim"), "vec", "rep", "weight",
            F.transform("_s", lambda x: x / F.col("_n")).alias("unit"),
        )
    )
    # The top level: few centres, drawn by hash, for labels that do not fit a block.
    sizes = points.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_rows)
    wanted = F.least(F.lit(float(max_centres)), F.col("n") / (block_rows / 4))
    drawn = F.pmod(F.xxhash64("unit", F.lit(1)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    centres = stage(
        points.join(sizes, ["label", "dim"]).where(drawn < wanted / F.col("n"))
        .groupBy("label", "dim").agg(F.collect_list("unit").alias("centres"))
    )
    celled = stage(
        points.select("node", "label", "dim", "unit", "weight").join(centres, ["label", "dim"], "left")
        .mapInArrow(
            _nearest,
            points.select("node", "label", "dim", "unit", "weight").schema.add("cell", "long").add("far", "double"),
        )
    )
    cells = celled.groupBy("label", "dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).join(
        centres, ["label", "dim"], "left"
    ).select("label", "dim", "cell", "n", "radius", F.expr("try_element_at(centres, cast(cell + 1 AS int))").alias("centre"))
    label_type = points.schema["label"].dataType.simpleString()
    pairs = stage(
        cells.groupBy("label", "dim").applyInPandas(
            _block_pairs(reach, block_rows),
            f"cell_a long, salt_a long, cell_b long, salt_b long, label {label_type}, dim int",
        ).withColumn("pair", F.monotonically_increasing_id())
    )
    self_pair = (F.col("cell_a") == F.col("cell_b")) & (F.col("salt_a") == F.col("salt_b"))
    part = lambda s, side: pairs.select(
        "pair", "label", "dim", F.col(f"cell_{s}").alias("cell"), F.col(f"salt_{s}").alias("salt"),
        F.when(self_pair, -1).otherwise(side).alias("side"),
    )
    seats = part("a", 0).unionByName(part("b", 1).where("side >= 0"))
    # A point knows its block first, so that it meets the seats of that block only.
    blocks = cells.select("label", "dim", "cell", F.ceil(F.col("n") / block_rows).alias("blocks"))
    salted = celled.join(blocks, ["label", "dim", "cell"]).withColumn(
        "salt", F.pmod(F.xxhash64("node", F.lit(9)), F.col("blocks"))
    )
    seated = salted.join(seats, ["label", "dim", "cell", "salt"])
    found = stage(
        seated.select("pair", "side", "node", "dim", "unit", "weight").groupBy("pair")
        .applyInArrow(_meet(least), "node long, links long, root long")
    )
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found, "node", "root")
    named = points.select("node", "label", "vec", "rep", "weight").join(linked, "node", "left").join(groups, "node", "left")
    named = stage(named.withColumn("component", F.coalesce("component", "node")))
    names = named.groupBy("component").agg(F.min("rep").alias("name"))
    result = named.join(names, "component").select(
        F.col("label").alias("_label"), F.col("vec").alias("_vec"),
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("_links"), "name",
    )
    of_rows = rows.where("ok").join(result, (F.col("label") == F.col("_label")) & (F.col("vec") == F.col("_vec")), "left")
    done = of_rows.select("id", F.col("_links").alias("n_links"), F.col("name").alias("component_id"))
    alone = rows.where("NOT ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return done.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
