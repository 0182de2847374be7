"""Line deduplication with levelled sorted runs of line hashes, in DataFrame operations only.

A run is a table bucketed and sorted by line hash.  Documents come in batches; a
batch is merge-anti-joined with the runs there are, its unseen hashes become a new
run of level 0, and what it adds to known hashes is kept as an update.  When a level
holds ``fanout`` runs, they and the updates are compacted into one run of the next
level.  Runs of one number of buckets are joined without a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.shared import WHITE, ascii_lower, fresh_name, packed, partitions, settle, shared_folder, stage

KEY = ["h64", "h32"]


def line_key(line: Column) -> Column:
    """What two lines must share to be equal: stripped, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def _hashes(line: Column) -> Column:
    """96 bits of a line's key."""
    key = line_key(line)
    return F.struct(F.xxhash64(key).alias("h64"), F.hash(key).alias("h32"))


class LineRuns:
    """The levels of sorted runs: rows (h64, h32, docs, owner), each hash in one run."""

    def __init__(self, spark: SparkSession, fanout: int = 2, buckets: int | None = None):
        self.spark, self.fanout = settle(spark), fanout
        self.buckets = buckets or partitions(spark)
        self.levels: list[list[str]] = []
        self.updates: list[str] = []

    def _write(self, rows: DataFrame) -> str:
        name = fresh_name("line_run")
        (
            rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY)
            .option("path", shared_folder(self.spark, name)).saveAsTable(name)
        )
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, batch: DataFrame) -> None:
        """Add a batch of (h64, h32, docs, owner), one row for each hash."""
        name = self._write(batch)
        if self._runs():
            rows = self.spark.table(name)
            fresh, known = rows, []
            for run in self._runs():
                keys = self.spark.table(run).select(*KEY)
                known.append(fresh.join(keys, KEY, "left_semi"))
                fresh = fresh.join(keys, KEY, "left_anti")
            new = self._write(fresh)
            self.updates.append(self._write(reduce(DataFrame.unionByName, known)))
            self._drop([name])
            name = new
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(name)
        self._compact()

    def _compact(self) -> None:
        for depth, level in enumerate(self.levels):
            if len(level) < self.fanout:
                continue
            merged = self._write(self._merged(level))
            if depth + 1 == len(self.levels):
                self.levels.append([])
            self.levels[depth + 1].append(merged)
            self._drop(level)
            self.levels[depth] = []
            return self._compact()

    def _merged(self, names: list[str]) -> DataFrame:
        rows = reduce(DataFrame.unionByName, [self.spark.table(n) for n in names])
        return rows.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.max("owner").alias("owner"))

    def totals(self) -> DataFrame:
        """Every hash with its number of documents and the largest id, over all levels."""
        return self._merged([*self._runs(), *self.updates])

    def close(self) -> None:
        """Forget the tables; their files lie in the shared folder."""
        self._drop([*self._runs(), *self.updates])


def drop_repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
    batches: int = 4,
    fanout: int = 2,
) -> DataFrame:
    """Remove lines that stand in ``min_docs`` or more documents, but for one holder.

    Lines end at ``\\n``.  Lines are equal when equal after stripping ASCII white space
    and lower-casing A-Z; only those with ``min_chars`` code points or more are looked
    at.  The document with the largest id keeps all its copies.  Returns the columns of
    ``docs``, the text without the lines, and ``line_count`` and ``lines_dropped``
    (columns of the input with these two names are replaced).

    A null or empty text is one empty line and comes back as an empty text.  Rows that
    share an id count as one document.  Rows without an id count as no document: they
    lose the lines that others repeat.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    doc, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lines = F.split(text, "\n", -1)

    def numbered(s: Column, at: Column) -> Column:
        long = F.char_length(F.btrim(s, F.lit(WHITE))) >= min_chars
        return F.struct(F.when(long, _hashes(s)).alias("k"), at.alias("at"))

    # The hash of a text is a column before lines are rows, else each line would hash its whole text.
    listed = docs.select(
        doc.alias("doc"),
        F.xxhash64(text).alias("text_hash"),
        F.pmod(F.xxhash64(doc, F.lit(1)), F.lit(batches)).alias("batch"),
        F.filter(F.transform(lines, numbered), lambda s: s["k"].isNotNull()).alias("lines"),
    )
    keyed = stage(
        listed.select("doc", "text_hash", "batch", F.explode("lines").alias("line"))
        .select("doc", "text_hash", "batch", "line.at", "line.k.h64", "line.k.h32")
    )
    runs = LineRuns(spark, fanout)
    for b in range(batches):
        held = keyed.where((F.col("batch") == b) & F.col("doc").isNotNull()).select("doc", *KEY)
        runs.add(
            held.distinct().groupBy(*KEY)
            .agg(F.count(F.lit(1)).alias("docs"), F.max("doc").alias("owner"))
        )
    repeated = stage(runs.totals().where(F.col("docs") >= min_docs).select(*KEY, "owner"))
    runs.close()
    # The same id with the same text has the same lines: one list of line numbers to drop.
    drops = (
        keyed.join(repeated, KEY)
        .where(~F.col("doc").eqNullSafe(F.col("owner")))
        .groupBy("doc", "text_hash")
        .agg(F.collect_set("at").alias("drop"))
    )
    names = [c for c in docs.columns if c not in ("line_count", "lines_dropped")]
    rows = docs.select(packed([c for c in names if c != text_col]), doc.alias("id"), text.alias("text"))
    joined = rows.join(
        drops, F.col("id").eqNullSafe(F.col("doc")) & (F.xxhash64("text") == F.col("text_hash")), "left"
    )
    # The lines are a lambda's variable, split once and never copied into a row.  Numbers are set
    # apart by hash, so that a document costs its lines and not their square.
    split = F.split("text", "\n", -1)

    def without(lines: Column) -> Column:
        stays = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drop"))
        new_text = F.array_join(F.transform(stays, lambda at: F.get(lines, at)), "\n")
        return F.struct(new_text.alias("text"), F.size(lines).alias("lines"), (F.size(lines) - F.size(stays)).alias("dropped"))

    # Most documents lose nothing and keep their text as it is.
    same = F.struct(F.col("text").alias("text"), F.size(split).alias("lines"), F.lit(0).alias("dropped"))
    cut = joined.select("row", F.when(F.col("drop").isNull(), same).otherwise(F.transform(F.array(split), without)[0]).alias("cut"))
    return cut.select(
        *[F.col("cut.text").alias(text_col) if c == text_col else F.col(f"row.`{c}`") for c in names],
        F.col("cut.lines").cast("long").alias("line_count"),
        F.col("cut.dropped").cast("long").alias("lines_dropped"),
    )
