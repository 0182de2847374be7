"""The text operators as registered queries over the benchmark tables, with SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.clause_grammar import fit_toxicity, score_toxicity
from tidegrid.llm.conversation_repair import conversation_digests, repair_conversations
from tidegrid.llm.cover_tree import near_duplicate_links
from tidegrid.llm.curve_packing import pack_along_curve
from tidegrid.llm.gated_lm import language_model_scores
from tidegrid.llm.line_runs import drop_repeated_lines
from tidegrid.llm.merge_dropout import decode_pieces, encode_pieces
from tidegrid.llm.shared import WHITE, shared_folder, table
from tidegrid.llm.signature_join import shingle_components
from tidegrid.llm.site_quality import fit_quality, score_quality
from tidegrid.llm.subword_language import fit_language, held_out, predict_language
from tidegrid.llm.token_alignment import align_tokenizers
from tidegrid.llm.trie_dedup import exact_groups
from tidegrid.llm.warc import archive_round_trip

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WHITE_SQL = " || ".join(f"chr({ord(c)})" for c in WHITE)
LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


# ------------------------------------------------------------- 1 SentencePiece


@query("op1_merge_dropout")
def op1_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document under merge-dropout, and whether they decode to its text."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = decode_pieces(encode_pieces(docs, model), model)
    return decoded.select(
        "doc_id", "variant", F.coalesce(F.size("ids"), F.lit(0)).alias("n_pieces"), "ids",
        F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"),
    )


# ------------------------------------------------------------- 2 exact dedup

EXACT_SQL = f"""
WITH normal AS (SELECT doc_id, sha256({LOWER_SQL.format("coalesce(text, '')")}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM normal WINDOW same AS (PARTITION BY text_sha256)
"""


@query("op2_exact_dedup", EXACT_SQL)
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep="largest")


# ------------------------------------------------------------- 3 WARC

WARC_SQL = """
WITH page AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
           sha256(coalesce(html, '')) AS payload_digest FROM pages
), typed AS (
    SELECT *, payload_bytes >= 100 AND page_id <> min(page_id) OVER (PARTITION BY payload_digest) AS again,
           min(page_id) OVER (PARTITION BY payload_digest) AS smallest FROM page
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN smallest END AS refers_to
FROM typed
"""


@query("op3_warc", WARC_SQL)
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"), shared_folder(spark, "warc"))


# ------------------------------------------------------------- 4 packing


@query("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_along_curve(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


# ------------------------------------------------------------- 5 quality classifier


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior quality of every document; labels of held-out documents are not learned from."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_quality(docs, labels, held_out=held_out(F.col("id"), 5, 2))
    scored = score_quality(docs, model)
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), 5, 2).alias("held_out"), "evidence", "host_rate", "path_rate",
        F.col("quality_score").alias("score"), F.col("quality_kept").alias("kept"),
    )


# ------------------------------------------------------------- 6 n-gram Jaccard join


@query("op6_jaccard_join")
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shingle_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


# ------------------------------------------------------------- 7 language model


@query("op7_language_model")
def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 7, 2))


# ------------------------------------------------------------- 8 language


@query("op8_language")
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict_language(docs.select("doc_id", "text"), fit_language(docs))
    return found.select(
        "doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred",
        F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"),
    )


# ------------------------------------------------------------- 9 embedding near-dedup


@query("op9_embedding_dedup")
def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_links(table(spark, sf_dir, "embeddings"))


# ------------------------------------------------------------- 10 line dedup

LINE_SQL = f"""
WITH lines AS (
    SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents
), keyed AS (
    SELECT *, {LOWER_SQL.format(f"trim(line, {WHITE_SQL})")} AS k FROM lines
), repeated AS (
    SELECT k, max(doc_id) AS owner FROM keyed WHERE length(k) >= 20
    GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
    SELECT keyed.doc_id, pos, line, coalesce(owner <> keyed.doc_id, FALSE) AS gone
    FROM keyed LEFT JOIN repeated ON keyed.k = repeated.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op10_line_dedup", LINE_SQL)
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id",
        F.col("line_count").alias("n_lines"),
        F.col("lines_dropped").alias("n_dropped"),
        F.sha2(F.col("text"), 256).alias("kept_sha256"),
    )


# ------------------------------------------------------------- 11 cross-tokenizer alignment


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    found = align_tokenizers(table(spark, sf_dir, "documents").select("doc_id", "text"), *paths)
    return found.documents.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


# ------------------------------------------------------------- 12 toxicity


@query("op12_toxicity")
def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of held-out documents are not learned from."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels, held_out(F.col("id"), 3, 1))
    scored = score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), F.col("toxicity").alias("score"),
        F.col("toxic").cast("int").alias("predicted"),
    )


# ------------------------------------------------------------- 13 conversation repair


def damaged(turns: DataFrame) -> DataFrame:
    """The test damage, dealt by conversation and turn; ``copies`` says how often a row stands."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    how = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return turns.select(
        "conv_id", "turn", F.when(how == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(how == 1, F.lit("")).when(how == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(how == 0, 0).when(how == 3, 2).otherwise(1).alias("copies"),
    )


def repaired_conversations(turns: DataFrame, chunk_rows: int = 4096) -> DataFrame:
    repair = repair_conversations(damaged(turns), copies_col="copies", chunk_rows=chunk_rows)
    digests = conversation_digests(repair.turns).withColumnRenamed("conv_id", "of")
    found = repair.conversations.join(digests, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    return found.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


@query("op13_conversation_repair")
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_conversations(table(spark, sf_dir, "conversations"))
