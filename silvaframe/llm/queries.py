"""The queries of these operators over the documents, conversations, pages and embeddings tables."""

from __future__ import annotations

import os
from importlib.util import find_spec

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, chat, jaccard, language, mixing, packing, quality, topk, toxicity, urlrules
from .sample import held_out

#: Rules given for URLs: verdict, host, path.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Scores from which a text counts as toxic, and as good.
TOXIC, GOOD = 0.7, 0.5


def tokenizer(name: str) -> str:
    """Path of a public tokenizer file: in the folder ``SILVAFRAME_TOKENIZERS`` names, or the installed files'."""
    folder = os.environ.get("SILVAFRAME_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    if find_spec("public_tokenizers"):
        import public_tokenizers

        return public_tokenizers.path(name)
    return os.path.join("/opt/tokenizers", name)


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def op1_mixing(spark: SparkSession, sf: str) -> DataFrame:
    plan = mixing.mix_plan(_read(spark, sf, "documents"), whole=True)
    taken = F.aggregate("mix_draws", F.lit(0).cast("long"), lambda a, x: a + x.words)
    return plan.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), taken.alias("taken"), "mix_draws")


def op2_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _read(spark, sf, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    return chat.read_back(chat.formatted(rows, tokenizer("byte_bpe_50k.json"), tokens=False))


def op3_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = _read(spark, sf, "documents")
    found = language.LanguageModel.fit(docs).predict(docs)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op4_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packed(_read(spark, sf, "documents"), tokenizer("word_bpe_49k.json"), with_ids=False)


def op5_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.jaccard_classes(_read(spark, sf, "documents"), 3, 90)


def op6_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_inner_products(_read(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op7_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    pages, labels = _read(spark, sf, "pages"), _read(spark, sf, "labels")
    bad = labels.groupBy("doc_id").agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("block"))
    labelled = pages.select("page_id", "url").join(bad, F.col("page_id") == F.col("doc_id")).select("url", "block")
    return urlrules.judged(pages, labelled, URL_RULES)


def op8_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = _read(spark, sf, "documents")
    scored = toxicity.ToxicityModel.fit(docs, _read(spark, sf, "labels")).score(docs)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op9_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    stats = quality.measured(_read(spark, sf, "documents"))
    scored = quality.QualityModel.fit(stats, _read(spark, sf, "labels")).score(stats)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op10_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return ann.nearest(_read(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0, 10)


QUERIES = {f.__name__: f for f in (op1_mixing, op2_chat_formatting, op3_language_id, op4_best_fit_packing, op5_ngram_jaccard_join, op6_exact_topk, op7_url_filters, op8_toxicity, op9_quality_classifier, op10_nearest_neighbours)}

ORACLE_SQL = {
    "op2_chat_formatting": r"""
WITH rows AS (
    SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
    SELECT *, length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) + length(role) + length(regexp_replace(role, '[^\\#<:\n\r]', '', 'g')) + length('### ') + length(':n') + length('</turn>n') AS chars
    FROM rows
), said AS (
    SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
           coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss, sum(chars)::BIGINT AS formatted_chars
    FROM sized GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM said
""",
    "op5_ngram_jaccard_join": r"""
WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
    FROM worded
), shingles AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (
    SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id FROM sets s LEFT JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.s
""",
    "op6_exact_topk": """
WITH usable AS (
    SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.row AS query_row, q.vec_id AS query_id, d.row, d.vec_id, list_dot_product(q.v, d.v)::BIGINT AS score
    FROM usable q JOIN usable d ON q.vec_id % 20 = 0 AND q.row <> d.row
), ranked AS (
    SELECT query_id, (row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id, row))::INTEGER AS rank, vec_id, score
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
""",
}
