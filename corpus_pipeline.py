"""Documents to training sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from silvaframe.llm import jaccard, mixing, packing, quality, toxicity
from silvaframe.llm.queries import GOOD, TOXIC, tokenizer
from silvaframe.llm.scratch import clear, mark, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that score as toxic go."""
    return toxicity.ToxicityModel.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).kept(docs, TOXIC)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that score as poor go."""
    return quality.QualityModel.fit_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).kept(docs, GOOD)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by five-word shingles with a similarity of 0.8 or more, the one with the smallest id stays."""
    return jaccard.one_of_each(docs, 5, 80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole texts of sources at their target weights, shard by shard, each in its local shuffle; a document that is drawn twice is two rows."""
    mix = mixing.mixed(docs, whole=True)
    return mix.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of the mix at its place in a sequence."""
    return packing.packed(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity_stage), ("quality classifier", quality_stage), ("n-gram Jaccard join", jaccard_stage), ("mixing", mixing_stage), ("best-fit packing", packing_stage)]

#: The stages are models, similarity classes and a packing; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written before the next reads them, and its own tables go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    begun = mark()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        clear(spark, keep=(docs,), since=begun)
    return STAGES[-1][1](spark, docs, sf_dir)
