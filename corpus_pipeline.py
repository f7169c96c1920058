"""The corpus pipeline: documents go through five of the corpus operators, each on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import decontaminate, exact_dedup, mix, simhash, toxicity
from brindle.llm.common import Scratch, free_name, fresh_path, remove


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores under the toxicity threshold.

    Null and empty texts score as texts without evidence; repeated rows are judged alike; without labels of both kinds
    all texts score the same; an empty table stays empty.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = free_name(docs.columns, "toxicity")
    return toxicity.with_score(docs, model, out=out).filter(~toxicity.toxic(out)).drop(out)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id.

    Null texts equal empty ones; of rows that repeat id and text one stays; null ids are the smallest.
    """
    return exact_dedup.kept_rows(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints are linked the one with the smallest id.

    Null and empty texts have one fingerprint; rows that repeat an id are judged each by its own text; null ids stay.
    """
    return simhash.representatives(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark passage occurs in.

    Null and empty texts have no words and stay, as does everything if the benchmark is empty; repeated rows are judged
    one by one.
    """
    out = free_name(docs.columns, "decontamination")
    found = decontaminate.with_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out=out)
    return found.filter(~decontaminate.contaminated(out)).drop(out)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mixture of sources takes them.

    The null source is a source; null and empty texts have no words and are taken by the hash of their id as others are;
    rows that repeat an id are taken alike; an empty table stays empty.
    """
    return mix.mixed_rows(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("simhash", without_near_copies),
    ("decontaminate", without_benchmark),
    ("mix", mixed),
]

#: Toxicity is a trained model, which SQL can't express; tests/llm holds all five stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written and read again; the last one's rows.

    Each stage's own tables go when its result is written, and a result goes when the next stage's is.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        with Scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
