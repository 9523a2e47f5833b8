"""The corpus pipeline: toxicity, near copies, benchmark passages, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestitch.llm import decontaminate, jaccard, packing, pii, toxicity
from lodestitch.llm.common import read, stage
from lodestitch.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows not predicted toxic; null and empty texts are scored like texts without a known term."""
    return toxicity.reject(docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies (five words, 0.8), the smallest id; rows without a key or words stay."""
    return jaccard.keep_one(docs, k=5, num=80, den=100)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item; null keys are keys."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their personal data replaced; ``n_chars`` follows the new text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*docs.columns) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; a null text is the end token alone."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("jaccard join", drop_near_copies), ("decontamination", drop_leaks), ("pii", redact_pii), ("packing", pack)]

#: The models of the stages can't be expressed in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
