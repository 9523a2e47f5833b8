"""Readers of terminologies and gold standards, and the writers of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestitch.functions.text import parse_id, split_expression

EAV = "concept_id string, attribute string, value string, additional string"
# Match groups of the gold standard that name single targets.
MATCH_GROUPS = ("One to one match", "One to many")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def require_files(spark: SparkSession, paths: list[str]) -> None:
    """One error that names all missing files."""
    missing = [p for p in paths if not exists(spark, p)]
    if missing:
        raise FileNotFoundError("missing: " + ", ".join(missing))


def read_eav(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """Entity-attribute-value rows; all columns are strings."""
    return spark.read.schema(EAV).option("sep", sep).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


def read_piped(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Pipe-separated release files without header or quotes; each line ends with a bar."""
    return spark.read.schema(", ".join(f"{c} string" for c in [*columns, "_end"])).option("sep", "|").option("quote", "").csv(path).drop("_end")


def read_tabbed(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated release files with a header and no quotes."""
    return spark.read.option("sep", "\t").option("header", True).option("quote", "").option("inferSchema", False).csv(path)


def ingest_or_reuse(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    """``rows`` as Parquet in ``path``, written once and reused later; an empty table is an error."""
    if not exists(spark, path):
        if rows.isEmpty():
            raise ValueError(f"nothing loaded for {path}")
        rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def entry_of(additional: str, key: str) -> Column:
    """The text of one key in a stringified dictionary; null where it is missing or null."""
    found = F.regexp_extract(F.col(additional), rf"""['"]{key}['"]\s*:\s*(?:'([^']*)'|"([^"]*)")""", 0)
    return F.when(found != "", F.regexp_extract(found, r""":\s*['"](.*)['"]$""", 1))


def sources_of(additional: str, key: str = "source", sep: str = ", ") -> Column:
    """List of source vocabularies; empty where there is none."""
    return F.coalesce(F.split(entry_of(additional, key), sep), F.array().cast("array<string>"))


def keep_exact_synonyms(eav: DataFrame, key: str = "class", sep: str = ", ") -> DataFrame:
    """Drops synonyms whose class list lacks ``exact`` or can't be read; rows without a class stay."""
    raw, cls = F.trim(F.col("additional")), entry_of("additional", key)
    readable = raw.rlike(r"^\{.*\}$")
    keep = raw.isNull() | (raw == "") | (readable & (cls.isNull() | F.array_contains(F.split(cls, sep), "exact")))
    return eav.filter((F.col("attribute") != "synonym") | keep)


def keep_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    return df.filter(F.col(column).startswith(prefix))


def gold_pairs(raw: DataFrame, prefix: str = "SNOMEDCT_US:") -> DataFrame:
    """(hpo_id, sct_id) of rows (HP_ID, Match group, SNOMED term/exp) that name one target."""
    g = raw.filter(F.col("Match group").isin(*MATCH_GROUPS)).select(F.col("HP_ID").alias("hpo_id"), split_expression("SNOMED term/exp").alias("code"))
    g = g.withColumn("code", parse_id("code")).filter("hpo_id IS NOT NULL AND code IS NOT NULL")
    return g.select("hpo_id", F.concat(F.lit(prefix), "code").alias("sct_id")).distinct()


def load_gold(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    return gold_pairs(spark.read.option("sep", sep).option("header", True).option("inferSchema", False).csv(path))


def write_table(df: DataFrame, path: str, csv: bool = False) -> None:
    """Parquet, or a ``;`` CSV with doubles rounded half to even at four places."""
    if csv:
        df = df.select(*(F.bround(c, 4).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))
        df.write.mode("overwrite").option("sep", ";").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").parquet(path)
