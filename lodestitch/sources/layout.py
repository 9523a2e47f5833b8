"""Committed terminology tables laid out by attribute, typed tables between stages, and the inputs of a run."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestitch.functions.storage import Folder

from .terminology import EAV, exists, keep_exact_synonyms, keep_prefix, load_gold, require_files

# Columns of the tables between stages.
MAPPING = "hpo_id string, sct_id string, attribute string, confidence double"
FILTERED = MAPPING + ", validity int, step string"
REVIEW = "hpo_id string, sct_id string, validity int, n_sct int, llm_pass int, llm_decision string, confidence double, llm_rationale string"
GOLD_CHECK = "hpo_id string, hpo_label string, sct_id string, sct_label string, status string, n_sct int, llm_pass int, llm_decision string, confidence double, llm_rationale string"


class SchemaError(ValueError):
    """A table lacks columns of its contract, or has them in other types."""


class TerminologyTable:
    """A terminology's rows in a folder, parted by ``attribute``, so a filter on it reads those files only.

    A load is written to a folder of its own (``load=<id>``) and counts once ``_committed.json`` names it, written
    last; a load that was lost is written anew, whatever it left. The entry keeps the numbers of rows and concepts by
    attribute, counted from what was written.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.folder = spark, Folder(spark, path)

    def committed(self) -> dict | None:
        return json.loads(self.folder.text("_committed.json")) if self.folder.exists("_committed.json") else None

    def counts(self) -> dict[str, dict[str, int]]:
        """Rows and concepts by attribute, and of all as ``""``."""
        return (self.committed() or {"counts": {}})["counts"]

    def read(self) -> DataFrame:
        found = self.committed()
        if found is None:
            raise FileNotFoundError(f"{self.folder.path} holds no committed terminology")
        return self.spark.read.schema(EAV).parquet(f"{self.folder.path}/{found['load']}").select("concept_id", "attribute", "value", "additional")

    def write(self, rows: DataFrame) -> DataFrame:
        """Write ``rows`` as the table's new load, drop the old one; an empty table is an error and leaves the old."""
        load = f"load={uuid.uuid4().hex}"
        path = f"{self.folder.path}/{load}"
        rows = rows.select(*[F.col(c).cast("string").alias(c) for c in ("concept_id", "attribute", "value", "additional")]).filter("attribute IS NOT NULL")
        # A terminology's files are few and large: one hot attribute is spread over tasks by its concepts.
        rows.repartition("attribute", F.pmod(F.xxhash64("concept_id"), F.lit(8))).write.partitionBy("attribute").parquet(path)
        written = self.spark.read.schema(EAV).parquet(path)
        found = written.rollup("attribute").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("concept_id").alias("concepts")).collect()
        counts = {r["attribute"] or "": {"rows": r["rows"], "concepts": r["concepts"]} for r in found}
        if not counts.get("", {"rows": 0})["rows"]:
            self.folder.delete(load)
            raise ValueError(f"nothing loaded for {self.folder.path}")
        old = self.committed()
        if old is not None:
            self.folder.delete("_committed.json")
        self.folder.write("_committed.json", json.dumps({"load": load, "counts": counts}))
        for name in self.folder.names():
            if name.startswith("load=") and name != load:
                self.folder.delete(name)
        return self.read()


def load_terminology(spark: SparkSession, path: str, load: Callable[[], DataFrame], skip_if_present: bool = True) -> TerminologyTable:
    """The table at ``path``: reused if it is committed and may be, else made by ``load``."""
    table = TerminologyTable(spark, path)
    if not skip_if_present or table.committed() is None:
        table.write(load())
    return table


class Inputs(NamedTuple):
    """What all stages start from; ``counts`` has rows and concepts by terminology and attribute."""

    source: DataFrame
    target: DataFrame
    bridge: DataFrame
    gold: DataFrame
    counts: DataFrame


def counts_table(tables: dict[str, TerminologyTable]) -> DataFrame:
    """(terminology, attribute, n_rows, n_concepts), the whole terminology under a null attribute; taken from the commits."""
    spark = next(iter(tables.values())).spark
    rows = [(name, attribute or None, c["rows"], c["concepts"]) for name, t in tables.items() for attribute, c in t.counts().items()]
    return spark.createDataFrame(rows, "terminology string, attribute string, n_rows long, n_concepts long")


def load_inputs(spark: SparkSession, folder: str, loaders: dict[str, Callable[[], DataFrame]], gold: str, required: tuple[str, ...] = (), prefix: str = "HP:", skip_if_present: bool = True) -> Inputs:
    """Load source, target and bridge into ``folder`` and read the gold standard.

    ``loaders`` make the rows of ``source``, ``target`` and ``bridge``. Missing files among ``gold`` and ``required``
    are named at once, before anything is loaded. Of the source only concepts with ``prefix`` and exact synonyms stay.
    """
    require_files(spark, [gold, *required])
    tables = {name: load_terminology(spark, f"{folder}/{name}", loaders[name], skip_if_present) for name in ("source", "target", "bridge")}
    source = keep_prefix(keep_exact_synonyms(tables["source"].read()), "concept_id", prefix)
    return Inputs(source, tables["target"].read(), tables["bridge"].read(), load_gold(spark, gold), counts_table(tables))


def _typed(df: DataFrame, schema: str, name: str) -> DataFrame:
    """The contract's columns in its types and order; a text that isn't of its column's type is an error when it is read."""
    want = StructType.fromDDL(schema)
    lacking = [f.name for f in want if f.name not in df.columns]
    if lacking:
        raise SchemaError(f"{name} lacks {', '.join(lacking)}; it has {', '.join(df.columns)}")
    out = []
    for f in want:
        have, kind = df.schema[f.name].dataType.simpleString(), f.dataType.simpleString()
        number = {"int", "bigint", "smallint", "tinyint", "float", "double"}
        if have != kind and have not in ("string", "void") and not {have, kind} <= number:
            raise SchemaError(f"{name}: {f.name} is {have}, not {kind}")
        c = F.col(f"`{f.name}`")
        if have == "string" and kind != "string":
            # Whole numbers that went through a table of doubles ("10.0") are still whole.
            raw = F.when(F.trim(c) == "", F.lit(None)).otherwise(F.trim(c))
            c = raw.try_cast("double") if kind == "double" else F.when(raw.try_cast("double") == F.floor(raw.try_cast("double")), raw.try_cast("double")).cast(kind)
            c = F.when(raw.isNotNull() & c.isNull(), F.raise_error(F.concat(F.lit(f"{name}: {f.name} holds "), raw))).otherwise(c)
        out.append(c.cast(f.dataType).alias(f.name))
    return df.select(*out)


def read_stage(spark: SparkSession, path: str, schema: str, csv: bool = False, sep: str = ";") -> DataFrame:
    """A table between stages by its contract; ``step`` stays text, so "2" is not read as a number.

    More columns than the contract's are passed over. A missing table is a FileNotFoundError, missing columns and
    other types are a SchemaError that names them.
    """
    require_files(spark, [path])
    df = spark.read.option("sep", sep).option("header", True).option("quote", '"').option("escape", '"').option("inferSchema", False).csv(path) if csv else spark.read.parquet(path)
    return _typed(df, schema, path)


def read_optional(spark: SparkSession, path: str, schema: str, csv: bool = False) -> DataFrame:
    """The table, or an empty one of the same columns where there is none, so what joins it gets nulls."""
    return read_stage(spark, path, schema, csv) if exists(spark, path) else spark.createDataFrame([], schema)


def write_stage(df: DataFrame, path: str, schema: str, csv: bool = False, sep: str = ";") -> None:
    """The contract's columns alone, checked before anything is written."""
    out = _typed(df, schema, path).write.mode("overwrite")
    if csv:
        out.option("sep", sep).option("header", True).option("quote", '"').option("escape", '"').csv(path)
    else:
        out.parquet(path)
