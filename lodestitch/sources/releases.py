"""Terminology releases as entity-attribute-value rows: snapshots of versioned files, and several files put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .terminology import EAV, read_piped, read_tabbed, require_files

# Columns of the tab-separated release files, by kind.
VERSIONED = {
    "concept": "id effectiveTime active moduleId definitionStatusId",
    "description": "id effectiveTime active moduleId conceptId languageCode typeId term caseSignificanceId",
    "definition": "id effectiveTime active moduleId conceptId languageCode typeId term caseSignificanceId",
    "relationship": "id effectiveTime active moduleId sourceId destinationId relationshipGroup typeId characteristicTypeId modifierId",
    "map": "id effectiveTime active moduleId refsetId referencedComponentId mapTarget",
}
# Columns of the pipe-separated release files.
RICH = {
    "MRCONSO": "CUI LAT TS LUI STT SUI ISPREF AUI SAUI SCUI SDUI SAB TTY CODE STR SRL SUPPRESS CVF",
    "MRDEF": "CUI AUI ATUI SATUI SAB DEF SUPPRESS CVF",
    "MRREL": "CUI1 AUI1 STYPE1 REL CUI2 AUI2 STYPE2 RELA RUI SRUI SAB SL RG DIR SUPPRESS CVF",
    "MRSTY": "CUI TUI STN STY ATUI CVF",
    "MRRANK": "RANK SAB TTY SUPPRESS",
}
# Identifiers of description kinds, of the is-a relation and of stated relations.
FULL_NAME, SYNONYM, DEFINITION = "900000000000003001", "900000000000013009", "900000000000550004"
IS_A, STATED = "116680003", "900000000000010007"
# Marks of rows that are obsolete or suppressed.
SUPPRESSED = ("O", "E", "Y")


def snapshot(rows: DataFrame, as_of: str | None = None, key: str = "id") -> DataFrame:
    """The active components of a full release: of each id the row of the latest ``effectiveTime``, if that is active.

    With ``as_of`` (yyyymmdd) later rows don't count. Rows that repeat a time are settled by their columns' order, so
    the result doesn't depend on the files' order. One aggregation, combined before its shuffle; null ids are dropped.
    """
    r = rows.filter(F.col(key).isNotNull())
    if as_of is not None:
        r = r.filter(F.col("effectiveTime") <= as_of)
    every = F.struct("effectiveTime", *[c for c in rows.columns if c != "effectiveTime"])
    return r.groupBy(F.col(key).alias("_key")).agg(F.max(every).alias("_row")).select("_row.*").filter("active = '1'").select(*rows.columns)


def _eav(df: DataFrame, concept: Column, attribute: Column | str, value: Column, additional: Column | None = None) -> DataFrame:
    kind = F.lit(attribute) if isinstance(attribute, str) else attribute
    extra = F.lit(None).cast("string") if additional is None else additional
    return df.select(concept.alias("concept_id"), kind.alias("attribute"), value.alias("value"), extra.alias("additional"))


def dictionary(key: str, values: Column, sep: str = ", ") -> Column:
    """The text of a dictionary of one key, whose values are joined; what ``entry_of`` reads."""
    return F.concat(F.lit(f"{{'{key}': '"), F.array_join(F.sort_array(F.array_distinct(values)), sep), F.lit("'}"))


def versioned_eav(files: dict[str, DataFrame], as_of: str | None = None, prefix: str = "SNOMEDCT_US:") -> DataFrame:
    """(concept_id, attribute, value, additional) of the active concepts of a versioned release.

    ``files`` holds tables by kind (``VERSIONED``); concept, description and relationship are needed. Full names are
    labels, other descriptions synonyms, text definitions definitions. Is-a relations that aren't only stated are
    ``children`` rows of the parent; both ends must be active. Map targets are references with their set's id.
    """
    now = {k: snapshot(x, as_of) for k, x in files.items()}
    live = now["concept"].select(F.col("id").alias("conceptId"))
    sid = lambda c: F.concat(F.lit(prefix), F.col(c))
    words = now["description"].join(live, "conceptId", "left_semi")
    kind = F.when(F.col("typeId") == FULL_NAME, "label").when(F.col("typeId") == SYNONYM, "synonym").when(F.col("typeId") == DEFINITION, "definition")
    out = _eav(words, sid("conceptId"), kind, F.col("term")).filter("attribute IS NOT NULL")
    if "definition" in now:
        out = out.unionByName(_eav(now["definition"].join(live, "conceptId", "left_semi"), sid("conceptId"), "definition", F.col("term")))
    is_a = now["relationship"].filter((F.col("typeId") == IS_A) & (F.col("characteristicTypeId") != STATED))
    for end in ("sourceId", "destinationId"):
        is_a = is_a.join(live.withColumnRenamed("conceptId", end), end, "left_semi")
    out = out.unionByName(_eav(is_a, sid("destinationId"), "children", sid("sourceId")).distinct())
    if "map" in now:
        mapped = now["map"].join(live.withColumnRenamed("conceptId", "referencedComponentId"), "referencedComponentId", "left_semi")
        mapped = mapped.groupBy("referencedComponentId", "mapTarget").agg(F.collect_set("refsetId").alias("sets"))
        out = out.unionByName(_eav(mapped, sid("referencedComponentId"), "reference", F.col("mapTarget"), dictionary("source", F.col("sets"))))
    return out


def rich_eav(files: dict[str, DataFrame], prefix: str = "UMLS:", language: str = "ENG") -> DataFrame:
    """(concept_id, attribute, value, additional) of a release in pipe-separated files (``RICH``); MRCONSO is needed.

    Suppressed rows are left out. A concept's label is its best name in ``language``: by MRRANK where it is given,
    else the preferred form; its other distinct names are synonyms with the list of their sources. Every source code
    is a reference with its sources. MRREL gives ``children`` (CHD, and PAR turned round), MRDEF definitions, MRSTY
    semantic types.
    """
    shown = lambda df: df.filter(~F.coalesce(F.col("SUPPRESS").isin(*SUPPRESSED), F.lit(False)))
    cid = lambda c: F.concat(F.lit(prefix), F.col(c))
    atoms = shown(files["MRCONSO"])
    rank = -F.coalesce(F.col("RANK").cast("int"), F.lit(0))
    names = atoms.filter((F.col("LAT") == language) & (F.trim("STR") != ""))
    if "MRRANK" in files:
        names = names.join(F.broadcast(files["MRRANK"].groupBy("SAB", "TTY").agg(F.max(F.col("RANK").cast("int")).alias("RANK"))), ["SAB", "TTY"], "left")
    else:
        names = names.withColumn("RANK", F.lit(None).cast("int"))
    best = F.struct(rank.alias("rank"), F.col("TS") != "P", F.col("STT") != "PF", F.col("ISPREF") != "Y", F.col("STR").alias("STR"))
    each = names.groupBy("CUI", "STR").agg(F.min(best).alias("best"), F.collect_set("SAB").alias("sources"))
    label = each.groupBy("CUI").agg(F.min("best").getField("STR").alias("label"))
    each = each.join(label, "CUI")
    is_label = F.col("STR") == F.col("label")
    out = _eav(each, cid("CUI"), F.when(is_label, "label").otherwise("synonym"), F.col("STR"), dictionary("source", F.col("sources")))
    codes = atoms.filter(F.coalesce(F.col("CODE"), F.lit("")) != "").groupBy("CUI", "CODE").agg(F.collect_set("SAB").alias("sources"))
    out = out.unionByName(_eav(codes, cid("CUI"), "reference", F.col("CODE"), dictionary("source", F.col("sources"))))
    if "MRDEF" in files:
        out = out.unionByName(_eav(shown(files["MRDEF"]).select("CUI", "DEF").distinct(), cid("CUI"), "definition", F.col("DEF")))
    if "MRREL" in files:
        rel = shown(files["MRREL"]).filter("CUI1 != CUI2")
        down = rel.filter("REL = 'CHD'").select(F.col("CUI1").alias("p"), F.col("CUI2").alias("c"))
        up = rel.filter("REL = 'PAR'").select(F.col("CUI2").alias("p"), F.col("CUI1").alias("c"))
        out = out.unionByName(_eav(down.unionByName(up).distinct(), cid("p"), "children", cid("c")))
    if "MRSTY" in files:
        out = out.unionByName(_eav(files["MRSTY"].select("CUI", "STY").distinct(), cid("CUI"), "semantic", F.col("STY")))
    return out


def read_versioned(spark: SparkSession, paths: dict[str, str], as_of: str | None = None, prefix: str = "SNOMEDCT_US:") -> DataFrame:
    """``versioned_eav`` of tab-separated files by kind; all missing files are named in one error, and so are missing columns."""
    require_files(spark, list(paths.values()))
    files = {}
    for kind, path in paths.items():
        found = read_tabbed(spark, path)
        lacking = sorted({*VERSIONED[kind].split()} - {*found.columns})
        if lacking:
            raise ValueError(f"{path} is no {kind} file: it lacks {', '.join(lacking)}")
        files[kind] = found.select(*VERSIONED[kind].split())
    return versioned_eav(files, as_of, prefix)


def read_rich(spark: SparkSession, paths: dict[str, str], prefix: str = "UMLS:", language: str = "ENG") -> DataFrame:
    """``rich_eav`` of pipe-separated files by name."""
    require_files(spark, list(paths.values()))
    return rich_eav({k: read_piped(spark, p, RICH[k].split()) for k, p in paths.items()}, prefix, language)


def empty_eav(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EAV)
