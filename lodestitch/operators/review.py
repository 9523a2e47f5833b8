"""Review of candidate pairs by a model behind an interface: selection, prompts, answer store, parsing, merging."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestitch.constants import CONFIDENCE_MAX, REVIEW_REASON
from lodestitch.functions.storage import Scratch
from lodestitch.functions.text import children_text, quote_list

from .answers import CHUNK, AnswerStore, prompt_key

PAIR = ["hpo_id", "sct_id"]
#: What prompts say about targets is sent to all tasks up to so many bytes.
TOLD_BYTES = 128 << 20
ANSWER = "struct<rationale:string,decision:string,confidence:string>"
_LISTS = ("labels", "synonyms", "definitions", "comments", "parents", "children")
_CANDIDATE = "struct<sct_id:string,rationale:string,decision:string,confidence:string>"
GROUP = f"struct<mappings:array<{_CANDIDATE}>>"


def select_pairs(coded: DataFrame) -> DataFrame:
    """(hpo_id, sct_id, validity, review_reason, n_sct, llm_pass): reviewable pairs; one candidate goes to pass 1, more to pass 2.

    Rows are dealt once, by their concept; pairs are told apart and counted where they lie.
    """
    p = coded.filter(F.col("validity").isin(*REVIEW_REASON)).select(*PAIR, "validity").repartition("hpo_id").groupBy(*PAIR).agg(F.max("validity").alias("validity"))
    p = p.filter("hpo_id IS NOT NULL").withColumn("n_sct", F.count(F.lit(1)).over(Window.partitionBy("hpo_id")))
    reason = F.create_map(*[F.lit(x) for kv in REVIEW_REASON.items() for x in kv])
    return p.select(*PAIR, "validity", F.try_element_at(reason, F.col("validity").cast("int")).alias("review_reason"), "n_sct", F.when(F.col("n_sct") == 1, 1).otherwise(2).alias("llm_pass"))


def describe(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """(concept_id, labels, synonyms, definitions, comments, parents, children): ordered lists for prompts.

    ``concepts`` is (concept_id, attribute, value); parents and children are labels.
    """

    def values(kind: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("attribute") == kind, F.col("value"))))

    c = concepts.groupBy("concept_id").agg(values("label").alias("labels"), values("synonym").alias("synonyms"), values("definition").alias("definitions"), values("comment").alias("comments"))
    label = concepts.filter("attribute = 'label'").select("concept_id", F.col("value").alias("term"))
    for name, own, other in (("parents", "child", "parent"), ("children", "parent", "child")):
        e = edges.select(F.col(own).alias("own"), F.col(other).alias("concept_id")).distinct().join(label, "concept_id")
        c = c.join(e.groupBy(F.col("own").alias("concept_id")).agg(F.array_sort(F.collect_list("term")).alias(name)), "concept_id", "left")
    empty = F.array().cast("array<string>")
    return c.withColumn("parents", F.coalesce("parents", empty)).withColumn("children", F.coalesce("children", empty))


def _lines(*parts: tuple[str, Column]) -> Column:
    return F.concat_ws("\n", *(F.concat(F.lit(f"* {name}: "), c) for name, c in parts))


def _source(**lists: Column) -> Column:
    return _lines(*((name, quote_list(lists[c])) for name, c in (("Label", "labels"), ("Synonyms", "synonyms"), ("Definition", "definitions"), ("Comment", "comments"), ("Parents", "parents"))), ("Children", children_text(lists["children"])))


def _target(**lists: Column) -> Column:
    return _lines(("Term", quote_list(lists["labels"])), ("Synonyms", quote_list(lists["synonyms"])), ("Parents", quote_list(lists["parents"])), ("Children", children_text(lists["children"])))


def _told(described: DataFrame, text: Callable[..., Column], key: str, name: str) -> DataFrame:
    """(key, name): what a prompt says about a concept, made once however many pairs have it, as its lists may be long."""
    return described.select(F.col("concept_id").alias(key), text(**{c: F.col(c) for c in _LISTS}).alias(name))


def _untold(text: Callable[..., Column]) -> Column:
    """The text of a concept that isn't described."""
    return text(**dict.fromkeys(_LISTS, F.lit(None).cast("array<string>")))


def prompts(selected: DataFrame, source: DataFrame, target: DataFrame, reach: DataFrame) -> DataFrame:
    """(hpo_id, llm_pass, prompt): one per pair in pass 1, one per concept with all its candidates in pass 2.

    What is said about a target, and what lies above it, is written once; where it is small (TOLD_BYTES) each task
    holds it, so that only pairs are dealt, by their concept, and no text.
    """
    h = _told(source, _source, "hpo_id", "src")
    over = reach.filter("ancestor != descendant").groupBy(F.col("descendant").alias("sct_id")).agg(F.collect_set("ancestor").alias("over"))
    said = target.select(F.col("concept_id").alias("sct_id"), _target(**{c: F.col(c) for c in _LISTS}).alias("tgt"), quote_list(F.slice("labels", 1, 1)).alias("l"))
    t = Scratch(selected.sparkSession, "told").keep(said.join(over, "sct_id", "full"), "targets")
    size = F.octet_length(F.coalesce("tgt", F.lit(""))) + F.octet_length(F.coalesce(F.array_join(F.col("over").cast("array<string>"), " "), F.lit(""))) + 64
    small = (t.agg(F.sum(size)).first()[0] or 0) <= TOLD_BYTES
    p = selected.select("hpo_id", "sct_id", "llm_pass", "validity", "review_reason").join(F.broadcast(t) if small else t, "sct_id", "left")
    g = p.groupBy("hpo_id", "llm_pass").agg(F.sort_array(F.collect_list(F.struct((-F.col("validity")).alias("v"), "sct_id", "tgt", "review_reason", "over", "l"))).alias("c"))
    ids = F.col("c.sct_id")
    links = F.flatten(F.transform("c", lambda x: F.transform(F.array_intersect(F.coalesce(x["over"], F.slice(ids, 1, 0)), ids), lambda o: F.struct(o.alias("broader"), x["sct_id"].alias("narrower")))))
    g = g.withColumn("links", links)
    g = g.withColumn("names", F.when(F.size("links") > 0, F.transform("c", lambda x: F.struct(x["sct_id"].alias("o"), F.coalesce(x["l"], F.lit('"None"')).alias("l")))))
    block = lambda x: F.concat_ws("\n", _lines(("ID", x["sct_id"].cast("string"))), F.coalesce(x["tgt"], _untold(_target)), _lines(("Related candidates", _related(x["sct_id"])), ("Review reason", x["review_reason"])))
    g = g.withColumn("b", F.transform("c", block)).select("hpo_id", "llm_pass", "b").join(h, "hpo_id", "left")
    return g.select("hpo_id", "llm_pass", F.concat(F.coalesce("src", _untold(_source)), F.lit("\n\n"), F.array_join("b", "\n\n---\n\n")).alias("prompt"))


def _related(own: Column) -> Column:
    """Which other candidates of a concept a candidate is broader or narrower than, by its ``links`` and ``names``."""

    def said(o: Column, kind: str) -> Column:
        name = F.get(F.filter("names", lambda y: y["o"] == o), F.lit(0))["l"]
        return F.struct(o.alias("o"), F.concat(F.lit(f"{kind} than "), o.cast("string"), F.lit(" ("), name, F.lit(")")).alias("t"))

    wide = F.transform(F.filter("links", lambda k: k["broader"] == own), lambda k: said(k["narrower"], "broader"))
    narrow = F.transform(F.filter("links", lambda k: k["narrower"] == own), lambda k: said(k["broader"], "narrower"))
    both = F.sort_array(F.concat(wide, narrow))
    return F.when(F.size(both) > 0, F.array_join(F.transform(both, lambda r: r["t"]), "; ")).otherwise("None")


def generate(asked: DataFrame, model: Callable[[list[str]], list[str]], settings: str, store: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """``asked`` with the model's ``answer``; each distinct prompt is asked once.

    With ``store``, answers are kept there chunk by chunk (``AnswerStore``), so a run that was lost goes on after its
    last chunk and a later one asks only what is missing; a store of other settings is refused. ``model`` runs on
    executors, one Arrow batch of prompts at a time.
    """
    if store:
        kept = AnswerStore(asked.sparkSession, store, settings)
        kept.fill(asked, model, chunk)
        return kept.attach(asked)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"_key": b["_key"], "answer": model(b["prompt"].tolist())})

    # Prompts meet their answers by key: the text moves once to be told apart, and with its rows only where it is read on.
    once = asked.filter("prompt IS NOT NULL").groupBy(prompt_key().alias("_key")).agg(F.first("prompt").alias("prompt"))
    got = once.mapInPandas(ask, "_key string, answer string")
    return asked.withColumn("_key", prompt_key()).join(got, "_key", "left").select(*asked.columns, "answer")


def _parsed(a: Column) -> list[Column]:
    """Decision, confidence and rationale; an unusable answer rejects with confidence 1."""
    decision, number = F.upper(F.trim(a["decision"])), a["confidence"].try_cast("int")
    ok = decision.isin("ACCEPT", "REJECT") & number.between(1, CONFIDENCE_MAX)
    good = F.coalesce(ok, F.lit(False))
    return [F.when(good, decision).otherwise("REJECT").alias("llm_decision"), (F.when(good, number).otherwise(1) / CONFIDENCE_MAX).alias("confidence"), F.when(good, a["rationale"]).alias("llm_rationale"), (~good).alias("unusable")]


def parse_pair(answers: DataFrame) -> DataFrame:
    """Adds decision, confidence (share of 5), rationale and ``unusable`` from ``answer``, one JSON object."""
    return answers.withColumn("a", F.from_json("answer", ANSWER)).select(*[c for c in answers.columns if c != "answer"], *_parsed(F.col("a")))


def parse_group(selected: DataFrame, answers: DataFrame) -> DataFrame:
    """Decisions of pass 2 by target id; of repeated ids the last counts, missing ones are rejected.

    Pairs and answers meet by their concept, the answers as they were given, and are told apart where they lie.
    """
    kind = selected.schema["sct_id"].dataType
    numbered = F.transform(F.from_json("answer", GROUP)["mappings"], lambda x, i: F.struct(x["sct_id"].try_cast(kind).alias("sct_id"), i.alias("pos"), x.alias("a")))
    got = answers.select("hpo_id", "answer").repartition("hpo_id").select("hpo_id", numbered.alias("m")).groupBy("hpo_id").agg(F.flatten(F.collect_list("m")).alias("m"))
    pair = F.struct(*selected.columns)
    every = selected.groupBy("hpo_id").agg(F.collect_list(pair).alias("s")).join(got, "hpo_id", "left")
    none = F.slice("s", 1, 0)
    asked = F.transform("s", lambda x: F.struct(x["sct_id"].alias("sct_id"), x.alias("s"), F.lit(None).cast("int").alias("pos"), F.lit(None).cast(_CANDIDATE).alias("a")))
    told = F.transform(F.filter("m", lambda y: y["sct_id"].isNotNull()), lambda y: F.struct(y["sct_id"].alias("sct_id"), F.get(none, F.lit(0)).alias("s"), y["pos"].alias("pos"), y["a"].alias("a")))
    met = every.select("hpo_id", F.explode(F.when(F.col("m").isNull(), asked).otherwise(F.concat(asked, told))).alias("x")).select("hpo_id", "x.*")
    met = met.groupBy(*PAIR).agg(F.collect_list("s").alias("s"), F.max_by("a", "pos").alias("a"))
    return met.select(F.explode("s").alias("s"), "a").select("s.*", *_parsed(F.col("a")))


def merge(coded: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Mapping rows plus one ``llm`` row (code 10) for each accepted pair; old rows stay as they are."""
    new = reviewed.filter("llm_decision = 'ACCEPT'").select(*PAIR, F.lit("llm").alias("attribute"), "confidence", F.lit(10).alias("validity"))
    return coded.unionByName(new, allowMissingColumns=True)


def summary(reviewed: DataFrame) -> DataFrame:
    """Reviewed, accepted and rejected pairs by pass, and over all passes (null)."""
    yes = F.col("llm_decision") == "ACCEPT"
    out = reviewed.rollup("llm_pass").agg(F.count(F.lit(1)).alias("n_reviewed"), F.count(F.when(yes, 1)).alias("n_accepted"), F.count(F.when(~yes, 1)).alias("n_rejected"))
    return out.withColumn("accepted_share", F.col("n_accepted") / F.col("n_reviewed"))


def gold_status(gold: DataFrame, source_ids: DataFrame, target_ids: DataFrame) -> DataFrame:
    """(hpo_id, sct_id, status): CHECKED, or which side isn't loaded; a missing source counts first."""
    h = source_ids.select(F.col("concept_id").alias("hpo_id"), F.lit(True).alias("h")).distinct()
    t = target_ids.select(F.col("concept_id").alias("sct_id"), F.lit(True).alias("t")).distinct()
    p = gold.select(*PAIR).distinct().join(h, "hpo_id", "left").join(t, "sct_id", "left")
    return p.select(*PAIR, F.when(F.col("h").isNull(), "HPO_NOT_FOUND").when(F.col("t").isNull(), "SCT_NOT_FOUND").otherwise("CHECKED").alias("status"))
