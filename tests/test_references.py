"""References are dealt to as many tasks as their number asks for."""

from pyspark.sql import functions as F

from lodestitch.operators import candidates


def test_references_are_dealt_before_they_are_distinct(spark, monkeypatch):
    monkeypatch.setattr(candidates, "_REFS_A_TASK", 100)
    refs = spark.range(1000).select((F.col("id") % 500).alias("concept_id"), (F.col("id") % 250).alias("ref"))
    found = candidates.xref_direct(refs, spark.range(200).withColumnRenamed("id", "concept_id"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(concept_id" in plan and plan.rindex("keys=[concept_id") < plan.index("hashpartitioning(concept_id") and ", 10), REPARTITION_BY_NUM" in plan
    assert found.count() == 400
