"""Reversals are found without putting all pairs of a parent to all pairs of its children."""

from lodestitch.operators import reports

from test_sizes import shuffled


def test_reversals_meet_by_target(spark):
    table = lambda rows, columns: spark.createDataFrame(rows, columns)
    source = table([("h0", f"h{i}") for i in range(1, 1001)], "parent string, child string")
    target = table([("s0", "s1")], "parent string, child string")
    pairs = table([(f"h{i}", "s0") for i in range(1, 1001)] + [("h0", f"s{i}") for i in range(1, 1001)], "hpo_id string, sct_id string")
    with shuffled(spark, 3_000_000):
        got = reports.structure({"x": pairs}, source, target)["reversals"].collect()
    assert {tuple(r) for r in got} == {("x", "h0", f"h{i}", "s1", "s0") for i in range(1, 1001)} and len(got) == 1000
