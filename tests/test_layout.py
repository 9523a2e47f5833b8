"""Releases through to the inputs of a run: snapshots, layouts, commits and contracts."""

import itertools

import pytest

from lodestitch.sources import layout, releases
from lodestitch.sources.terminology import entry_of, sources_of

FSN, SYN, DEF = releases.FULL_NAME, releases.SYNONYM, releases.DEFINITION
IS_A, STATED, INFERRED = releases.IS_A, releases.STATED, "900000000000011006"


def file(tmp_path, name, rows, sep="\t", header=None, end=""):
    p = tmp_path / name
    p.write_text("".join(sep.join(r) + end + "\n" for r in ([header.split()] if header else []) + rows))
    return str(p)


@pytest.fixture
def versioned(tmp_path):
    v = releases.VERSIONED
    concept = [["10", "20200101", "1", "m", "d"], ["10", "20210101", "1", "m", "d2"], ["11", "20200101", "1", "m", "d"], ["12", "20200101", "1", "m", "d"], ["12", "20220101", "0", "m", "d"], ["13", "20230101", "1", "m", "d"]]
    text = lambda i, t, a, c, k, term: [i, t, a, "m", c, "en", k, term, "ci"]
    description = [text("1", "20200101", "1", "10", FSN, 'Old "name" (finding)'), text("1", "20210101", "1", "10", FSN, 'Alpha "sign" (finding)'), text("2", "20200101", "1", "10", SYN, "Sign of alpha"), text("2", "20210601", "0", "10", SYN, "Sign of alpha"),
                   text("3", "20200101", "1", "11", FSN, "Parent (finding)"), text("4", "20200101", "1", "12", FSN, "Gone (finding)"), text("5", "20230101", "1", "13", FSN, "Late (finding)"), text("6", "20200101", "1", "10", "99", "other kind")]
    definition = [text("7", "20200101", "1", "10", DEF, "What alpha is."), text("8", "20200101", "1", "12", DEF, "of a dead one")]
    rel = lambda i, t, a, s, d, k, c: [i, t, a, "m", s, d, "0", k, c, "x"]
    relationship = [rel("1", "20200101", "1", "10", "11", IS_A, INFERRED), rel("2", "20200101", "1", "12", "11", IS_A, INFERRED), rel("3", "20200101", "1", "13", "10", IS_A, STATED), rel("4", "20200101", "1", "10", "11", "77", INFERRED), rel("5", "20200101", "1", "11", "10", IS_A, INFERRED), rel("5", "20210101", "0", "11", "10", IS_A, INFERRED)]
    mapped = [["1", "20200101", "1", "m", "s2", "10", "X.1"], ["2", "20200101", "1", "m", "s1", "10", "X.1"], ["3", "20200101", "1", "m", "s1", "12", "X.2"]]
    return {k: file(tmp_path, f"{k}.txt", x, header=v[k]) for k, x in (("concept", concept), ("description", description), ("definition", definition), ("relationship", relationship), ("map", mapped))}


def test_versioned_release(spark, versioned):
    S = "SNOMEDCT_US:"
    rows = releases.read_versioned(spark, versioned)
    want = {(S + "10", "label", 'Alpha "sign" (finding)', None), (S + "11", "label", "Parent (finding)", None), (S + "13", "label", "Late (finding)", None), (S + "10", "definition", "What alpha is.", None), (S + "11", "children", S + "10", None), (S + "10", "reference", "X.1", "{'source': 's1, s2'}")}
    got = [tuple(r) for r in rows.collect()]
    assert len(got) == len(want) and set(got) == want
    assert [r[0] for r in rows.filter("attribute = 'reference'").select(sources_of("additional")).collect()] == [["s1", "s2"]]
    old = {tuple(r)[:3] for r in releases.read_versioned(spark, versioned, as_of="20200101").collect()}
    assert {(S + "10", "label", 'Old "name" (finding)'), (S + "10", "synonym", "Sign of alpha"), (S + "12", "label", "Gone (finding)"), (S + "11", "children", S + "12"), (S + "10", "children", S + "11")} < old
    assert not any(c == S + "13" for c, *_ in old)


def test_snapshot_doesnt_depend_on_order(spark):
    rows = [("1", "20200101", "1", "a"), ("1", "20200101", "1", "b"), ("1", "20190101", "0", "z"), (None, "20200101", "1", "n")]
    for r in itertools.permutations(rows):
        assert [x.v for x in releases.snapshot(spark.createDataFrame(list(r), "id string, effectiveTime string, active string, v string").coalesce(1)).collect()] == ["b"]


def test_wrong_files_are_named(spark, versioned, tmp_path):
    with pytest.raises(FileNotFoundError, match="gone.txt"):
        releases.read_versioned(spark, versioned | {"map": str(tmp_path / "gone.txt")})
    with pytest.raises(ValueError, match="no concept file: it lacks definitionStatusId"):
        releases.read_versioned(spark, versioned | {"concept": versioned["map"]})


def test_rich_release(spark, tmp_path):
    def atom(cui, sab, tty, code, text, lat="ENG", ts="P", stt="PF", pref="Y", suppress="N"):
        return [cui, lat, ts, "L", stt, "S", pref, "A", "", "", "", sab, tty, code, text, "0", suppress, ""]

    conso = [atom("C1", "SNOMEDCT_US", "PT", "10", "Alpha sign"), atom("C1", "HPO", "PT", "HP:1", "Alpha", ts="S"), atom("C1", "SNOMEDCT_VET", "SY", "10", "Alpha sign"), atom("C1", "X", "PT", "5", "Alfa", lat="SPA"), atom("C1", "X", "PT", "6", "Bad", suppress="O"), atom("C2", "X", "PT", "", "Beta")]
    rel = lambda a, k, b, s="N": [a, "", "", k, b, "", "", "", "", "", "X", "X", "", "", s, ""]
    paths = {
        "MRCONSO": file(tmp_path, "MRCONSO.RRF", conso, "|", end="|"),
        "MRDEF": file(tmp_path, "MRDEF.RRF", [["C1", "A", "AT", "", "X", 'It is "so"', "N", ""], ["C1", "A", "AT", "", "X", "old", "O", ""]], "|", end="|"),
        "MRREL": file(tmp_path, "MRREL.RRF", [rel("C1", "CHD", "C2"), rel("C2", "PAR", "C1"), rel("C1", "RO", "C3"), rel("C1", "CHD", "C9", "O"), rel("C1", "CHD", "C1")], "|", end="|"),
        "MRSTY": file(tmp_path, "MRSTY.RRF", [["C1", "T1", "A1", "Finding", "AT", ""]], "|", end="|"),
        "MRRANK": file(tmp_path, "MRRANK.RRF", [["0300", "HPO", "PT", "N"], ["0200", "SNOMEDCT_US", "PT", "N"], ["0100", "SNOMEDCT_VET", "SY", "N"]], "|", end="|"),
    }
    U = "UMLS:"
    want = {(U + "C1", "label", "Alpha", "{'source': 'HPO'}"), (U + "C1", "synonym", "Alpha sign", "{'source': 'SNOMEDCT_US, SNOMEDCT_VET'}"), (U + "C2", "label", "Beta", "{'source': 'X'}"),
            (U + "C1", "reference", "10", "{'source': 'SNOMEDCT_US, SNOMEDCT_VET'}"), (U + "C1", "reference", "HP:1", "{'source': 'HPO'}"), (U + "C1", "reference", "5", "{'source': 'X'}"),
            (U + "C1", "definition", 'It is "so"', None), (U + "C1", "children", U + "C2", None), (U + "C1", "semantic", "Finding", None)}
    got = [tuple(r) for r in releases.read_rich(spark, paths).collect()]
    assert len(got) == len(want) and set(got) == want
    unranked = {tuple(r)[:3] for r in releases.read_rich(spark, {"MRCONSO": paths["MRCONSO"]}).collect()}
    assert (U + "C1", "label", "Alpha sign") in unranked and (U + "C1", "synonym", "Alpha") in unranked
    assert spark.createDataFrame([("{'source': 'a, b'}",)], "x string").select(entry_of("x", "source")).first()[0] == "a, b"


def eav(spark, n=200):
    rows = [(f"C{i}", a, f"{a} {i}", None) for i in range(n) for a in ("label", "synonym", "children")]
    return spark.createDataFrame(rows, "concept_id string, attribute string, value string, additional string")


def files_read(df):
    """Files that the scan of a collected DataFrame read, by Spark's own metric."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().apply("numFiles").value()


def test_attribute_filters_read_fewer_files(spark, tmp_path):
    t = layout.TerminologyTable(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError, match="no committed"):
        t.read()
    t.write(eav(spark))
    assert t.counts() == {"": {"rows": 600, "concepts": 200}, **{a: {"rows": 200, "concepts": 200} for a in ("label", "synonym", "children")}}
    every, labels = files_read(t.read()), files_read(t.read().filter("attribute = 'label'"))
    assert 0 < labels < every and t.read().filter("attribute = 'label'").count() == 200
    assert sorted(t.read().collect()) == sorted(eav(spark).collect())


def test_lost_loads_are_written_anew(spark, tmp_path):
    path = str(tmp_path / "t")
    made = []

    def load():
        made.append(1)
        return eav(spark, 5)

    (tmp_path / "t" / "load=lost" / "attribute=label").mkdir(parents=True)
    (tmp_path / "t" / "load=lost" / "attribute=label" / "part-0.parquet").write_text("half a file")
    assert layout.load_terminology(spark, path, load).read().count() == 15 and len(made) == 1
    assert layout.load_terminology(spark, path, load).read().count() == 15 and len(made) == 1
    layout.load_terminology(spark, path, load, skip_if_present=False)
    assert len(made) == 2 and len(list((tmp_path / "t").glob("load=*"))) == 1
    with pytest.raises(ValueError, match="nothing loaded"):
        layout.load_terminology(spark, path, lambda: eav(spark, 0), skip_if_present=False)
    assert layout.TerminologyTable(spark, path).read().count() == 15


def test_inputs_of_a_run(spark, versioned, tmp_path):
    source = spark.createDataFrame([("HP:1", "label", "Alpha sign", None), ("HP:1", "synonym", "B", "{'class': 'related'}"), ("MP:1", "label", "mouse", None)], "concept_id string, attribute string, value string, additional string")
    loaders = {"source": lambda: source, "target": lambda: releases.read_versioned(spark, versioned), "bridge": lambda: eav(spark, 3)}
    gold = tmp_path / "gold.csv"
    with pytest.raises(FileNotFoundError, match="gold.csv, .*filtered"):
        layout.load_inputs(spark, str(tmp_path / "in"), loaders, str(gold), (str(tmp_path / "filtered"),))
    assert not (tmp_path / "in").exists()
    gold.write_text("HP_ID;Match group;SNOMED term/exp\nHP:1;One to one match;10 |Alpha|\nHP:2;No match;11\n")
    got = layout.load_inputs(spark, str(tmp_path / "in"), loaders, str(gold))
    assert [r.value for r in got.source.collect()] == ["Alpha sign"] and [tuple(r) for r in got.gold.collect()] == [("HP:1", "SNOMEDCT_US:10")]
    counts = {(r.terminology, r.attribute): (r.n_rows, r.n_concepts) for r in got.counts.collect()}
    assert counts["source", None] == (3, 2) and counts["target", "label"] == (3, 3) and counts["bridge", None] == (9, 3)


def test_contracts(spark, tmp_path):
    path = str(tmp_path / "filtered")
    good = spark.createDataFrame([("h", "s", "jaccard", 0.95, 10, "2", "more"), ("h", "t", "llm", None, None, None, "x")], layout.FILTERED + ", extra string")
    layout.write_stage(good, path, layout.FILTERED)
    assert layout.read_stage(spark, path, layout.FILTERED).dtypes == [("hpo_id", "string"), ("sct_id", "string"), ("attribute", "string"), ("confidence", "double"), ("validity", "int"), ("step", "string")]
    csv = str(tmp_path / "csv")
    layout.write_stage(good, csv, layout.FILTERED, csv=True)
    back = layout.read_stage(spark, csv, layout.FILTERED, csv=True)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, good.drop("extra").collect())) and "2" in {r.step for r in back.collect()}
    with pytest.raises(layout.SchemaError, match="lacks n_sct, llm_pass"):
        layout.read_stage(spark, path, layout.REVIEW)
    with pytest.raises(layout.SchemaError, match="confidence is date"):
        layout.write_stage(good.selectExpr("* EXCEPT (confidence)", "current_date() AS confidence"), path, layout.FILTERED)
    odd = tmp_path / "odd.csv"
    odd.write_text("hpo_id;sct_id;attribute;confidence;validity;step\nh;s;m;1;10.0;2\nh;t;m;;;\n")
    assert [(r.validity, r.step, r.confidence) for r in layout.read_stage(spark, str(odd), layout.FILTERED, csv=True).collect()] == [(10, "2", 1.0), (None, None, None)]
    odd.write_text("hpo_id;sct_id;attribute;confidence;validity;step\nh;s;m;1;ten;2\n")
    with pytest.raises(Exception, match="validity holds ten"):
        layout.read_stage(spark, str(odd), layout.FILTERED, csv=True).collect()
    with pytest.raises(FileNotFoundError):
        layout.read_stage(spark, str(tmp_path / "gone"), layout.REVIEW)
    none = layout.read_optional(spark, str(tmp_path / "gone"), layout.REVIEW)
    assert none.count() == 0 and none.columns[3] == "n_sct" and layout.read_optional(spark, path, layout.FILTERED).count() == 2
