import duckdb
import pytest

from lodestitch.functions.text import semantic_tag, strip_tag
from lodestitch.plans import catalog

SF = "/root/testdata/sf0.001"


def rows(names, table):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in table), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "lineitem", "orders", "customer", "nation", "supplier", "events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, SF), con.execute(catalog.ORACLE_SQL[name])
    assert rows(got.columns, got.collect()) == rows([x[0] for x in want.description], want.fetchall())


def test_tags(spark):
    df = spark.createDataFrame([("Sore toe (disorder)",), ("Size (of the left shoe) (finding)",), ("none",)], "t string")
    assert [tuple(r) for r in df.select(semantic_tag("t"), strip_tag("t")).collect()] == [
        ("disorder", "Sore toe"), ("finding", "Size (of the left shoe)"), ("", "none"),
    ]
