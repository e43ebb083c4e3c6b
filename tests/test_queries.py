"""The registry: coverage of the operators, the flagship query, and a sample against DuckDB."""

import math

import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
IDS = (
    [f"a{i}" for i in range(1, 15)] + [f"b{i}" for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 12, 13, 14)]
    + [f"c{i}" for i in range(1, 21)] + [f"d{i}" for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 13)]
    + [f"e{i}" for i in range(1, 12)] + [f"f{i}" for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 13, 14)]
    + ["g1", "g2", "g2b", "g2c", "g3", "g4", "g4b", "g5", "g6", "g7", "g8", "g9", "g10", "g12", "g13", "g14", "g15"]
    + [f"h{i}" for i in (*range(1, 16), 17, 18)] + [f"i{i}" for i in (1, 2, 3, 4, 5, 6, 7, 9, 10)] + ["l1", "l2"]
)
SAMPLE = [
    "b5_leading_axes", "c1_decode", "c10_decode_time", "e8_diff", "g2_time_mean", "g7_histogram", "g10_block_means",
    "f13_reorder_longitude", "h9_aerosol_qualifiers", "a5_chunk_references",
]


def test_every_operator_has_a_query_and_its_sql():
    names, sql = entry_module.queries(), entry_module.oracle_sql()
    have = {n.split("_")[0] for n in names}
    assert [i for i in IDS if i not in have] == []
    assert set(sql) <= set(names)
    # only the training-data queries may lack SQL
    assert [n for n in set(names) - set(sql) if not n.startswith("op") and n != "pipeline"] == []


def test_flagship(spark):
    assert entry_module.entry(spark).limit(1).count() == 1


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return str([canon(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in ("part", "lineitem", "orders", "events", "customer", "supplier", "nation"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = db.execute(entry_module.oracle_sql()[name])
    columns = sorted(d[0] for d in cur.description)
    at = [[d[0] for d in cur.description].index(c) for c in columns]
    want = sorted(tuple(canon(r[i]) for i in at) for r in cur.fetchall())
    df = entry_module.queries()[name](spark, SF)
    assert sorted(df.columns) == columns
    assert sorted(tuple(canon(r[c]) for c in columns) for r in df.collect()) == want
