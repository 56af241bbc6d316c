"""Every query with oracle SQL gives the rows that DuckDB gives; the others run."""

import os

import duckdb
import pytest

from brindle.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df):
    def plain(x):
        if x is None or x != x:
            return None
        if hasattr(x, "isoformat"):
            return x.isoformat()
        return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    import pandas as pd

    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    return sorted((tuple(None if x is pd.NaT else plain(x) for x in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLE_SQL:
        expected = duck.sql(catalog.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(expected.columns)
        assert rows(got) == rows(expected)
    else:
        assert len(got)


def test_whole_tables_match_brute_force(spark):
    """The queries over whole tables whose oracle SQL covers a subset of ids only."""
    import math

    table = lambda name: spark.read.parquet(f"{SF}/{name}.parquet").toPandas()
    run = lambda name: catalog.QUERIES[name](spark, SF).toPandas()
    part, orders, supplier = table("part"), table("orders"), table("supplier")

    p = {k: (k * 7919 % 1000 + 1) / 100000.0 for k in part.p_partkey if k % 10}
    expected, top = {}, 0.0
    for n, k in enumerate(sorted(p, key=lambda k: (p[k], k))):
        expected[k] = top = max(top, min(1.0, (len(p) - n) * p[k]))
    got = run("holm")
    assert len(got) == len(part) and {k for k, x in zip(got.p_partkey, got.p_holm) if x == x} == set(p)
    assert all(math.isclose(x, expected[k]) for k, x in zip(got.p_partkey, got.p_holm) if k in expected)

    late = orders.o_orderdate.astype("datetime64[ns]") >= "1999-07-01"
    early = set(orders.o_custkey[~late])
    expected = {o: "post" if x else "pre" for o, c, x in zip(orders.o_orderkey, orders.o_custkey, late) if not x or c not in early}
    got = run("temporal_split")
    assert len(got) == len(expected) and dict(zip(got.o_orderkey, got.period)) == expected

    raster = {}
    for k, v in zip(part.p_partkey, part.p_retailprice):
        at = (k % 100, k * 7 % 100)
        raster[at] = max(raster.get(at, v), v)
    got = {i: (level, source) for i, level, source in run("noise_levels")[["id", "level", "source"]].itertuples(index=False)}
    assert set(got) == set(supplier.s_suppkey)
    for i in supplier.s_suppkey:
        east, north = i * 7919 % 1000, i * 104729 % 1000
        for h in (0, 10, 20, 50, None):
            if h is None:
                assert got[i][1] == "quiet"
                break
            cells = [v for (c, w), v in raster.items() if (east - h) // 10 <= c <= (east + h) // 10 and (1000 - north - h) // 10 <= w <= (1000 - north + h) // 10]
            if cells:
                assert got[i] == (max(cells), "point" if h == 0 else "facade" if h <= 20 else "fallback")
                break

    listed = table("lineitem").merge(supplier, left_on="l_suppkey", right_on="s_suppkey").merge(table("nation"), left_on="s_nationkey", right_on="n_nationkey").merge(table("region"), left_on="n_regionkey", right_on="r_regionkey")
    listed["y"] = [math.log(float(x)) for x in listed.l_extendedprice]
    columns, sums = ["r_name", "s_nationkey", "l_suppkey"], {}
    mean = listed.y.mean()
    for depth in (1, 2, 3):
        for key, y in listed.groupby(columns[:depth]).y:
            key = key if isinstance(key, tuple) else (key,)
            sums[key] = (y.sum() + 20 * sums.get(key[:-1], mean)) / (len(y) + 20)
    expected = {"/".join(map(str, k)): v for k, v in sums.items() if len(k) == 3}
    got = run("target_encode_full")
    assert set(got.k) == set(expected) and all(abs(expected[k] - x) < 2e-6 for k, x in zip(got.k, got.te))
