"""Every registered query against its DuckDB oracle."""

import math
import os

import duckdb
import pytest

from strideway.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{data}/{t}.parquet"
        if os.path.exists(path):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    clean = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 6) if isinstance(v,
        float) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, duck, name):
    df = catalog.QUERIES[name](spark, data)
    got = [tuple(r) for r in df.collect()]
    if name in catalog.ORACLES:
        want = duck.sql(catalog.ORACLES[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert canonical(df.columns, got) == canonical(want.columns, want.fetchall())


def test_flagship(spark, data):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "running" in df.columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("partitions", [1, 4, 37])
def test_results_do_not_follow_partitions(spark, data, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    names = ["canonical_order", "running_budget", "islands", "stratified_sample", "mask_verdict"]
    try:
        base = {n: sorted(map(tuple, catalog.QUERIES[n](spark, data).collect())) for n in names}
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        assert base == {n: sorted(map(tuple, catalog.QUERIES[n](spark, data).collect())) for n in names}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
