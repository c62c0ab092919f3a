import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import queries as plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", plans.ORACLE)
def test_oracle(spark, db, name):
    got = plans.QUERIES[name](spark, SF)
    want = db.sql(plans.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in got.columns]
    key = lambda rows: sorted((tuple(str(x) for x in r) for r in rows))
    assert key(tuple(r) for r in got.collect()) == key(tuple(r[i] for i in at) for r in want.fetchall())


def test_crc(spark):
    import zlib

    for r in plans.QUERIES["crc32_scalar"](spark, SF).collect():
        assert zlib.crc32(r.value.encode()) == r.checksum
