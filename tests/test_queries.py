"""Every query of the library against its SQL in DuckDB."""

import glob
import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from gutterline.plans import decode_queries, extra_queries, layout_queries, lift_queries, more_queries, name_queries, raster_queries, source_queries, timeline_queries  # noqa: E402,F401
from gutterline.plans.registry import ORACLES, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        connection.sql(f"create view {os.path.basename(path).removesuffix('.parquet')} as select * from '{source}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(value)
    return value


def canonical(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, sf, duck, name):
    ours = QUERIES[name](spark, sf)
    theirs = duck.sql(ORACLES[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert canonical(ours.select(*columns).collect()) == canonical(theirs.project(", ".join(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
