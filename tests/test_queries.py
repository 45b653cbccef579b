"""Queries against their SQL in DuckDB, as multisets of rows."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def cell(x):
    return round(x, 6) if isinstance(x, float) and not math.isnan(x) else x


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    a = Counter(tuple(cell(r[c]) for c in columns) for r in got.collect())
    b = Counter(tuple(cell(r[want.columns.index(c)]) for c in columns) for r in want.fetchall())
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])
    assert a


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n.startswith("q") and n not in entry.oracle_sql()))
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


@pytest.fixture(scope="module")
def wide(duck, tmp_path_factory):
    """A copy of the tables whose users' identifiers have five hexadecimal digits, some of them alike in four."""
    folder = tmp_path_factory.mktemp("wide")
    for t in TABLES:
        if t != "events":
            (folder / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    duck.sql(f"copy (select * replace (user_id + case when event_id % 3 = 0 then 0 else 70000 end as user_id) from events) to '{folder}/events.parquet' (format parquet)")
    return str(folder)


def equals_sql_on(spark, folder, name):
    c = duckdb.connect()
    c.sql(f"create view events as select * from '{folder}/events.parquet'")
    got, want = entry.queries()[name](spark, folder), c.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert Counter(tuple(cell(r[c]) for c in columns) for r in got.collect()) == Counter(tuple(cell(r[want.columns.index(c)]) for c in columns) for r in want.fetchall())


@pytest.mark.parametrize("name", ["q59_device_fields", "q60_device_places", "q61_device_summary", "q62_device_phy"])
def test_wide_identifiers_in_device_logs(spark, wide, name):
    equals_sql_on(spark, wide, name)


@pytest.mark.parametrize("name", ["q65_radio_console", "q66_radio_table"])
def test_wide_identifiers_in_printed_tables(spark, wide, name):
    equals_sql_on(spark, wide, name)
