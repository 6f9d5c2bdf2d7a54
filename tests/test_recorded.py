"""Queries of recorded telemetry, scripts and rules against their SQL, on a few rows of each table."""

import datetime

import duckdb
import pytest

from covspark import recorded  # noqa: F401  registers its queries
from covspark.registry import ORACLE, QUERIES

KINDS = ["signup", "click", "purchase", "error", "view"]
LINES = ["the license of the token", "The los ding", "  the end", "no", "# the", "the der zzz license token and ing", ""]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    events = [(i, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=i), (i * i) % 7, KINDS[(i * 7 + i // 3) % 5]) for i in range(1200)]
    made = {
        "events": (events, "event_id long, ts timestamp, user_id long, event_type string"),
        "part": ([(i,) for i in range(60)], "p_partkey long"),
        "customer": ([(i, f"Customer#{i}") for i in range(5)], "c_custkey long, c_name string"),
        "nation": ([(i, f"NATION_{i}") for i in range(25)], "n_nationkey int, n_name string"),
        "documents": ([(i, "\n".join(LINES[i % 4 :]) if i % 5 else None) for i in range(12)], "doc_id long, text string"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


NAMES = [n for n in QUERIES if QUERIES[n].__module__ == recorded.__name__]


@pytest.mark.parametrize("name", NAMES)
def test_query_gives_the_rows_of_its_sql(spark, tables, name):
    con = duckdb.connect()
    for t in ("events", "part", "customer", "nation", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet/*.parquet'")
    df = QUERIES[name](spark, tables)
    columns = sorted(df.columns)
    got = sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect())))
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})").fetchall()
    assert got == sorted(map(repr, want)) and got


@pytest.mark.parametrize("name", ["audit_executions", "audit_alone"])
def test_audit_addresses_of_users_beyond_a_byte(spark, tmp_path, name):
    users = [3, 255, 256, 800, 1499, 65536, 89999]
    events = [(i, users[i // 2 % 7], ["signup", "click"][i % 2] if i % 3 else "click") for i in range(200)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(u, f"Customer#{u}") for u in users], "c_custkey long, c_name string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    for t in ("events", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE[name]})").fetchall()
    got = [tuple(r) for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and any("10.0.0.89999:443" in repr(r) for r in got)
