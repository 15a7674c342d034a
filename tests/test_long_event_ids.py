"""Events whose numbers have more than six digits."""

import duckdb
import pytest
from pyspark.sql import functions as F

from latticework.functions import values as V
from latticework.operators import events
from latticework.operators.graph import has_label
from latticework.plans import catalog
from latticework.sources import tables as T

NUMBERS = [0, 7, 99_999, 100_000, 100_001, 999_999, 1_000_000, 1_000_001, 1_000_014, 1_000_015, 1_000_016, 10_000_000]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A table of events, two at each second; numbers that are alike in their first six digits among them."""
    d = tmp_path_factory.mktemp("long-ids")
    rows = ", ".join(f"({n}, {i // 2}, {i % 3})" for i, n in enumerate(NUMBERS))
    duckdb.sql(f"COPY (SELECT CAST(n AS BIGINT) AS event_id, TIMESTAMP '2024-01-01' + to_seconds(s) AS ts, CAST(u AS BIGINT) AS user_id, 'click' AS event_type FROM (VALUES {rows}) t(n, s, u)) TO '{d}/events.parquet'")
    return str(d)


def test_graph_and_next_id_keep_every_digit(spark, folder):
    nodes = T.event_graph(spark, folder).nodes
    names = {r[0] for r in nodes.filter(has_label(["Event"])).select(V.prop_str("event_id")).collect()}
    assert names == {f"event:{n:06d}" for n in NUMBERS}
    assert events.next_event_id(nodes).first()["event_id"] == "event:10000001"


@pytest.mark.parametrize("name", ["append_events_batch", "next_event_id", "events_ordered"])
def test_as_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    found = catalog.queries()[name](spark, folder)
    wanted = con.sql(catalog.oracle_sql()[name])
    assert sorted(map(tuple, found.select(*wanted.columns).collect())) == sorted(wanted.fetchall())


def test_name_of_a_number(spark):
    named = spark.sql("SELECT stack(3, 5L, 1234567L, NULL) AS n").select(events.event_name(F.col("n"))).collect()
    assert [r[0] for r in named] == ["event:000005", "event:1234567", None]
