"""Session queries against their SQL on prices of zero, single bars and ranks that end in a half."""
from datetime import datetime, timedelta

import duckdb
import pytest

from sparkpanel.catalog import ORACLES, REGISTRY

FIRST = datetime(2024, 3, 4)


def tick(user, day, hour, minute, price):
    return FIRST + timedelta(days=day, hours=hour, minutes=minute), user, "click", price, '{"k": 2}'


def both(spark, folder, ticks, name):
    """Rows of the query and of its SQL, as text."""
    rows = [(i, *t) for i, t in enumerate(ticks)]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
    df.coalesce(1).write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    want = con.sql(ORACLES[name])
    got = REGISTRY[name](spark, str(folder)).select(*want.columns).collect()
    return sorted(map(str, map(tuple, got))), sorted(map(str, want.fetchall()))


ODD = [
    tick(1, 0, 10, 0, 0.0), tick(1, 0, 10, 30, 3.29), tick(1, 0, 11, 0, 4.12),  # a bucket closes at zero
    tick(2, 0, 10, 0, 5.5), tick(2, 0, 20, 0, 0.0),  # the day closes at zero
    tick(3, 0, 10, 0, 0.0), tick(3, 0, 10, 1, 0.0),  # nothing but zeros
    tick(4, 0, 10, 0, 7.25),  # one bar
    tick(5, 0, 10, 0, 2.0), tick(5, 0, 12, 0, 2.5), tick(5, 0, 20, 0, 2.25),
    tick(5, 1, 10, 0, 2.0), tick(5, 1, 12, 0, 0.0), tick(6, 1, 10, 0, 0.0), tick(6, 1, 20, 0, 3.0),
]


@pytest.mark.parametrize("name", ["session_trend", "session_features_by_user", "session_feature_join", "intraday_feature_panel"])
def test_zero_prices(spark, tmp_path, name):
    got, want = both(spark, tmp_path, ODD, name)
    assert got == want


def test_ranks_that_end_in_a_half(spark, tmp_path):
    ticks = [t for u in range(640) for t in (tick(u, 0, 10, 0, 100.0 + u), tick(u, 0, 20, 0, 100.0))]
    got, want = both(spark, tmp_path, ticks, "intraday_feature_panel")
    assert got == want
