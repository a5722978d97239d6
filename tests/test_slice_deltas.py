"""Differences at the threshold are those of sums by event_id, as one thread of the SQL makes them, and an unknown member counts where it is known."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.operators import analysis
from lodestone.plans import code_queries  # noqa: F401  registers its queries
from lodestone.plans.queries import QUERIES, SQL

#: Means differ by 2 exactly; sums of doubles in this order put the difference above 0.02 or not, where exact sums do otherwise.
AT_THRESHOLD = [([74.49, 52.75, 81.34, 77.62], [18.7, 3.87, 51.11, 220.52]), ([73.13, 27.52, 89.35, 58.48], [80.41, 68.8, 19.95, 87.32]), ([63.76, 94.92, 69.77, 66.39], [55.05, 95.75, 11.09, 140.95])]


@pytest.mark.parametrize("users, parts", [([7, 8, 9], 1), ([7, 8, 9], 3), ([-1, 8, 9], 1)])
def test_equals_sql_by_one_thread(spark, tmp_path, users, parts):
    values = [(user, mode, v) for user, both in zip(users, AT_THRESHOLD) for mode, vs in zip(("view", "purchase"), both) for v in vs] + [(8, "view", None), (5, "view", 1.0), (None, "view", 2.0)]
    rows = [(i, user, mode, v, f'{{"k": {i % 7}}}') for i, (user, mode, v) in enumerate(values)]
    made = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string")
    made.coalesce(1).write.parquet(f"{tmp_path}/one")
    made.orderBy(F.desc("event_id")).repartition(parts).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute("set threads = 1")
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/one/*.parquet') order by event_id")
    want = sorted(con.execute(SQL["slice_deltas"]).fetchall())
    assert sorted(tuple(r) for r in QUERIES["slice_deltas"](spark, str(tmp_path)).collect()) == want
    assert {r[0]: r[1] for r in want} == {"view": 3 + (-1 in users), "purchase": 3}


def test_means_by_order(spark):
    rows = spark.createDataFrame([(i, "a", v, None) for i, v in enumerate([1e16, 1.0, -1e16, None])] + [(9, "b", None, 1.0)], "i int, g string, x double, y double").repartition(3)
    assert {r["g"]: (r["x"], r["y"]) for r in analysis.ordered_means(rows, ["g"], "i", ["x", "y"]).collect()} == {"a": (0.0, None), "b": (None, 1.0)}
