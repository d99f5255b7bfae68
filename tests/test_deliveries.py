"""Profile state of deliveries: merged states equal one profile, sketches within their errors."""

import bisect
import math
import statistics

import pytest

from plumbline.operators import deliveries
from plumbline.sources.state import small_table

SCHEMA = "id bigint, x double, name string, day date"


def test_ten_deliveries_equal_one_profile(spark, tmp_path):
    # A third of all rows has one value; the deliveries differ much in size and mean.
    whole = spark.range(40_000).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 7.0D WHEN id % 11 = 0 THEN NULL WHEN id % 13 = 0 THEN double('NaN') ELSE sqrt(id) * 1e3 END AS x",
        "CASE WHEN id % 5 > 0 THEN concat('n', id % 9000) END AS name", "date_add(DATE '2024-01-01', int(id % 400)) AS day")
    for i in range(10):
        low, high = 400 * i * i, 400 * (i + 1) * (i + 1)
        deliveries.save_delivery(whole.filter(f"id >= {low} AND id < {high}"), f"{tmp_path}/d", f"d{i}")
    found = {r["column"]: r for r in deliveries.merged_profile(spark, f"{tmp_path}/d").collect()}
    rows = whole.collect()
    xs = sorted(r.x for r in rows if r.x is not None and not math.isnan(r.x))
    x = found["x"]
    assert (x.deliveries, x.row_count, x.non_null_count, x.null_count) == (10, 40_000, len(xs), 40_000 - len(xs))
    assert (x.min, x.max) == (xs[0], xs[-1])
    assert x.mean == pytest.approx(statistics.fmean(xs)) and x.std_dev == pytest.approx(statistics.stdev(xs))
    for q, value in ((0.25, x.p25), (0.5, x.median), (0.75, x.p75)):
        low, high = bisect.bisect_left(xs, value) / len(xs), bisect.bisect_right(xs, value) / len(xs)
        assert low - 0.01 <= q <= high + 0.01
    for name in ("id", "x", "name", "day"):
        exact = len({r[name] for r in rows if r[name] is not None and r[name] == r[name]})
        assert found[name].distinct == pytest.approx(exact, rel=0.04), name
    assert found["day"].earliest.date() == min(r.day for r in rows) and found["name"].median is None
    assert (found["name"].min_length, found["name"].max_length) == (2, 5)


def test_a_delivery_stored_again_replaces_and_odd_deliveries_count(spark, tmp_path):
    folder = f"{tmp_path}/d"
    assert deliveries.merged_profile(spark, folder).collect() == []
    one = small_table(spark, [(1, 1.0, "a", None), (2, None, None, None)], SCHEMA)
    deliveries.save_delivery(one, folder, "mon")
    deliveries.save_delivery(one.limit(0), folder, "tue")
    deliveries.save_delivery(one.filter("id = 1").selectExpr("string(id) AS id", "1 AS `a.b`"), folder, "wed")
    deliveries.save_delivery(one.union(one), folder, "mon")
    # State whose writing broke off has no row in the list.
    deliveries.delivery_state(one).write.parquet(f"{folder}/state/broken")
    found = {r["column"]: r for r in deliveries.merged_profile(spark, folder).collect()}
    assert (found["id"].row_count, found["id"].data_types, found["id"].distinct) == (5, "bigint, string", 2)
    assert (found["x"].row_count, found["x"].null_count, found["x"].median, found["x"].std_dev) == (4, 2, 1.0, 0.0)
    assert found["day"].earliest is None and found["day"].distinct == 0 and found["a.b"].row_count == 1
    only = {r["column"]: r for r in deliveries.merged_profile(spark, folder, ["tue"]).collect()}
    assert only["x"].row_count == 0 and only["x"].median is None and only["x"].mean is None
    with pytest.raises(ValueError, match="no stored delivery sun"):
        deliveries.merged_profile(spark, folder, ["sun"])
