"""Nulls, outliers, types, nearest donors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import kernels, text
from plumbline.operators import neighbors, nulls, outliers, types
from plumbline.params import NullParams, OutlierParams, TypeParams


@pytest.mark.parametrize("value,wanted", [
    ("12", 12.0), (" -1.5 ", -1.5), ("1e3", 1000.0), (".5", 0.5), ("5.", 5.0), ("1_000", None), ("inf", math.inf),
    ("nan", None), ("1d", None), ("1__0", None), ("", None), ("x", None), (None, None)])
def test_to_number(spark, value, wanted):
    df = spark.createDataFrame([(value,)], "t string")
    assert df.select(text.to_number(F.col("t")).alias("x")).first()["x"] == wanted


@pytest.mark.parametrize("value,wanted", [
    ("2024-02-29", "2024-02-29 00:00:00"), ("2023-02-29", None), ("2024/01/05", "2024-01-05 00:00:00"),
    ("12/31/2020", "2020-12-31 00:00:00"), ("31/12/2020", None), ("12-31-2020", "2020-12-31 00:00:00"),
    ("2024-01-05T10:11:12Z", "2024-01-05 10:11:12"), ("2024-01-05 10:11", "2024-01-05 10:11:00"), ("2024", None), ("soon", None)])
def test_to_timestamp(spark, value, wanted):
    df = spark.createDataFrame([(value,)], "t string")
    found = df.select(F.date_format(text.to_timestamp(F.col("t")), "yyyy-MM-dd HH:mm:ss").alias("x")).first()["x"]
    assert found == wanted


def test_mask(spark):
    df = spark.createDataFrame([("abcd",), ("abc",), ("",)], "t string")
    assert [r["m"] for r in df.select(text.mask(F.col("t")).alias("m")).collect()] == ["abc***", "***", "***"]


@pytest.fixture(scope="module")
def sparse(spark):
    rows = [(1, 10.0, "a", None, 1), (2, None, "a", "2024-01-01", 2), (3, 30.0, None, None, None), (4, 100.0, "b", "2024-01-02", 4)]
    return spark.createDataFrame(rows, "id int, x double, t string, d string, n int")


def test_each_strategy(sparse):
    p = NullParams(strategies={"x": "median", "t": "mode", "d": "backward_fill", "n": "constant"}, fill_values={"n": -1})
    found = nulls.handle_nulls(sparse, "id", p)
    got = {r["id"]: r for r in found.table.collect()}
    assert got[2]["x"] == 30.0 and got[3]["t"] == "a" and got[3]["n"] == -1
    assert got[1]["d"] == "2024-01-01" and got[3]["d"] == "2024-01-02"
    scores = {r["component"]: r for r in found.scores.collect()}
    assert scores["overall"]["score"] == 100 and scores["overall"]["status"] == "Fully Cleaned"
    assert {(r["column"], r["cells_changed"]) for r in found.actions.collect()} == {("x", 1), ("t", 1), ("d", 2), ("n", 1)}


def test_default_run_changes_nothing(sparse):
    found = nulls.handle_nulls(sparse, "id")
    assert found.actions.count() == 0 and found.table.filter("x is null").count() == 1
    overall = found.scores.filter("component = 'overall'").first()
    assert overall["score"] == 50 and overall["status"] == "Needs More Cleaning"


def test_mean_applies_to_numbers_only(sparse):
    table, _ = nulls.apply_strategies(sparse, {"t": "mean", "x": "mean", "absent": "mode"}, "id")
    assert table.filter("t is null").count() == 1 and table.filter("x is null").count() == 0


def test_mode_takes_the_smallest_on_ties(spark):
    df = spark.createDataFrame([(2.0,), (10.0,), (10.0,), (2.0,), (None,)], "x double")
    assert nulls.mode_of(df, "x") == 2.0


def test_drop_rows_and_drop_column(sparse):
    dropped = nulls.handle_nulls(sparse, "id", NullParams(drop_rows=True))
    assert dropped.table.count() == 1 and dropped.actions.first()["cells_changed"] == 3
    without = nulls.handle_nulls(sparse, "id", NullParams(strategies={"d": "drop_column"}))
    assert "d" not in without.table.columns


def _brute_force(rows, k):
    """Mean of the k nearest donors by scaled Euclidean distance."""
    grid = np.array([[np.nan if v is None else v for v in r[1:]] for r in rows], dtype=float)
    out = {}
    for i, r in enumerate(rows):
        if r[1] is not None:
            continue
        near = []
        for j, other in enumerate(rows):
            if other[1] is None:
                continue
            gap = grid[i] - grid[j]
            known = ~np.isnan(gap)
            if known.any():
                near.append((math.sqrt(grid.shape[1] / known.sum() * (gap[known] ** 2).sum()), j))
        out[r[0]] = np.mean([rows[j][1] for _, j in sorted(near)[:k]]) if near else None
    return out


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("block_rows", [1000, 17])
def test_nearest_donors_equal_brute_force(spark, hot, block_rows):
    rng = random.Random(11)
    rows = []
    for i in range(220):
        x = 5.0 if hot and i % 3 == 0 else rng.uniform(0, 40)
        rows.append((i, None if i % 6 == 0 else rng.uniform(0, 9), x, None if rng.random() < 0.3 else rng.uniform(0, 10)))
    df = spark.createDataFrame(rows, "id int, y double, x double, z double")
    filled = neighbors.knn_fill(df, "y", "id", 4, ["y", "x", "z"], block_rows=block_rows, chunk_rows=7)
    wanted = _brute_force(rows, 4)
    found = {r["id"]: r["y"] for r in filled.collect()}
    for i, v in wanted.items():
        assert found[i] == pytest.approx(v)
    assert all(found[r[0]] == r[1] for r in rows if r[1] is not None)


def test_nearest_donors_when_the_axis_has_nulls(spark):
    rng = random.Random(2)
    rows = [(i, None if i % 5 == 0 else float(i % 9), None if rng.random() < 0.4 else rng.uniform(0, 9), None if rng.random() < 0.4 else rng.uniform(0, 9))
            for i in range(120)]
    df = spark.createDataFrame(rows, "id int, y double, x double, z double")
    filled = neighbors.knn_fill(df, "y", "id", 3, ["y", "x", "z"], block_rows=10)
    found = {r["id"]: r["y"] for r in filled.collect()}
    mean = np.mean([r[1] for r in rows if r[1] is not None])
    for i, v in _brute_force(rows, 3).items():
        assert found[i] == pytest.approx(mean if v is None else v)


def test_cells_beyond_their_limit_are_searched_in_blocks(spark):
    rng = random.Random(3)
    rows = [(i, None if i % 4 == 0 else rng.uniform(0, 9), rng.uniform(0, 40), None if i % 3 == 0 else rng.uniform(0, 40)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, y double, x double, z double")
    filled = neighbors.knn_fill(df, "y", "id", 4, ["y", "x", "z"], block_rows=10, max_cells=3)
    found = {r["id"]: r["y"] for r in filled.collect()}
    assert len(found) == 200
    for i, v in _brute_force(rows, 4).items():
        assert found[i] == pytest.approx(v)


def test_recipients_that_share_no_column_with_near_cells(spark):
    """Most donors lack x, so a recipient that only has x finds its donors in later rounds."""
    rng = random.Random(4)
    rows = [(i, float(i), None if i % 40 else rng.uniform(0, 9), rng.uniform(0, 90)) for i in range(1, 400)]
    rows += [(1000 + i, None, rng.uniform(0, 9), None) for i in range(10)] + [(2000, None, None, None)]
    df = spark.createDataFrame(rows, "id int, y double, x double, z double")
    filled = neighbors.knn_fill(df, "y", "id", 3, ["y", "x", "z"], block_rows=10)
    found = {r["id"]: r["y"] for r in filled.collect()}
    mean = np.mean([r[1] for r in rows if r[1] is not None])
    for i, v in _brute_force(rows, 3).items():
        assert found[i] == pytest.approx(mean if v is None else v)


@pytest.mark.parametrize("null_share", [0.0, 0.3])
def test_visited_cells_stay_flat_as_donors_grow(spark, null_share):
    """Cells per recipient with ten times the donors, in cells of the same size."""
    seen = []
    for n in (2_000, 20_000):
        rng = np.random.default_rng(7)
        grid = rng.random((n + 200, 2))
        grid[rng.random(grid.shape) < null_share] = np.nan
        cell = lambda v: None if np.isnan(v) else float(v)
        rows = [(i, None if i < 200 else 1.0, cell(x), cell(z)) for i, (x, z) in enumerate(grid)]
        df = spark.createDataFrame(rows, "id int, y double, x double, z double")
        visits = []
        near = neighbors.nearest_donors(df, "y", "id", 5, ["y", "x", "z"], block_rows=100, visits=visits)
        assert near.count() == 5 * sum(any(v is not None for v in r[2:]) for r in rows[:200])
        seen.append(sum(v.count() for v in visits) / 200)
    assert seen[1] < 1.6 * seen[0] + 2 and seen[1] < 30


def test_bounds_are_never_above_the_least_distance():
    rng = np.random.default_rng(5)
    for _ in range(30):
        donors, rows = rng.normal(size=(60, 4)).round(1), rng.normal(size=(20, 4)).round(1)
        donors[rng.random(donors.shape) < 0.3], rows[rng.random(rows.shape) < 0.3] = np.nan, np.nan
        cells = kernels.Cells(donors[::2], 8, [0, 1, 2], least=2)
        home = cells.home(donors)
        parts = [donors[home == c] for c in range(cells.n_cells)]
        edge = [(np.fmin.reduce(p, axis=0), np.fmax.reduce(p, axis=0)) if len(p) else (np.full(4, np.nan),) * 2 for p in parts]
        cells.set_boxes(np.array([e[0] for e in edge]), np.array([e[1] for e in edge]),
                        np.array([(~np.isnan(p)).sum(axis=0) for p in parts]), np.array([len(p) for p in parts]))
        at, cell, bound = cells.within(rows, np.full(20, np.inf))
        found = {(i, c): b for i, c, b in zip(at, cell, bound)}
        for c, p in enumerate(parts):
            least = kernels.distances(rows, p).min(axis=1) if len(p) else np.full(20, np.inf)
            for i in range(20):
                assert found.get((i, c), np.inf) <= least[i] if np.isfinite(least[i]) else (i, c) not in found


def test_fewer_donors_than_neighbours(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, 4.0, 2.0), (3, 6.0, 9.0)], "id int, y double, x double")
    assert {r["id"]: r["y"] for r in neighbors.knn_fill(df, "y", "id", 5, ["y", "x"]).collect()}[1] == 5.0


def _series(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k int, x double").withColumn("k", F.col("k").cast("string"))


def test_all_outliers_are_handled_not_only_the_first_fifty(spark):
    df = _series(spark, [float(i % 10) for i in range(600)] + [1000.0 + i for i in range(90)])
    found = outliers.handle_outliers(df, "k")
    assert found.table.count() == 600 and found.issues.count() == 50
    assert found.issue_summary.filter("dimension = 'total'").first()["count"] == 90
    assert found.actions.first()["cells_changed"] == 90


@pytest.mark.parametrize("method,least", [("iqr", 4), ("z_score", 3), ("percentile", 10)])
def test_too_few_values_have_no_outliers(spark, method, least):
    df = _series(spark, [1.0] * (least - 2) + [1e9])
    p = OutlierParams(method=method)
    assert outliers.outlier_summary(df, outliers.bounds(df, p).collect(), p).count() == 0


def test_impute_uses_one_statistic_of_the_original_column(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 500.0, 600.0]
    p = OutlierParams(strategy="impute_median", iqr_multiplier=0.1)
    found = outliers.handle_outliers(_series(spark, values), "k", p)
    assert sorted(r["x"] for r in found.table.collect())[-1] <= 6.0
    assert {r["fill_value"] for r in found.actions.collect()} == {"4.5"}


def test_iqr_severity_uses_the_larger_distance_unless_asked(spark):
    values = [float(i) for i in range(20)] + [35.0]
    for nearest, wanted in ((False, "critical"), (True, "warning")):
        p = OutlierParams(nearest_fence=nearest)
        df = _series(spark, values)
        found = outliers.outlier_issues(df, "k", outliers.bounds(df, p).collect(), p).collect()
        assert [r["severity"] for r in found] == [wanted]


def test_null_is_no_outlier_and_stays(spark):
    df = _series(spark, [1.0, 2.0, 3.0, 4.0, None, 1000.0])
    assert sorted(map(str, (r["x"] for r in outliers.handle_outliers(df, "k").table.collect()))) == ["1.0", "2.0", "3.0", "4.0", "None"]


def test_bounds_are_exact_quantiles(spark):
    values = [float((i * 37) % 1001) for i in range(2500)]
    df = _series(spark, values)
    row = df.selectExpr("percentile(x, array(0.01D, 0.25D, 0.75D, 0.99D)) AS q").first()["q"]
    found = outliers.bounds(df, OutlierParams(method="percentile")).first()
    assert (found["low"], found["high"]) == pytest.approx((row[0], row[3]))
    found = outliers.bounds(df, OutlierParams(method="iqr")).first()
    spread = row[2] - row[1]
    assert (found["low"], found["high"]) == pytest.approx((row[1] - 1.5 * spread, row[2] + 1.5 * spread))


def test_type_suggestions_and_auto_fix(spark):
    rows = [(str(i), f"2024-01-{i:02d}", "x", float(i)) for i in range(1, 10)] + [("n/a", "later", "7", 10.0)]
    df = spark.createDataFrame(rows, "num string, day string, word string, whole double").withColumn("id", F.monotonically_increasing_id())
    found = types.fix_types(df, "id", TypeParams(auto=True))
    assert {r["column"]: r["suggested_type"] for r in found.type_issues.collect()} == {"num": "numeric", "day": "datetime", "whole": "integer"}
    assert dict(found.table.dtypes)["num"] == "double" and dict(found.table.dtypes)["day"] == "timestamp"
    assert dict(found.table.dtypes)["whole"] == "bigint" and dict(found.table.dtypes)["word"] == "string"
    overall = found.scores.filter("component = 'overall'").first()
    # The new double column holds whole numbers only: one of three issues remains.
    assert overall["score"] == 80 and overall["status"] == "Well Fixed"
    assert {r["column"]: r["cells_changed"] for r in found.actions.collect()} == {"num": 1, "day": 1, "whole": 0}


def test_integer_fix_leaves_a_column_with_fractions(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.5)], "id int, x double")
    assert dict(types.fix_types(df, "id", TypeParams(column_fixes={"x": "integer"})).table.dtypes)["x"] == "double"


def test_mixed_type_cells_are_listed(spark):
    df = spark.createDataFrame([(1, "word"), (2, "12345"), (3, None)], "id int, note string")
    found = types.fix_types(df, "id").issues.collect()
    assert [(r["row_id"], r["value"]) for r in found] == [("2", "12345")]
