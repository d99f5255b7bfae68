"""Row digests, safe joins, row ids, fills and exact quantiles, also when split small."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions.columns import col
from plumbline.operators import duplicates, fills, frequencies, layout, quantiles


def test_digest_tells_rows_apart(spark):
    df = spark.createDataFrame(
        [("a", "bc", None), ("ab", "c", None), (None, "abc", "n"), ("n", None, None), (None, "n", None), ("a", "bc", None)],
        "x string, y string, z string")
    assert df.select(layout.row_digest(df).alias("d")).distinct().count() == 5


def test_digest_sees_nan_as_null_and_zero_signs_as_equal(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (0.0,), (-0.0,)], "x double")
    assert df.select(layout.row_digest(df).alias("d")).distinct().count() == 2


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_lookup_same_result_for_hot_keys(spark, monkeypatch, how):
    left = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"))
    right = spark.range(0, 40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    wanted = sorted(map(tuple, left.join(right, "k", how).collect()), key=str)
    monkeypatch.setattr(layout, "HOT_SHARE", 10)
    assert sorted(map(tuple, layout.lookup(left, right, "k", how).collect()), key=str) == wanted


def test_lookup_with_thousands_of_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(layout, "HOT_SHARE", 5_000)
    left = spark.range(20_000).select("id", F.when(F.col("id") < 16_000, F.col("id") % 4_000).otherwise(F.col("id")).alias("k"))
    right = spark.range(18_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    found = layout.lookup(left, right, "k")
    assert found.count() == 18_000 and found.filter("v != 2 * k").count() == 0


def test_lookup_keeps_rows_without_key(spark):
    left = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, k string")
    right = spark.createDataFrame([("a", 5)], "k string, v int")
    found = {r["id"]: r["v"] for r in layout.lookup(left, right, "k", "left").collect()}
    assert found == {1: 5, 2: None, 3: None}


def test_row_ids_follow_the_order_over_many_ranges(spark):
    values = list(range(500))
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v // 7, v) for v in values], "a int, b int").repartition(6)
    found = layout.with_row_id(df, ["a", "b"], buckets=9).collect()
    assert sorted((r["a"], r["b"]) for r in found) == [(r["a"], r["b"]) for r in sorted(found, key=lambda r: r["row_id"])]
    assert sorted(r["row_id"] for r in found) == list(range(500))


def _reference_fill(values, backward):
    out, last = [], None
    for v in reversed(values) if backward else values:
        last = v if v is not None else last
        out.append(last)
    return list(reversed(out)) if backward else out


@pytest.mark.parametrize("backward", [False, True])
def test_fill_carries_over_range_borders(spark, backward):
    rng = random.Random(3)
    rows = [(i, None if rng.random() < 0.9 else i * 1.5, None if rng.random() < 0.5 else f"t{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "id int, x double, s string").repartition(5)
    filled = {r["id"]: r for r in fills.fill_along(df, ["x", "s"], ["id"], backward=backward, buckets=11).collect()}
    assert [filled[i]["x"] for i in range(300)] == _reference_fill([r[1] for r in rows], backward)
    assert [filled[i]["s"] for i in range(300)] == _reference_fill([r[2] for r in rows], backward)


def test_fill_stays_inside_partitions_also_for_a_hot_one(spark):
    rng = random.Random(5)
    rows = [(i, "hot" if i % 3 else f"p{i % 9}", None if rng.random() < 0.8 else i) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, p string, x int")
    filled = {r["id"]: r["x"] for r in fills.forward_fill(df, ["x"], ["id"], ["p"], buckets=10).collect()}
    for p in {r[1] for r in rows}:
        part = [r for r in rows if r[1] == p]
        assert [filled[r[0]] for r in part] == _reference_fill([r[2] for r in part], False)


def test_fill_leaves_values_alone(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, None)], "id int, x int")
    assert [r["x"] for r in fills.forward_fill(df, ["x"], ["id"]).orderBy("id").collect()] == [None, 5, 5]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-50, 50), st.sampled_from([7, 7, 7, 7])), min_size=1, max_size=300))
def test_narrowed_quantiles_are_exact(spark, values):
    df = spark.createDataFrame([(None if v is None else v / 3,) for v in values], "x double")
    wanted = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    exact = df.select(F.percentile("x", wanted)).first()[0]
    found = quantiles.narrowed(df, {"x": col("x")}, wanted, keep=3, size=8, error=0.05)["x"]
    assert found == (pytest.approx(exact) if exact else [None] * len(wanted))


def test_narrowed_quantiles_with_a_hot_value(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 5000.5).otherwise(F.hash("id").cast("double")).alias("x"))
    exact = df.select(F.percentile("x", [0.25, 0.5, 0.75])).first()[0]
    assert quantiles.narrowed(df, {"x": col("x")}, [0.25, 0.5, 0.75], keep=10, size=64, error=0.03)["x"] == pytest.approx(exact)


def test_duplicates_treat_nulls_as_equal(spark):
    df = spark.createDataFrame(
        [(1, "a", None), (2, "a", None), (3, "b", 1.0), (4, "b", 1.0), (5, "b", 1.0), (6, None, None)], "id int, s string, x double")
    summary = duplicates.duplicate_summary(df, ["s", "x"]).first()
    assert (summary["row_count"], summary["unique_rows"], summary["duplicate_rows"], summary["duplicate_groups"]) == (6, 3, 3, 2)
    groups = {r["first_row_id"]: r["duplicate_count"] for r in duplicates.duplicate_groups(df, "id", ["s", "x"]).collect()}
    assert groups == {"1": 2, "3": 3}
    members = duplicates.rows_of_duplicate_groups(df, ["s", "x"])
    assert sorted(r["id"] for r in members.collect()) == [1, 2, 3, 4, 5]
    listed = duplicates.group_members(members, "id", 2).collect()
    assert sorted(tuple(r["first_row_ids"]) for r in listed) == [("1", "2"), ("3", "4")]


def test_long_texts_with_the_same_start_are_different_values(spark):
    from plumbline.operators import frequencies

    df = spark.createDataFrame([("x" * 150 + "a",), ("x" * 150 + "b",), ("x" * 150 + "a",)], "t string")
    counts = frequencies.value_counts(df)
    assert sorted(r["count"] for r in counts.collect()) == [1, 2]
    assert frequencies.modes(counts).first()["mode"] == "x" * 150 + "a"
    top = frequencies.top_values(frequencies.digest_counts(df), 2)
    assert {r["value"] for r in frequencies.whole_values(df, top).collect()} == {"x" * 150 + "a", "x" * 150 + "b"}


def test_constant_column_has_no_entropy_and_counts_add_up(spark):
    from plumbline.operators import frequencies

    df = spark.createDataFrame([("a", "x"), ("a", None), ("a", "y"), ("a", "y")], "c string, d string")
    spread = {r["column"]: r for r in frequencies.distribution(frequencies.value_counts(df)).collect()}
    assert spread["c"]["entropy"] == pytest.approx(0.0) and spread["c"]["total"] == 4
    assert spread["d"]["total"] == 3 and spread["d"]["distinct_count"] == 2


def test_first_rows_per_kind_are_limited_before_the_shuffle(spark, capsys):
    from plumbline.operators import issues, master

    df = spark.range(100).select("id", F.lit(None).cast("string").alias("t"))
    issues.first_per_kind(issues.null_issues(df, "id"), 20).explain()
    assert "WindowGroupLimit" in capsys.readouterr().out
    master.deduplicate(df.withColumn("t", (F.col("id") % 3).cast("string")), ["t"], ["id"]).explain()
    assert "WindowGroupLimit" in capsys.readouterr().out


def test_filters_and_columns_reach_the_scan(spark, tmp_path, capsys):
    from plumbline.operators.facts import column_facts

    spark.range(50).selectExpr("id", "id * 2 AS x", "'t' AS unused").write.parquet(str(tmp_path / "t"))
    column_facts(spark.read.parquet(str(tmp_path / "t")), ("range",), ["x"]).explain()
    plan = capsys.readouterr().out
    assert "ReadSchema: struct<x:bigint>" in plan


def _exact_top(rows, n):
    from collections import Counter
    counts = Counter(v for v in rows if v is not None)
    return [(v, c) for v, c in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:n]]


@pytest.mark.parametrize("kind", ["skewed", "distinct", "long", "few", "ties", "empty"])
def test_frequent_values_equal_exact_counts(spark, monkeypatch, kind):
    rng = random.Random(3)
    rows = {
        "skewed": [f"v{int(1.01 ** rng.randrange(900))}" for _ in range(6000)] + [f"one{i}" for i in range(3000)],
        "distinct": [f"d{i}" for i in range(2000)],
        "long": ["x" * 150 + str(i % 40) for i in range(800)] + ["y" * 150] * 30 + ["x" * 100] * 20,
        "few": ["a", "b", "a", None],
        "ties": [f"t{i % 500}" for i in range(5000)] + ["a\x00b", "a\x00b", ""] * 4,
        "empty": [None, None],
    }[kind]
    monkeypatch.setattr(frequencies, "TRACKED", 64)
    monkeypatch.setattr(frequencies, "BUCKETS", 300)
    df = spark.createDataFrame([(v, i) for i, v in enumerate(rows)], "c string, i int").repartition(4)
    found = frequencies.frequent_values(df, ["c"], 7).orderBy("rank").collect()
    assert [(r["value"], r["count"]) for r in found] == _exact_top(rows, 7)
    assert [r["rank"] for r in found] == list(range(1, len(found) + 1))


@pytest.mark.parametrize("distinct", [3_000, 30_000])
def test_frequent_values_shuffle_no_rare_values(spark, distinct):
    """Values far above the rest: no bucket is opened, however many rare values there are."""
    rows = [f"hot{i % 10}" for i in range(5_000)] + [f"rare{i}" for i in range(distinct)]
    df = spark.createDataFrame([(v,) for v in rows], "c string").repartition(4)
    candidates, exact, opened = frequencies._heavy(frequencies._keyed(df, ["c"]), 10)
    assert opened.count() == 0 and candidates.count() <= frequencies.TRACKED
    assert {r["count"] for r in exact.collect() if r["key"].startswith("hot")} == {500}
