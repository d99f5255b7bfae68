"""Drift measures: properties, brute force, p-values and decisions."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import kernels
from plumbline.operators import drift, frequencies, schema_drift
from plumbline.params import DriftParams, SchemaDriftParams


def _largest_gap(a, b):
    return max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for v in set(a) | set(b))


def test_exact_p_value_by_enumeration():
    n1, n2 = 4, 5
    gaps = []
    for chosen in itertools.combinations(range(n1 + n2), n1):
        gaps.append(_largest_gap(list(chosen), [i for i in range(n1 + n2) if i not in chosen]))
    for d in sorted(set(gaps)):
        wanted = sum(g >= d - 1e-12 for g in gaps) / len(gaps)
        assert kernels.exact_ks_p(d, n1, n2) == pytest.approx(wanted)


def test_chi_square_tail_known_values():
    assert kernels.chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert kernels.chi_square_tail(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert kernels.chi_square_tail(0.0, 3) == 1.0
    assert kernels.chi_square_tail(4.0, 2) == pytest.approx(math.exp(-2))


def test_exact_and_asymptotic_p_values_agree_for_large_samples(spark):
    d = spark.createDataFrame([(0.02, 9000, 8000), (0.03, 9000, 8000)], "ks_statistic double, n1 bigint, n2 bigint")
    exact = [r["p_value"] for r in drift.with_ks_p_value(d, "exact").orderBy("ks_statistic").collect()]
    series = [r["p_value"] for r in drift.with_ks_p_value(d, "asymptotic").orderBy("ks_statistic").collect()]
    assert exact == pytest.approx(series, abs=0.002)


def test_ks_over_ranges_equals_ks_in_one_piece(spark):
    base = spark.range(700).select((F.hash("id") % 90).cast("double").alias("x"), F.lit(1.0).alias("same"))
    cur = spark.range(500).select((F.hash("id") % 80 + 9).cast("double").alias("x"), F.lit(1.0).alias("same"))
    whole = {r["column"]: r["ks_statistic"] for r in drift.ks_statistics(base, cur, ["x", "same"]).collect()}
    split = {r["column"]: r["ks_statistic"] for r in drift.ks_statistics(base, cur, ["x", "same"], rows_per_range=40).collect()}
    a, b = [r["x"] for r in base.collect()], [r["x"] for r in cur.collect()]
    assert whole["x"] == pytest.approx(_largest_gap(a, b))
    assert split == pytest.approx(whole) and whole["same"] == 0


def test_no_drift_against_itself(spark):
    df = spark.range(60).select("id", (F.col("id") % 7).cast("string").alias("c"), (F.col("id") * 1.5).alias("x"))
    found = {(r["column"], r["statistic"]): r for r in drift.drift_table(df, df).collect()}
    assert found["x", "ks"]["value"] == 0 and found["x", "ks"]["p_value"] == 1
    assert found["c", "psi"]["value"] == 0 and found["c", "js_distance"]["value"] == 0
    assert not any(r["drift_detected"] for r in found.values())


def test_added_and_dropped_columns_are_both_reported(spark):
    base = spark.createDataFrame([(1, "a")], "id int, gone string")
    cur = spark.createDataFrame([(1, 2.0)], "id int, came double")
    kinds = {r["column"]: r["kind"] for r in drift.drift_table(base, cur).collect() if r["statistic"] == "schema"}
    assert kinds == {"gone": "dropped", "came": "added"}


def test_detect_drift_lists_rows_and_status(spark):
    base = spark.range(200).select("id", (F.col("id") % 10).cast("double").alias("x"), F.lit("a").alias("c"))
    cur = spark.range(200).select("id", (F.col("id") % 10 + 20).cast("double").alias("x"), F.when(F.col("id") % 2 == 0, "b").otherwise("a").alias("c"))
    found = drift.detect_drift(base.drop("id").withColumn("id", F.lit(0)), cur, ["id"], DriftParams(rows_listed=3))
    assert found.status.first()["status"] == "Needs Review"
    kinds = {(r["column"], r["issue_type"]) for r in found.issues.collect()}
    assert ("x", "numeric_drift") in kinds and ("c", "new_category") in kinds
    assert found.issues.filter("column = 'x'").count() == 3
    totals = {r["key"]: r["count"] for r in found.issue_summary.filter("dimension = 'column'").collect()}
    assert totals["x"] == 200
    assert [(r["value"], r["change"], r["rows"]) for r in found.categories.collect()] == [("b", "new", 100)]


def test_empty_side_is_an_error(spark):
    df = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(ValueError):
        drift.detect_drift(df, df.limit(0), ["x"])


def test_thresholds_are_parameters(spark):
    base = spark.createDataFrame([("a",)] * 60 + [("b",)] * 40, "c string")
    cur = spark.createDataFrame([("a",)] * 50 + [("b",)] * 50, "c string")
    psi = drift.categorical_drift(frequencies.paired_counts(base, cur, ["c"]))
    assert psi.select(drift.psi_severity(F.col("psi"), DriftParams()).alias("s")).first()["s"] is None
    assert psi.select(drift.psi_severity(F.col("psi"), DriftParams(psi_alert=0.01)).alias("s")).first()["s"] == "warning"


def test_boolean_columns_count_as_numbers(spark):
    base = spark.createDataFrame([(True,), (False,)], "f boolean")
    assert drift.comparable_columns(base, base) == (["f"], [])


def test_rows_with_new_categories_are_all_found(spark):
    base = spark.createDataFrame([("a",)], "c string")
    cur = spark.range(90).select("id", F.when(F.col("id") % 3 == 0, "z").otherwise("a").alias("c"))
    pairs = frequencies.paired_counts(base, cur, ["c"])
    assert drift.rows_with_new_categories(cur, pairs, ["c"], ["id"]).count() == 30


def test_schema_changes_and_score(spark):
    base = spark.createDataFrame([(1, "x", None, 1.0), (2, "y", "q", 2.0)], "a bigint, b string, n string, gone double")
    cur = spark.createDataFrame([("1", "x", "q", 5), ("2", "y", "q", 6)], "a string, b string, n string, came bigint")
    found = schema_drift.schema_drift(base, cur)
    changes = {(r["column"], r["change"]): r for r in found.schema_changes.collect()}
    assert changes["a", "type"]["compatibility"] == "compatible"
    assert changes["n", "nullable"]["impact"] == "breaking" and changes["n", "nullable"]["points"] == 25
    assert {("gone", "removed"), ("came", "added")} <= set(changes)
    # 10*0.1 + 40*0.4 + 10*0.3 + 25*0.15 + 5*0.05
    overall = found.scores.filter("component = 'overall'").first()
    assert overall["score"] == pytest.approx(24.0) and overall["status"] == "moderate"
    priorities = {r["column"]: r["priority"] for r in found.recommendations.collect()}
    assert priorities == {"gone": "critical", "n": "high", "came": "medium", "a": "low"}


def test_text_length_ignores_nulls_and_tolerance_hides_small_changes(spark):
    base = spark.createDataFrame([("ab", 100.0), (None, 100.0)], "s string, x double")
    facts = {r["column"]: r for r in schema_drift.constraint_facts(base).collect()}
    assert facts["s"]["min_length"] == facts["s"]["max_length"] == 2
    cur = spark.createDataFrame([("ab", 100.5), (None, 100.5)], "s string, x double")
    strict = schema_drift.schema_drift(base, cur).schema_changes.collect()
    loose = schema_drift.schema_drift(base, cur, SchemaDriftParams(constraint_tolerance=0.01)).schema_changes.collect()
    assert [r["column"] for r in strict] == ["x"] and loose == []


def test_catalog_changes(spark):
    old = spark.createDataFrame([("customers", "id"), ("orders", "id"), ("orders", "note"), ("legacy", "x")], "table string, column string")
    new = spark.createDataFrame([("customers", "id"), ("orders", "id"), ("orders", "method"), ("extra", "y")], "table string, column string")
    found = {(r["table"], r["column"], r["change"]) for r in schema_drift.catalog_changes(old, new).collect()}
    assert found == {("legacy", None, "table_dropped"), ("extra", None, "table_added"),
                     ("orders", "note", "column_dropped"), ("orders", "method", "column_added")}


def test_issue_summary_counts_every_row_of_every_new_category(spark):
    base = spark.range(400).select("id", F.lit("old").alias("c"))
    cur = spark.range(400).select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("new"), F.col("id") % 20)).otherwise("old").alias("c"))
    found = drift.detect_drift(base, cur, ["id"])
    summary = {(r["dimension"], r["key"]): r["count"] for r in found.issue_summary.collect()}
    assert summary["column", "c"] == 200
    assert found.issues.filter("issue_type = 'new_category'").count() == 50
    assert found.categories.filter("change = 'new'").count() == 10


def test_hour_periods(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS t UNION ALL SELECT timestamp'2024-01-01 03:50:00' UNION ALL SELECT timestamp'2024-01-02 03:00:00'")
    assert df.count() == 3
    slots = {r["slot"]: r["baseline_mean"] for r in drift.frequency_change(df, df, "t", "HOUR").collect()}
    assert slots == {0: 1.0, 3: 1.0}
    gaps = drift.date_gaps(df.filter("t < timestamp'2024-01-02'"), "t", "HOUR").collect()
    assert sorted(str(r["period"]) for r in gaps) == ["2024-01-01 01:00:00", "2024-01-01 02:00:00"]


def test_one_p_value_formula_for_all_sizes(spark):
    d = spark.createDataFrame([(0.018, 10_000, 10_000), (0.018, 10_001, 10_000)], "ks_statistic double, n1 bigint, n2 bigint")
    small, large = (r["p_value"] for r in drift.with_ks_p_value(d).orderBy("n1").collect())
    assert small == pytest.approx(large, abs=1e-4)


def test_ks_counts_few_values_one_by_one(spark):
    """A shifted column: the bounds leave under a twentieth of the rows to count, and the statistic is exact."""
    import numpy as np
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=40_000), rng.normal(0.3, 1.1, size=30_000)
    b[:6_000] = 1.25  # a value with a fifth of the rows
    base = spark.createDataFrame([(float(x),) for x in a], "x double")
    cur = spark.createDataFrame([(float(x),) for x in b], "x double")
    found = drift.ks_statistics(base, cur, ["x"]).first()
    grid = np.sort(np.concatenate([a, b]))
    wanted = np.abs(np.searchsorted(np.sort(a), grid, "right") / len(a) - np.searchsorted(np.sort(b), grid, "right") / len(b)).max()
    assert found["ks_statistic"] == pytest.approx(wanted, abs=1e-12)
    work = drift.ks_work(base, cur, ["x"]).first()
    assert work["rows"] == 70_000 and work["rows_counted"] < 3_500


def test_ks_without_values_on_a_side(spark):
    base = spark.createDataFrame([(1.0, None), (2.0, None)], "x double, y double")
    cur = spark.createDataFrame([(1.0, 5.0), (None, None)], "x double, y double")
    found = {r["column"]: (r["n1"], r["n2"], r["ks_statistic"]) for r in drift.ks_statistics(base, cur, ["x", "y"]).collect()}
    assert found == {"x": (2, 1, 0.5)}
    assert drift.ks_statistics(base.limit(0), cur, ["x"]).collect() == []


@pytest.mark.parametrize("unit, texts, wanted", [
    ("DAY", ["2024-01-01", "2024-01-01 09:00:00", "2024-01-04", None, "2024-01-05", "2024-01-07"],
     [("2024-01-02", "2024-01-03", 2), ("2024-01-06", "2024-01-06", 1)]),
    ("MONTH", ["2023-11-20", "2024-03-02", "2024-04-30"], [("2023-12-01", "2024-02-01", 3)]),
    ("QUARTER", ["2023-01-20", "2024-01-02"], [("2023-04-01", "2023-10-01", 3)]),
    ("YEAR", ["1999-01-20", "2002-01-02"], [("2000-01-01", "2001-01-01", 2)]),
    ("WEEK", ["2024-01-01", "2024-01-24"], [("2024-01-08", "2024-01-15", 2)]),
    ("HOUR", ["2024-01-01 00:10:00", "2024-01-01 03:00:00"], [("2024-01-01 01:00:00", "2024-01-01 02:00:00", 2)]),
    ("SECOND", ["2020-01-01", "2023-03-03 09:46:41"], [("2020-01-01 00:00:01", "2023-03-03 09:46:40", 10**8)]),
    ("DAY", [None], []), ("DAY", ["2024-01-01"], []),
])
def test_gap_spans(spark, unit, texts, wanted):
    """The last case but two spans a hundred million seconds without a calendar of them."""
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t").cast("timestamp").alias("t"))
    for buckets in (1, 3):
        spans = drift.date_gap_spans(df, "t", unit, buckets)
        found = sorted((str(r["gap_start"]), str(r["gap_end"]), r["missing"]) for r in spans.collect())
        assert found == sorted(wanted)


def test_long_gaps_are_unfolded_in_parts(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-02",), ("2024-01-03",)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    gaps = drift.date_gaps(df, "t", "SECOND")
    found = gaps.agg(F.count("*").alias("n"), F.countDistinct("period").alias("d"), F.min("period").cast("string").alias("a"),
                     F.max("period").cast("string").alias("b")).first()
    assert tuple(found) == (2 * 86_399, 2 * 86_399, "2024-01-01 00:00:01", "2024-01-02 23:59:59")
