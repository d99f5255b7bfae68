"""Stored baselines: drift against a version equals drift against its table."""

import datetime as dt

import pytest

from plumbline.operators import baseline, drift
from plumbline.sources.state import small_table

SCHEMA = "id int, x double, f float, big bigint, flag boolean, changed int, price decimal(10,2), name string, day date"


def rows_of(n, shift):
    out = []
    for i in range(n):
        x = None if i % 9 == 0 else float("nan") if i % 11 == 0 else (i * 37 % 100) / 7 + shift
        out.append((i, x, i / 3, 2**60 + i, i % 3 == 0, i % 5, None, f"{'long ' * 40}{i % (4 + shift)}" if i % 4 else "", dt.date(2024, 1, 1 + i % (9 + shift))))
    return out


def plain(df):
    return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())


def test_drift_against_a_version_equals_drift_against_the_table(spark, tmp_path):
    base = small_table(spark, rows_of(300, 0), SCHEMA)
    cur = small_table(spark, rows_of(200, 2), SCHEMA).selectExpr("* EXCEPT (changed, price)", "CAST(changed AS STRING) AS changed", "price", "1 AS added")
    assert baseline.save_baseline(base, f"{tmp_path}/b") == 1
    stored = baseline.load_baseline(spark, f"{tmp_path}/b")
    assert (stored.columns, stored.rows) == (base.columns, 300)
    whole, again = drift.detect_drift(base, cur, ["id"]), drift.detect_drift(stored, cur, ["id"])
    for name, table in whole._asdict().items():
        assert plain(table) == plain(getattr(again, name)), name
    kinds = {(r["column"], r["statistic"]): r["value"] for r in again.drift.collect()}
    assert kinds[("changed", "psi")] == pytest.approx(0, abs=1e-9) and kinds[("x", "ks")] > 0.1
    assert ("added", "schema") in kinds


def test_versions_are_kept_and_broken_ones_not_seen(spark, tmp_path):
    folder = f"{tmp_path}/b"
    with pytest.raises(ValueError, match="no stored baseline"):
        baseline.load_baseline(spark, folder)
    first, second = (small_table(spark, rows_of(n, 0), SCHEMA) for n in (10, 20))
    assert [baseline.save_baseline(t, folder) for t in (first, second)] == [1, 2]
    # A version whose writing broke off: its values are there, its row is not.
    second.write.parquet(f"{folder}/broken/values")
    assert baseline.load_baseline(spark, folder).rows == 20
    assert baseline.load_baseline(spark, folder, 1).rows == 10
    with pytest.raises(ValueError, match="of version 7"):
        baseline.load_baseline(spark, folder, 7)


def test_an_empty_baseline_is_refused_like_an_empty_table(spark, tmp_path):
    cur = small_table(spark, rows_of(5, 0), SCHEMA)
    baseline.save_baseline(cur.limit(0), f"{tmp_path}/b")
    with pytest.raises(ValueError, match="empty"):
        drift.detect_drift(baseline.load_baseline(spark, f"{tmp_path}/b"), cur, ["id"])


def test_a_skewed_column_and_odd_names(spark, tmp_path):
    base = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN id ELSE 7 END AS `a.b/c`", "CASE WHEN id % 2 = 0 THEN 'x' END AS `d e`")
    cur = base.filter("`a.b/c` <> 9")
    baseline.save_baseline(base, f"{tmp_path}/b")
    stored = baseline.load_baseline(spark, f"{tmp_path}/b")
    assert plain(drift.drift_table(base, cur)) == plain(drift.drift_table(stored, cur))
