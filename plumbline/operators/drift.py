"""Compare a baseline with a current table: distributions, categories, rows, dates."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import stats
from plumbline.functions.columns import col, kind_of
from plumbline.operators import frequencies, issues, quantiles
from plumbline.operators.baseline import Baseline
from plumbline.operators.facts import local_facts, number
from plumbline.operators.layout import lookup, melt, range_buckets
from plumbline.operators.scores import union_all
from plumbline.params import DriftParams
from plumbline.sources.state import as_local, small_table

ROWS_PER_RANGE = 1_000_000
# Value ranges per column; the sketch that cuts them is off by about one range.
RANGES = 2_000
# Periods that one row is unfolded to at a time.
PERIODS_AT_ONCE = 10_000


class Drift(NamedTuple):
    drift: DataFrame
    categories: DataFrame
    findings: DataFrame
    issues: DataFrame
    issue_summary: DataFrame
    status: DataFrame


def column_sets(baseline: DataFrame | Baseline, current: DataFrame) -> DataFrame:
    """(column, change): added, dropped or common."""
    old, new = set(baseline.columns), set(current.columns)
    rows = [(c, "common" if c in old and c in new else "added" if c in new else "dropped")
            for c in sorted(old | new)]
    return small_table(baseline.sparkSession, rows, "column string, change string")


def comparable_columns(baseline: DataFrame | Baseline, current: DataFrame) -> tuple[list[str], list[str]]:
    """Common columns: numeric on both sides, and the others."""
    common = [c for c in baseline.columns if c in current.columns]
    numeric = [
        c for c in common
        if all(kind_of(t.schema[c].dataType) in ("numeric", "boolean") for t in (baseline, current))
    ]
    return numeric, [c for c in common if c not in numeric]


def ks_statistics(
    baseline: DataFrame | Baseline,
    current: DataFrame,
    columns: list[str],
    p_value_method: str = "asymptotic",
    rows_per_range: int | None = None,
) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic and p-value per numeric column, exact without counting every value.

    Both tables are counted by value ranges, which gives both distribution functions at the ranges' ends and bounds of
    their gap inside. Only ranges whose bound exceeds the largest gap at an end can hold the statistic; their values alone
    are counted one by one and shuffled.
    """
    sides = ((baseline, 1, 0), (current, 0, 1))
    splits = _splits(sides, columns, rows_per_range)
    ranges = _bounded_ranges(sides, columns, splits)
    at_ends = ranges.groupBy("column", "n1", "n2").agg(F.max("best").alias("gap"))
    open_ranges: dict[str, list[int]] = {}
    for r in ranges.filter("open").select("column", "range").collect():
        open_ranges.setdefault(r["column"], []).append(r["range"])
    found = at_ends
    if open_ranges:
        counts = _value_sides(sides, lambda df: _with_ranges(df, columns, splits, open_ranges), ["column", "range", "value"])
        inside = _running(counts, ranges)
        gap = F.abs(F.col("cum_b") / F.col("n1") - F.col("cum_c") / F.col("n2"))
        found = at_ends.unionByName(inside.groupBy("column", "n1", "n2").agg(F.max(gap).alias("gap")))
    d = found.groupBy("column", "n1", "n2").agg(F.max("gap").alias("ks_statistic"))
    return with_ks_p_value(d, p_value_method)


def ks_work(baseline: DataFrame, current: DataFrame, columns: list[str], rows_per_range: int | None = None) -> DataFrame:
    """(column, rows, rows_counted, ranges, ranges_counted): what ``ks_statistics`` has to count value by value."""
    sides = ((baseline, 1, 0), (current, 0, 1))
    ranges = _bounded_ranges(sides, columns, _splits(sides, columns, rows_per_range))
    rows = F.col("sb") + F.col("sc")
    return ranges.groupBy("column").agg(
        F.sum(rows).alias("rows"), F.sum(F.when(F.col("open"), rows).otherwise(0)).alias("rows_counted"),
        F.count("*").alias("ranges"), F.count_if("open").alias("ranges_counted"))


def _bounded_ranges(sides, columns: list[str], splits: dict[str, list[float]]) -> DataFrame:
    """Counts of both sides per range with totals before it, the gap at the ends, and whether the gap inside may be larger.

    A table of at most RANGES rows per column, for columns with values on both sides.
    """
    sums = _value_sides(sides, lambda df: _with_ranges(df, columns, splits), ["column", "range"]).select(
        "column", "range", F.col("b").alias("sb"), F.col("c").alias("sc"))
    before = Window.partitionBy("column").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("column")
    starts = sums.select(
        "column", "range", "sb", "sc",
        F.coalesce(F.sum("sb").over(before), F.lit(0)).alias("start_b"),
        F.coalesce(F.sum("sc").over(before), F.lit(0)).alias("start_c"),
        F.sum("sb").over(whole).alias("n1"), F.sum("sc").over(whole).alias("n2")).filter("n1 > 0 and n2 > 0")

    def gap(b, c):
        return F.abs(b / F.col("n1") - c / F.col("n2"))

    b, c = F.col("start_b"), F.col("start_c")
    end_b, end_c = b + F.col("sb"), c + F.col("sc")
    bound = F.greatest(gap(end_b, c), gap(b, end_c))
    return as_local(starts.withColumn("best", F.max(gap(end_b, end_c)).over(whole)).withColumn("open", bound > F.col("best")))


def _value_sides(sides, to_long, by: list[str]) -> DataFrame:
    """Counts per distinct value on both sides, absent values as 0."""
    long = [to_long(df).select(*by, (F.col("n") * b).alias("b"), (F.col("n") * c).alias("c")) for df, b, c in sides]
    return union_all(long).groupBy(*by).agg(F.sum("b").alias("b"), F.sum("c").alias("c"))


def _splits(sides, columns: list[str], rows_per_range: int | None) -> dict[str, list[float]]:
    """Cut points per column from one sketch of both sides: RANGES ranges, or as many as the rows need."""
    shares = [i / RANGES for i in range(1, RANGES)]
    numbers = [_numbers(df, columns).drop("n") for df, _, _ in sides]
    row = union_all(numbers).agg(F.count(F.lit(1)).alias("rows"), *[
        quantiles.sketched(F.col(f"v{i}"), shares, quantiles.SKETCH_SIZE).alias(f"s{i}") for i in range(len(columns))
    ]).first()
    ranges = min(RANGES, max(2, -(-row["rows"] // rows_per_range))) if rows_per_range else RANGES
    # Every so many of the cut points.
    chosen = sorted({round(i * RANGES / ranges) - 1 for i in range(1, ranges)})
    return {c: sorted({row[f"s{i}"][k] for k in chosen}) if row[f"s{i}"] else [0.0] for i, c in enumerate(columns)}


def _numbers(df: DataFrame | Baseline, columns: list[str]) -> DataFrame:
    """Columns v0, v1, ... as doubles and how many rows a row stands for; of a stored baseline, a row per column and value."""
    if isinstance(df, Baseline):
        values = [df.number(c).alias(f"v{i}") for i, c in enumerate(columns)]
        return df.counts(columns).select(*values, F.col("count").alias("n"))
    return df.select(*[number(df, c).alias(f"v{i}") for i, c in enumerate(columns)], F.lit(1).cast("bigint").alias("n"))


def _with_ranges(
    df: DataFrame | Baseline, columns: list[str], splits: dict[str, list[float]], only: dict[str, list[int]] | None = None,
) -> DataFrame:
    """Long form (column, value, range, n): the range of a value is looked up in its row. ``only``: the ranges wanted per column."""
    names = [c for c in columns if only is None or c in only]
    wide = _numbers(df, names)
    ranged = Bucketizer(
        splitsArray=[[float("-inf"), *splits[c], float("inf")] for c in names],
        inputCols=[f"v{i}" for i in range(len(names))],
        outputCols=[f"r{i}" for i in range(len(names))],
        handleInvalid="keep",
    ).transform(wide)

    def cell(i: int, c: str):
        made = F.struct(F.lit(c).alias("column"), F.col(f"v{i}").alias("value"), F.col(f"r{i}").cast("int").alias("range"))
        return made if only is None else F.when(F.col(f"r{i}").cast("int").isin(only[c]), made)

    cells = F.array(*[cell(i, c) for i, c in enumerate(names)])
    return ranged.select(F.explode(cells).alias("x"), "n").select("x.*", "n").filter("value is not null")


def _running(counts: DataFrame, starts: DataFrame) -> DataFrame:
    """Running sums per column: within a range, plus the total of the ranges before it (a small table)."""
    within = Window.partitionBy("column", "range").orderBy("value")
    before = F.broadcast(starts.select("column", "range", "start_b", "start_c", "n1", "n2"))
    return (
        counts.withColumns({"in_b": F.sum("b").over(within), "in_c": F.sum("c").over(within)})
        .join(before, ["column", "range"])
        .select("column", "value", "n1", "n2", (F.col("start_b") + F.col("in_b")).alias("cum_b"),
                (F.col("start_c") + F.col("in_c")).alias("cum_c")))


def running_shares(df: DataFrame, columns: list[str], rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(column, value, share): the empirical distribution function per numeric column.

    Rows are first counted per distinct value (map-side). Each value range is summed in its own task and starts from the total
    of the ranges before it, so no task sees a whole column.
    """
    sides = ((df, 1, 0),)
    splits = _splits(sides, columns, rows_per_range)
    counts = _value_sides(sides, lambda t: _with_ranges(t, columns, splits), ["column", "range", "value"])
    sums = counts.groupBy("column", "range").agg(F.sum("b").alias("sb"))
    before = Window.partitionBy("column").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = as_local(sums.select(
        "column", "range", F.coalesce(F.sum("sb").over(before), F.lit(0)).alias("start_b"), F.lit(0).alias("start_c"),
        F.sum("sb").over(Window.partitionBy("column")).alias("n1"), F.lit(0).alias("n2")))
    return _running(counts, starts).select("column", "value", (F.col("cum_b") / F.col("n1")).alias("share"))


def with_ks_p_value(d: DataFrame, method: str = "asymptotic") -> DataFrame:
    """The p-value by one formula for samples of any size.

    ``asymptotic`` is the limiting series with the small-sample correction. ``exact`` counts lattice paths; its time grows
    with the product of the sample sizes, so it is for small samples.
    """
    if method == "asymptotic":
        return d.withColumn("p_value", stats.ks_p_value(F.col("ks_statistic"), F.col("n1"), F.col("n2")))
    if method == "exact":
        return d.withColumn("p_value", stats.exact_ks_p_value("ks_statistic", "n1", "n2"))
    raise ValueError(f"unknown p-value method {method!r}")


def categorical_drift(pairs: DataFrame, p: DriftParams = DriftParams()) -> DataFrame:
    """PSI, Jensen-Shannon distance, chi-square and entropy change per column."""
    totals = pairs.groupBy("column").agg(
        F.sum("baseline_count").alias("nb"), F.sum("current_count").alias("nc"))
    joined = pairs.join(F.broadcast(totals), "column").filter((F.col("nb") > 0) & (F.col("nc") > 0))
    b = F.col("baseline_count") / F.col("nb")
    c = F.col("current_count") / F.col("nc")
    n = F.col("baseline_count") + F.col("current_count")
    grand = F.col("nb") + F.col("nc")
    expect_b, expect_c = n * F.col("nb") / grand, n * F.col("nc") / grand

    def entropy_part(count):
        return F.when(count > 0, count * F.ln(count)).otherwise(0.0)

    out = joined.groupBy("column").agg(
        F.sum(stats.psi_term(b, c, p.zero_share)).alias("psi"),
        F.sqrt(F.greatest(F.lit(0.0), F.sum(stats.js_term(b, c)))).alias("js_distance"),
        F.sum(F.pow(F.col("baseline_count") - expect_b, 2) / expect_b
              + F.pow(F.col("current_count") - expect_c, 2) / expect_c).alias("chi_square"),
        (F.count("*") - 1).alias("dof"),
        (F.ln(F.max("nb")) - F.sum(entropy_part(F.col("baseline_count"))) / F.max("nb")).alias("entropy_baseline"),
        (F.ln(F.max("nc")) - F.sum(entropy_part(F.col("current_count"))) / F.max("nc")).alias("entropy_current"),
        F.count_if(F.col("baseline_count") == 0).alias("new_categories"),
        F.count_if(F.col("current_count") == 0).alias("missing_categories"),
        F.sum(F.when(F.col("baseline_count") == 0, F.col("current_count")).otherwise(0)).alias("new_category_rows"),
    )
    return out.withColumn("entropy_change", F.col("entropy_current") - F.col("entropy_baseline"))


def with_chi_square_p_value(drift: DataFrame) -> DataFrame:
    return drift.withColumn("chi_square_p", stats.chi_square_p_value("chi_square", "dof"))


def category_changes(pairs: DataFrame) -> DataFrame:
    """Categories that one of the two tables does not have."""
    return pairs.filter((F.col("baseline_count") == 0) | (F.col("current_count") == 0)).select(
        "column", "value",
        F.when(F.col("baseline_count") == 0, "new").otherwise("missing").alias("change"),
        F.greatest("baseline_count", "current_count").alias("rows"))


def psi_severity(psi, p: DriftParams):
    return F.when(psi > p.psi_critical, "critical").when(psi > p.psi_alert, "warning")


def numeric_drift_rules(current: DataFrame, baseline_facts: DataFrame, columns: list[str], p: DriftParams) -> list:
    """Cells that lie more than ``z_threshold`` baseline deviations from the mean."""
    made = []
    for r in baseline_facts.collect():
        if r["column"] not in columns or not r["std_dev"]:
            continue
        v = number(current, r["column"])
        z = F.abs((v - F.lit(r["mean"])) / F.lit(r["std_dev"]))
        made.append(issues.CellRule(
            r["column"], "numeric_drift", "warning", z > p.z_threshold, value=v,
            message=F.concat(F.lit("deviates from the baseline, z-score "), F.format_string("%.2f", z))))
    return made


def _cell_digest() -> Column:
    return F.sha2(F.concat_ws("\u0000", "column", "value"), 256)


def rows_with_new_categories(current: DataFrame, pairs: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    """Every (row, column) whose category the baseline does not have."""
    new = category_changes(pairs).filter(F.col("change") == "new").select(_cell_digest().alias("cell"), "rows")
    long = melt(current, columns, key).filter(F.col("value").isNotNull())
    return lookup(long.withColumn("cell", _cell_digest()), new, "cell", hot_by="rows").drop("cell", "rows")


def new_category_issues(
    current: DataFrame, pairs: DataFrame, columns: list[str], key: list[str], dataset: str = "table",
) -> DataFrame:
    """An issue for every row of every new category."""
    keys = [f"key_{i}" for i in range(len(key))]
    return rows_with_new_categories(current, pairs, columns, key).select(
        F.lit(dataset).alias("dataset"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("row_id"),
        F.struct(*[F.col(k).alias(n) for k, n in zip(keys, key)]).alias("row_key"),
        "column", F.lit("new_category").alias("issue_type"), F.lit(None).cast("string").alias("pii_type"),
        F.lit("warning").alias("severity"), "value",
        F.concat(F.lit("New category in column '"), "column", F.lit("'")).alias("message"))


def first_of_new_categories(cells: DataFrame, pairs: DataFrame, p: DriftParams = DriftParams()) -> DataFrame:
    """The first ``rows_per_category`` issues of the ``categories_listed`` most frequent new categories per column."""
    order = Window.partitionBy("column").orderBy(F.desc("rows"), "value")
    chosen = as_local(
        category_changes(pairs).filter(F.col("change") == "new")
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= p.categories_listed)
        .select(F.col("column").alias("c"), F.col("value").alias("v")))
    hit = cells.join(F.broadcast(chosen), (F.col("column") == F.col("c")) & (F.col("value") == F.col("v")), "left_semi")
    rank = Window.partitionBy("column", "value").orderBy("row_key")
    return hit.withColumn("_rank", F.row_number().over(rank)).filter(F.col("_rank") <= p.rows_per_category).drop("_rank")


def numeric_shift(baseline_facts: DataFrame, current_facts: DataFrame) -> DataFrame:
    """Mean and deviation shift per numeric column, with the direction."""
    b, c = _paired(baseline_facts, current_facts, ["mean", "std_dev"])
    shift = F.col("mean_current") - F.col("mean_baseline")
    return b.join(F.broadcast(c), "column").filter(F.col("mean_baseline").isNotNull()).select(
        "column", "mean_baseline", "mean_current", shift.alias("mean_shift"),
        F.when(shift > 0, "increase").when(shift < 0, "decrease").otherwise("none").alias("direction"),
        "std_dev_baseline", "std_dev_current",
        (F.col("std_dev_current") - F.col("std_dev_baseline")).alias("std_dev_change"))


def _paired(baseline_facts, current_facts, fields):
    b = baseline_facts.select("column", *[F.col(f).alias(f"{f}_baseline") for f in fields])
    c = current_facts.select("column", *[F.col(f).alias(f"{f}_current") for f in fields])
    return b, c


def missing_value_drift(baseline_facts: DataFrame, current_facts: DataFrame) -> DataFrame:
    """Null share per common column before and after."""
    b, c = _paired(baseline_facts, current_facts, ["null_count", "row_count"])
    before = stats.percent(F.col("null_count_baseline"), F.col("row_count_baseline"))
    after = stats.percent(F.col("null_count_current"), F.col("row_count_current"))
    return b.join(F.broadcast(c), "column").select(
        "column", before.alias("null_pct_baseline"), after.alias("null_pct_current"),
        (after - before).alias("null_pct_change"),
        F.when(after > before, "increase").when(after < before, "decrease").otherwise("none").alias("direction"))


def date_range_shift(baseline_facts: DataFrame, current_facts: DataFrame) -> DataFrame:
    """Earliest and latest moment per temporal column, before and after."""
    b, c = _paired(baseline_facts, current_facts, ["earliest", "latest"])
    return b.join(F.broadcast(c), "column").filter(F.col("earliest_baseline").isNotNull()).select(
        "column", "earliest_baseline", "earliest_current", "latest_baseline", "latest_current",
        (F.col("earliest_current") < F.col("earliest_baseline")).alias("new_earliest"),
        (F.col("latest_current") > F.col("latest_baseline")).alias("new_latest"))


_BELOW_A_DAY = ("HOUR", "MINUTE", "SECOND")


def period_counts(df: DataFrame, column: str, period: str = "DAY") -> DataFrame:
    """Rows per period: its first day, or its first moment for periods below a day."""
    start = F.date_trunc(period, col(column))
    start = start if period.upper() in _BELOW_A_DAY else start.cast("date")
    return df.filter(col(column).isNotNull()).groupBy(start.alias("period")).agg(F.count("*").alias("n"))


_SECONDS = {"HOUR": 3600, "MINUTE": 60, "SECOND": 1}
_MONTHS = {"MONTH": 1, "QUARTER": 3, "YEAR": 12}


def _periods_between(start: Column, end: Column, period: str) -> Column:
    period = period.upper()
    if period in _SECONDS:
        return ((F.unix_seconds(end) - F.unix_seconds(start)) / _SECONDS[period]).cast("bigint")
    if period in _MONTHS:
        months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
        return (months / _MONTHS[period]).cast("bigint")
    return (F.datediff(end, start) / {"DAY": 1, "WEEK": 7}[period]).cast("bigint")


def _periods_later(start: Column, n: Column, period: str) -> Column:
    moved = F.timestamp_add(period.upper(), n.cast("int"), start)
    return moved if period.upper() in _BELOW_A_DAY else moved.cast("date")


def date_gap_spans(df: DataFrame, column: str, period: str = "DAY", buckets: int | None = None) -> DataFrame:
    """(gap_start, gap_end, missing): runs of periods between the first and last that hold no row.

    The periods with rows are dealt out by ranges of time. Each looks at the one before it in its range, the first of a range
    at the last of the range before; so the work follows the rows and not the span, and no calendar is made.
    """
    ranged = range_buckets(period_counts(df, column, period).select("period"), [F.col("period")], buckets)
    # One row per range.
    lasts = sorted((r["_bucket"], r["last"]) for r in ranged.groupBy("_bucket").agg(F.max("period").alias("last")).collect())
    schema = f"_bucket int, _before {ranged.schema['period'].dataType.simpleString()}"
    before = small_table(df.sparkSession, [(b, last) for (b, _), (_, last) in zip(lasts[1:], lasts)], schema)
    within = Window.partitionBy("_bucket").orderBy("period")
    at = ranged.withColumn("_lag", F.lag("period").over(within)).join(F.broadcast(before), "_bucket", "left")
    previous = F.coalesce("_lag", "_before")
    return at.select(F.col("period"), previous.alias("previous")).filter("previous is not null").withColumn(
        "missing", _periods_between(F.col("previous"), F.col("period"), period) - 1).filter("missing > 0").select(
        _periods_later(F.col("previous"), F.lit(1), period).alias("gap_start"),
        _periods_later(F.col("period"), F.lit(-1), period).alias("gap_end"), "missing")


def date_gaps(df: DataFrame, column: str, period: str = "DAY") -> DataFrame:
    """Periods between the first and last that hold no row, one by one; a long gap is unfolded in parts."""
    spans = date_gap_spans(df, column, period)
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("missing") - 1, F.lit(PERIODS_AT_ONCE).cast("bigint"))
    parts = spans.withColumn("_part", F.explode(starts))
    last = F.least(F.col("_part") + PERIODS_AT_ONCE, F.col("missing")) - 1
    return parts.withColumn("_nth", F.explode(F.sequence("_part", last))).select(
        _periods_later(F.col("gap_start"), F.col("_nth"), period).alias("period"))


def frequency_change(baseline: DataFrame, current: DataFrame, column: str, unit: str = "DAYOFWEEK") -> DataFrame:
    """Mean events per slot on both sides: per day by day of week or month, per hour by hour of the day."""
    period = unit.upper() if unit.upper() in _BELOW_A_DAY else "DAY"

    def side(df, label):
        return period_counts(df, column, period).groupBy(
            F.date_part(F.lit(unit), F.col("period")).cast("int").alias("slot")
        ).agg(F.avg("n").alias(label))

    joined = side(baseline, "baseline_mean").join(side(current, "current_mean"), "slot", "full_outer")
    b, c = F.coalesce("baseline_mean", F.lit(0.0)), F.coalesce("current_mean", F.lit(0.0))
    return joined.select(
        "slot", b.alias("baseline_mean"), c.alias("current_mean"), (c - b).alias("change"),
        F.when(c > b, "increase").when(c < b, "decrease").otherwise("none").alias("direction"))


def outlier_introduction(baseline: DataFrame, current: DataFrame, baseline_facts: DataFrame, multiplier: float = 1.5) -> DataFrame:
    """Outlier share of both tables against the baseline's fences."""
    from plumbline.operators.profile import outlier_counts

    known = baseline_facts.filter(F.col("column").isin(current.columns))
    def side(df, label):
        counts = outlier_counts(df, known, multiplier).withColumnRenamed("outlier_count", label)
        return counts

    sizes = {"baseline": baseline.count(), "current": current.count()}
    b, c = side(baseline, "baseline_outliers"), side(current, "current_outliers")
    return b.join(F.broadcast(c), "column").select(
        "column", "baseline_outliers", "current_outliers",
        (100.0 * F.col("baseline_outliers") / sizes["baseline"]).alias("baseline_pct"),
        (100.0 * F.col("current_outliers") / sizes["current"]).alias("current_pct"))


def rename_candidates(baseline: DataFrame, current: DataFrame, least: float = 0.5) -> DataFrame:
    """For each dropped column the added column with the most similar name."""
    old, new = baseline.columns, current.columns
    pairs = [(d, a) for d in old if d not in new for a in new if a not in old]
    named = small_table(baseline.sparkSession, pairs, "dropped string, added string")
    distance = F.levenshtein(F.lower("dropped"), F.lower("added"))
    similarity = 1 - distance / F.greatest(F.length("dropped"), F.length("added"))
    best = Window.partitionBy("dropped").orderBy(F.desc("similarity"), "added")
    return (
        named.withColumn("similarity", similarity)
        .withColumn("rank", F.row_number().over(best))
        .filter((F.col("rank") == 1) & (F.col("similarity") >= least))
        .drop("rank"))


def drift_table(
    baseline: DataFrame | Baseline, current: DataFrame, p: DriftParams = DriftParams(), pairs: DataFrame | None = None
) -> DataFrame:
    """One row per column: added, dropped, numeric (KS) or categorical (PSI, JS)."""
    numeric, other = comparable_columns(baseline, current)
    parts = []
    changed = column_sets(baseline, current).filter(F.col("change") != "common")
    parts.append(changed.select(
        "column", F.col("change").alias("kind"), F.lit("schema").alias("statistic"),
        F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("p_value"),
        F.lit(True).alias("drift_detected"), F.lit("critical").alias("severity")))
    if numeric:
        ks = ks_statistics(baseline, current, numeric, p.p_value_method)
        significant = F.col("p_value") < p.p_value_threshold
        parts.append(ks.select(
            "column", F.lit("numeric").alias("kind"), F.lit("ks").alias("statistic"),
            F.col("ks_statistic").alias("value"), "p_value", significant.alias("drift_detected"),
            F.when(significant, "critical").alias("severity")))
    if other:
        pairs = frequencies.paired_counts(baseline, current, other) if pairs is None else pairs
        cat = categorical_drift(pairs, p)
        severity = psi_severity(F.col("psi"), p)
        parts.append(cat.select(
            "column", F.lit("categorical").alias("kind"),
            F.explode(F.array(
                F.struct(F.lit("psi").alias("statistic"), F.col("psi").alias("value"),
                         severity.isNotNull().alias("drift_detected"), severity.alias("severity")),
                F.struct(F.lit("js_distance").alias("statistic"), F.col("js_distance").alias("value"),
                         F.lit(None).cast("boolean").alias("drift_detected"),
                         F.lit(None).cast("string").alias("severity")))).alias("s"))
            .select("column", "kind", "s.statistic", "s.value", F.lit(None).cast("double").alias("p_value"),
                    "s.drift_detected", "s.severity"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def drift_findings(drift: DataFrame, dataset: str = "table") -> DataFrame:
    return drift.filter(F.col("severity").isNotNull()).select(
        F.lit(dataset).alias("dataset"), "column", "severity", F.lit("drift").alias("category"),
        F.concat_ws("_", "kind", "statistic").alias("type"),
        F.concat_ws(" ", F.lit("Drift in column"), "column",
                    F.format_string("%.2f", F.bround("value", 2))).alias("message"))


def detect_drift(
    baseline: DataFrame | Baseline, current: DataFrame, key: list[str], p: DriftParams = DriftParams(),
    dataset: str = "table",
) -> Drift:
    """Column drift, drifting rows of the current table, and the status. A stored baseline gives the same as its table."""
    if baseline.isEmpty() or current.isEmpty():
        raise ValueError("one or both tables are empty")
    numeric, other = comparable_columns(baseline, current)
    pairs = frequencies.paired_counts(baseline, current, other) if other else None
    drift = as_local(drift_table(baseline, current, p, pairs))
    rows = drift.collect()
    shifted = [r["column"] for r in rows if r["statistic"] == "ks" and r["drift_detected"]]
    moved = [r["column"] for r in rows if r["statistic"] == "psi" and r["drift_detected"]]
    found, listed = [], []
    if shifted:
        if isinstance(baseline, Baseline):
            base = baseline.facts.filter(F.col("column").isin(shifted))
        else:
            base = local_facts(baseline.select(*[col(c) for c in shifted]), ("range", "moments"))
        cells = issues.cell_issues(current, key, numeric_drift_rules(current, base, shifted, p), dataset)
        found.append(cells.select(*issues.FIELDS))
        listed.append(issues.first_per_kind(cells, p.rows_listed))
    if moved:
        cells = new_category_issues(current, pairs, moved, key, dataset)
        found.append(cells.select(*issues.FIELDS))
        listed.append(first_of_new_categories(cells, pairs.filter(F.col("column").isin(moved)), p))
    every = union_all(found) if found else issues.empty_issues(current)
    first = union_all(listed) if listed else issues.empty_issues(current)
    status = drift.agg(F.count_if(F.col("severity") == "critical").alias("critical")).select(
        F.lit(dataset).alias("dataset"),
        F.when(F.col("critical") > 0, "Needs Review").otherwise("Ready").alias("status"))
    categories = category_changes(pairs) if pairs is not None else (
        small_table(current.sparkSession, [], "column string, value string, change string, rows bigint"))
    return Drift(drift, categories, drift_findings(drift, dataset), issues.reported(first, p.issues_listed),
                 issues.issue_summary(every), status)


def drift_flags(baseline: DataFrame, current: DataFrame, p: DriftParams = DriftParams()) -> DataFrame:
    """All kinds of drift per column side by side."""
    numeric, other = comparable_columns(baseline, current)
    parts = ("range", "moments", "dates")
    b, c = local_facts(baseline, parts), local_facts(current, parts)
    detected = as_local(drift_table(baseline, current, p)).groupBy("column").agg(
        F.max(F.when(F.col("statistic") == "schema", F.col("kind"))).alias("schema_change"),
        F.coalesce(F.bool_or("drift_detected"), F.lit(False)).alias("distribution_drift"))
    types = b.select("column", F.col("data_type").alias("tb")).join(
        c.select("column", F.col("data_type").alias("tc")), "column")
    return (
        detected
        .join(types, "column", "left")
        .join(missing_value_drift(b, c).select("column", "null_pct_change"), "column", "left")
        .join(date_range_shift(b, c).select("column", "new_earliest", "new_latest"), "column", "left")
        .select(
            "column", "schema_change",
            F.coalesce(F.col("tb") != F.col("tc"), F.lit(False)).alias("type_changed"),
            (F.col("distribution_drift") & F.col("schema_change").isNull()).alias("distribution_drift"),
            F.coalesce(F.col("null_pct_change") != 0, F.lit(False)).alias("missing_drift"),
            F.coalesce(F.col("new_earliest") | F.col("new_latest"), F.lit(False)).alias("date_drift")))


def drift_score(flags: DataFrame) -> DataFrame:
    """40 % schema stability, 30 % type consistency, 30 % distribution similarity."""
    common = F.col("schema_change").isNull()
    parts = flags.agg(
        (100.0 * F.count_if(common) / F.count("*")).alias("schema_stability"),
        F.coalesce(F.try_divide(100.0 * F.count_if(common & ~F.col("type_changed")), F.count_if(common)),
                   F.lit(0.0)).alias("type_consistency"),
        F.coalesce(F.try_divide(100.0 * F.count_if(common & ~F.col("distribution_drift")), F.count_if(common)),
                   F.lit(0.0)).alias("distribution_similarity"))
    return parts.withColumn(
        "drift_score",
        F.bround(0.4 * F.col("schema_stability") + 0.3 * F.col("type_consistency")
                 + 0.3 * F.col("distribution_similarity"), 1))
