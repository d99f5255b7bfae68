"""Value counts of many columns in one shuffle, and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import stats
from plumbline.operators.layout import LONG_TEXT, melt
from plumbline.operators.scores import union_all
from plumbline.sources.state import as_local, durable

# Values per column that the summary of frequent values tracks, and buckets that the other values are counted in.
TRACKED = 4_096
BUCKETS = 65_536


def bounded_keys(long: DataFrame) -> DataFrame:
    """Group keys of bounded size: long text is kept as its start and a digest.

    For counts that need no text back; ``whole_values`` finds the text of a few of them.
    """
    long_text = F.length("value") > LONG_TEXT
    return long.withColumns(
        {
            "digest": F.when(long_text, F.sha2("value", 256)),
            "value": F.substring("value", 1, LONG_TEXT),
        }
    )


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value, count) of the non-null values, each value whole."""
    long = melt(df, columns).filter(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count("*").alias("count"))


def digest_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value, digest, count), where a long value is its start and a digest: no long text is shuffled."""
    long = melt(df, columns).filter(F.col("value").isNotNull())
    return bounded_keys(long).groupBy("column", "value", "digest").agg(F.count("*").alias("count"))


def whole_values(df: DataFrame, found: DataFrame) -> DataFrame:
    """The whole text of cut values. ``found``: a few (column, value, digest, ...) rows, such as top values.

    The table is read again only if some value is cut.
    """
    found = as_local(found)
    cut = [r["column"] for r in found.filter(F.col("digest").isNotNull()).select("column").distinct().collect()]
    if not cut:
        return found.drop("digest")
    long = melt(df, cut).filter(F.length("value") > LONG_TEXT).withColumn("digest", F.sha2("value", 256))
    wanted = found.filter(F.col("digest").isNotNull()).select("column", "digest")
    texts = long.join(F.broadcast(wanted), ["column", "digest"]).groupBy("column", "digest").agg(
        F.any_value("value").alias("_whole"))
    joined = found.join(F.broadcast(as_local(texts)), ["column", "digest"], "left")
    return joined.withColumn("value", F.coalesce("_whole", "value")).select(*[c for c in found.columns if c != "digest"])


def paired_counts(baseline, current: DataFrame, columns: list[str]) -> DataFrame:
    """Value counts of two tables side by side; an absent value counts 0. The baseline may be a stored one.

    One tagged union and one aggregate stand in for a full outer join of two
    count tables: a single shuffle instead of three.
    """
    def side(df, b, c):
        if not isinstance(df, DataFrame):
            return df.counts(columns).select("column", "value", (F.col("count") * b).alias("b"), (F.col("count") * c).alias("c"))
        long = melt(df, columns).filter(F.col("value").isNotNull())
        return long.select("column", "value", F.lit(b).alias("b"), F.lit(c).alias("c"))

    both = side(baseline, 1, 0).unionByName(side(current, 0, 1))
    return both.groupBy("column", "value").agg(F.sum("b").alias("baseline_count"), F.sum("c").alias("current_count"))


def distribution(counts: DataFrame) -> DataFrame:
    """Distinct count and entropy per column, from value counts."""
    return counts.groupBy("column").agg(
        F.count("*").alias("distinct_count"),
        F.sum("count").alias("total"),
        stats.entropy(F.sum("count"), stats.n_ln_n(F.col("count"))).alias("entropy"),
    )


def top_values(counts: DataFrame, n: int = 10) -> DataFrame:
    """The n most frequent values per column; ties go to the smaller value."""
    digest = [c for c in ("digest",) if c in counts.columns]
    order = Window.partitionBy("column").orderBy(F.desc("count"), "value", *digest)
    return (
        counts.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
        .select("column", "rank", "value", "count", *digest)
    )


def _keyed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long form (column, value, digest, key, bucket): the key is a value of bounded size, the bucket a hash of it."""
    long = bounded_keys(melt(df, columns).filter(F.col("value").isNotNull()))
    keyed = long.withColumn("key", F.concat("value", F.lit("\u0000"), F.coalesce("digest", F.lit(""))))
    return keyed.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int"))


def _heavy(keyed: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, their exact counts, open buckets) for the n most frequent values per column.

    A mergeable summary names candidates. One pass then counts the candidates exactly and all other rows by bucket. A
    value that is no candidate occurs at most as often as its bucket; so only buckets that reach the n-th candidate's
    count can hold one of the n. At most TRACKED and BUCKETS rows per column are shuffled by a task, whatever the number
    of distinct values.
    """
    summary = keyed.groupBy("column").agg(F.expr(f"approx_top_k(key, {max(n, TRACKED // 4)}, {TRACKED})").alias("top"))
    candidates = as_local(summary.select("column", F.explode("top").alias("x")).select("column", F.col("x.item").alias("key")))
    named = F.broadcast(candidates.withColumn("candidate", F.lit(True)))
    tagged = keyed.join(named, ["column", "key"], "left")
    found = F.col("candidate").isNotNull()
    counts = durable(tagged.groupBy(
        "column", F.when(found, F.col("key")).alias("key"), F.when(~found, F.col("bucket")).alias("bucket")
    ).agg(F.count("*").alias("count")))
    exact = counts.filter("key is not null").select("column", "key", "count")
    order = Window.partitionBy("column").orderBy(F.desc("count"))
    bars = exact.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") == n).select("column", F.col("count").alias("bar"))
    rest = counts.filter("key is null").join(F.broadcast(bars), "column", "left")
    return candidates, exact, rest.filter(F.col("count") >= F.coalesce("bar", F.lit(0))).select("column", "bucket")


def frequent_values(df: DataFrame, columns: list[str], n: int = 10) -> DataFrame:
    """(column, rank, value, count): ``top_values`` of the whole columns, exact, for columns with many distinct values.

    Only values in buckets that may hold one of the n are counted one by one. In a column whose values are almost all
    different that is every value.
    """
    keyed = _keyed(df, columns)
    candidates, exact, open_buckets = _heavy(keyed, n)
    open_buckets = F.broadcast(open_buckets)  # at most BUCKETS rows per column
    others = keyed.join(open_buckets, ["column", "bucket"], "left_semi").join(F.broadcast(candidates), ["column", "key"], "left_anti")
    counts = exact.unionByName(others.groupBy("column", "key").agg(F.count("*").alias("count")))
    parts = F.split("key", "\u0000", -1)
    counts = counts.withColumns({"digest": F.nullif(F.element_at(parts, -1), F.lit("")), "start": F.expr("substring(key, 1, length(key) - 1 - length(element_at(split(key, '\\u0000', -1), -1)))")})
    # Long texts with an equal start are put in order when they are whole.
    by_start = Window.partitionBy("column").orderBy(F.desc("count"), "start")
    first = durable(counts.withColumn("rank", F.rank().over(by_start)).filter(F.col("rank") <= n).drop("rank", "key"))
    texts = melt(df, columns).filter(F.length("value") > LONG_TEXT).withColumn("digest", F.sha2("value", 256))
    wanted = first.filter("digest is not null").select("column", "digest")
    whole = texts.join(wanted, ["column", "digest"], "left_semi").groupBy("column", "digest").agg(F.any_value("value").alias("whole"))
    named = first.join(whole, ["column", "digest"], "left").withColumn("value", F.coalesce("whole", "start"))
    order = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    return named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select("column", "rank", "value", "count")


def spread_and_top(counts: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """``distribution`` and ``top_values`` of ``digest_counts`` from one query, so that the counts are shuffled once.

    Both results are small: a row per column, and n rows per column.
    """
    both = as_local(union_all([
        distribution(counts).withColumn("part", F.lit("spread")),
        top_values(counts, n).withColumn("part", F.lit("top")),
    ]))
    return (
        both.filter(F.col("part") == "spread").select("column", "distinct_count", "total", "entropy"),
        both.filter(F.col("part") == "top").select("column", "rank", "value", "count", "digest"),
    )


def relative_frequencies(counts: DataFrame) -> DataFrame:
    """Value counts as shares of the column's non-null values."""
    totals = counts.groupBy("column").agg(F.sum("count").alias("total"))
    return counts.join(F.broadcast(totals), "column").select(
        "column", "value", "count", (F.col("count") / F.col("total")).alias("share")
    )


def modes(counts: DataFrame) -> DataFrame:
    """The most frequent value per column; the smallest on ties."""
    return top_values(counts, 1).select("column", F.col("value").alias("mode"), "count")
