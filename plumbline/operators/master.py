"""Master data: source tags, entity resolution and deduplication."""

from __future__ import annotations

import itertools
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import col
from plumbline.operators import duplicates
from plumbline.operators.layout import lookup, row_digest
from plumbline.sources.state import durable, stored


class Deduplicated(NamedTuple):
    table: DataFrame
    report: DataFrame


def tag_source(df: DataFrame, source_system: str = "UNKNOWN_SYSTEM", tagged_at: str | None = None) -> DataFrame:
    """Add the lineage columns that are absent."""
    moment = F.lit(tagged_at).cast("timestamp") if tagged_at else F.current_timestamp()
    wanted = {"source_system": F.lit(source_system), "created_date": moment, "modified_date": moment}
    return df.withColumns({n: c for n, c in wanted.items() if n not in df.columns})


def key_digest(c: Column, kind: str = "text") -> Column:
    """A 32-byte digest of a key's comparable form, so that no long text is shuffled; null where nothing is left."""
    return F.unhex(F.sha2(match_key(c, kind), 256))


def match_key(c: Column, kind: str = "text") -> Column:
    """A key in comparable form; null where nothing is left."""
    text = c.cast("string")
    plain = F.regexp_replace(text, r"[^0-9]", "") if kind == "phone" else F.lower(F.trim(text))
    return F.when(plain != "", plain)


def resolve_by_key(df: DataFrame, key: str, record_id: str, kind: str = "text") -> DataFrame:
    """Rows with equal keys are one entity, named by its smallest record id.

    A row without a key is an entity of its own.
    """
    keyed = df.withColumn("_match", key_digest(col(key), kind))
    smallest = keyed.filter(F.col("_match").isNotNull()).groupBy("_match").agg(
        F.min(col(record_id)).alias("_entity"), F.count("*").alias("_n"))
    shared = smallest.filter(F.col("_n") > 1)
    named = lookup(keyed, shared, "_match", "left", hot_by="_n")
    return named.withColumn("entity_id", F.coalesce("_entity", col(record_id))).drop("_match", "_entity", "_n")


def components(links: DataFrame) -> DataFrame:
    """Connected components of (node, link) pairs, as (node, root).

    Nodes that share a link value belong together.  In every round each node
    moves to the neighbour with the smallest hash of that round, and the pairs
    are contracted, so that chains of any length shrink by a constant factor.
    """
    pairs = stored(links.distinct(), "pairs")
    steps = []
    for turn in itertools.count():
        rank = F.struct(F.xxhash64(F.col("node"), F.lit(turn)).alias("h"), F.col("node").alias("node"))
        best = pairs.groupBy("link").agg(F.min(rank).alias("best"), F.count("*").alias("n"))
        best = stored(best.filter(F.col("n") > 1), "best")
        if best.isEmpty():
            break
        live = stored(lookup(pairs, best, "link", stored=True, hot_by="n"), "live")
        step = stored(live.groupBy("node").agg(F.min("best").alias("b")).select("node", F.col("b.node").alias("hop")), "step")
        steps.append(step)
        moved = lookup(live.select("node", "link"), step, "node", stored=True)
        pairs = stored(moved.select(F.col("hop").alias("node"), "link").distinct(), "pairs")
    if not steps:
        return links.select("node", F.col("node").alias("root")).limit(0)
    roots = steps[-1].select("node", F.col("hop").alias("root"))
    for step in reversed(steps[:-1]):
        later = stored(roots.select(F.col("node").alias("hop"), "root"), "roots")
        roots = lookup(step, later, "hop", "left", stored=True).select("node", F.coalesce("root", "hop").alias("root"))
    return roots


def _without_char(text: str, i: str) -> str:
    return f"concat(substring({text}, 1, {i} - 1), substring({text}, {i} + 1))"


def _each(i: str, below: str, body: str) -> str:
    """``body`` for every place ``i`` of a key of ``below`` characters; none if there is no place."""
    return f"transform(filter(sequence(1, greatest(1, {below})), {i} -> {i} <= {below}), {i} -> {body})"


def _link(tag: str, text: str, anchor: bool) -> str:
    return f"named_struct('link', unhex(md5(concat({tag}, ':', {text}))), 'anchor', {str(anchor).lower()})"


def edit_links(key: str, distance: int) -> Column:
    """Links of a key, array of (link, anchor): two keys are within the edit distance exactly if they share a link that is an anchor of one.

    A key within one or two edits of another becomes equal to it when at most that many characters are taken out
    of both. A link names those that are left and, for substitutions, their places, so no pair of keys needs to be compared. All keys of a
    link are within the distance of each of its anchors; a link without an anchor says nothing. A key of n characters has about 2n
    links for distance 1 and 2n * n for distance 2.
    """
    if distance not in (1, 2):
        raise ValueError("the distance is 1 or 2")
    one, n = _without_char("k", "i"), "length(k)"
    if distance == 1:
        parts = [
            # A substitution leaves the same rest at the same place.
            _each("i", n, _link("concat('s', i)", one, True)),
            # An insertion: the shorter key is the anchor.
            _each("i", n, _link("'d'", one, False)), f"array({_link("'d'", 'k', True)})",
        ]
    else:
        two = _without_char(f"({_without_char('k', 'j')})", "i")
        mixed = _without_char(f"({one})", "j")
        parts = [
            # One edit, or one character taken out and one put in elsewhere.
            _each("i", n, _link("'e'", one, True)), f"array({_link("'e'", 'k', True)})",
            # Two substitutions, and two insertions.
            f"flatten({_each('j', n, _each('i', 'j - 1', _link("concat('s', i, ',', j)", two, True)))})",
            f"flatten({_each('j', n, _each('i', 'j - 1', _link("'d'", two, False)))})", f"array({_link("'d'", 'k', True)})",
            # A character put in and a substitution at place j of what is left.
            f"flatten({_each('i', n, _each('j', f'{n} - 1', _link("concat('x', j)", mixed, False)))})",
            _each("j", n, _link("concat('x', j)", _without_char("k", "j"), True)),
        ]
    return F.expr(f"transform(array(`{key}`), k -> array_distinct(concat({', '.join(parts)})))[0]")


def resolve_similar(df: DataFrame, key: str, record_id: str, distance: int = 1, kind: str = "text", longest: int = 64) -> DataFrame:
    """Rows whose keys are joined by steps of at most ``distance`` edits (1 or 2) are one entity, named by its smallest record id.

    An edit puts in, takes out or replaces one character of the comparable form of the key. Distinct keys are linked by ``edit_links``
    and contracted by ``components``: no pairs are formed, so the work grows with the keys and not with the size of a
    cluster. A row without a key is an entity of its own. Keys of more than ``longest`` characters fail the query,
    because links grow with the square of the length; none is left out silently.
    """
    keyed = df.withColumn("_match", match_key(col(key), kind))
    fits = F.length("_match") <= longest
    checked = F.when(fits, F.col("_match")).otherwise(F.raise_error(F.lit(f"a key of {key} has more than {longest} characters")))
    keys = stored(keyed.filter(F.col("_match").isNotNull()).withColumn("_match", checked).groupBy("_match").agg(
        F.min(col(record_id)).alias("_first"), F.count("*").alias("_n")), "keys")
    links = stored(keys.select(F.col("_match").alias("node"), F.inline(edit_links("_match", distance))), "links")
    told = links.groupBy("link").agg(F.count("*").alias("n"), F.bool_or("anchor").alias("told")).filter("n > 1 and told").select("link", "n")
    roots = stored(components(lookup(links.drop("anchor"), told, "link", hot_by="n").select("node", "link")), "roots")
    rooted = lookup(keys, roots.withColumnRenamed("node", "_match"), "_match", "left")
    rooted = stored(rooted.select("_match", "_first", "_n", F.coalesce("root", "_match").alias("_root")), "rooted")
    names = rooted.groupBy("_root").agg(F.min("_first").alias("_entity"), F.count("*").alias("_keys"))
    named = lookup(rooted, names, "_root", hot_by="_keys").select("_match", "_entity", "_n")
    found = lookup(keyed, named, "_match", "left", hot_by="_n")
    return found.select(*[col(n) for n in df.columns], F.coalesce("_entity", col(record_id)).alias("entity_id"))


def resolve_entities(df: DataFrame, keys: dict[str, str], record_id: str) -> DataFrame:
    """Rows linked by any of several keys are one entity.

    ``keys`` maps column names to ``text`` or ``phone``.
    """
    if len(keys) == 1:
        (key, kind), = keys.items()
        return resolve_by_key(df, key, record_id, kind)
    links = None
    for i, (key, kind) in enumerate(keys.items()):
        digest = F.unhex(F.sha2(F.concat(F.lit(f"{i}:"), match_key(col(key), kind)), 256))
        part = df.select(col(record_id).alias("node"), digest.alias("link"))
        part = part.filter(F.col("link").isNotNull())
        links = part if links is None else links.unionByName(part)
    roots = durable(components(links))
    names = roots.groupBy("root").agg(F.min("node").alias("entity_id"), F.count("*").alias("members"))
    members = lookup(roots, names, "root", hot_by="members").select(F.col("node").alias(record_id), "entity_id")
    joined = df.join(members, record_id, "left")
    return joined.withColumn("entity_id", F.coalesce("entity_id", col(record_id))).select(
        *[col(n) for n in df.columns], "entity_id")


def deduplicate(df: DataFrame, subset: list[str] | None = None, order_by: list[str] | None = None) -> DataFrame:
    """The first row of each group of equal rows.

    Whole rows are equal copies, so any of them serves.  For a subset the first
    row in the given order is kept; Spark keeps one row per group and task
    before the shuffle.
    """
    if not subset:
        return df.dropDuplicates()
    first = Window.partitionBy("_group").orderBy(*[col(c) for c in (order_by or df.columns)])
    return (
        df.withColumn("_group", row_digest(df, subset))
        .withColumn("_rank", F.row_number().over(first))
        .filter(F.col("_rank") == 1)
        .drop("_group", "_rank"))


def deduplicate_with_report(df: DataFrame, subset: list[str] | None = None, order_by: list[str] | None = None) -> Deduplicated:
    summary = duplicates.duplicate_summary(df, subset).select(
        F.col("row_count").alias("original_rows"), "unique_rows", F.col("duplicate_rows").alias("removed_rows"))
    return Deduplicated(deduplicate(df, subset, order_by), summary)


def distinct_items(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a list column."""
    return df.select(col(column)).distinct()
