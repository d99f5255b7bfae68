"""Near-duplicate components by SetSketch registers.

A text's set of word shingles is sketched once. A register keeps the least of exponentially distributed values of the
shingles, on an exponentially spaced and truncated scale. Sketches of parts merge by the larger register; equal registers
are likely for similar sets. Bands of register values give candidates, the joint likelihood of larger, equal and smaller
registers estimates the Jaccard similarity of a candidate pair, and what may reach the limit is confirmed on the full sets.

Texts with equal sets are one class from the start. In a band's bucket every member is compared with the bucket's least
member. What this leaves in different components is compared in blocks of bounded size, first by the sketches and then by the
sets' SAMPLE smallest hashes, which are the whole set of most texts. Only pairs between components that may reach the limit
leave a block, and each pair is looked at in the first of its common buckets only. So no bucket is cut short and no list of all pairs within a bucket is made.

Shingles are compared by a 64-bit hash. With 20 bands of 5 registers, a pair at 0.85 shares no bucket with probability
(1 - 0.85**5)**20 = 8e-6, a more similar one more rarely. A pair with a leader must also pass the registers' estimate (0.13 of
slack, over four of its standard deviations: 2e-5 at 0.85); any other pair the estimate and, beyond 256 shingles, the sample (0.09, four
deviations: 3e-5). Together at most 6e-5 for a pair exactly at the limit; other links of its component heal most of these.

Defined cases. A null or empty text, or one without words, has an empty set and is linked with nothing. Rows that
repeat a doc_id with an equal text are marked alike; with different texts each row follows its own text, and classes that
the id is the least of are linked. Rows without a doc_id only follow rows with an equal set. An empty table gives an empty
result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.components import components
from plumbline.llm.support import attach, codes_of, columns_of, join_spread, map_steps, mixed, released, stored, unused, words_of

REGISTERS = 160
# SetSketch parameters: base and rate of the scale, and its largest value.
BASE, RATE, TOP = 1.001, 20.0, 65535
# Candidates need an estimate within SLACK of the limit; blocks of candidates hold about BLOCK sketches.
SLACK = 0.13
BLOCK = 512
# Smallest hashes kept of a set; an estimate from that many is off by 0.022 or so, SAMPLE_SLACK is four times that.
SAMPLE = 256
SAMPLE_SLACK = 0.09
NO_HASH = np.uint32(2**32 - 1)


class Limits(NamedTuple):
    """Links need 100 * intersection >= percent * union of the sets of shingles of ``width`` words."""

    width: int = 3
    percent: int = 85
    bands: int = 20
    rows: int = 5

    @property
    def likely(self) -> float:
        return self.percent / 100 - SLACK


_random = np.random.default_rng(20240131)
_FACTORS = _random.integers(0, 2**63, REGISTERS, np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _random.integers(0, 2**63, REGISTERS, np.uint64)
_PLACES = _random.integers(0, 2**63, 16, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(text: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of ``width`` words; a shorter text is one shingle."""
    flat, counts = words_of(pc.ascii_lower(pc.fill_null(text, "")))
    codes, values = codes_of(flat)
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in pc.cast(values, pa.binary()).to_pylist()), np.uint64, len(values))
    word = known[codes]
    runs = np.zeros(max(0, len(word) - width + 1), np.uint64)
    for k in range(width):
        runs += word[k:len(word) - width + 1 + k] * _PLACES[k]
    runs = mixed(runs)
    out, start = [], 0
    for n in counts:
        if n >= width:
            out.append(np.unique(runs[start:start + n - width + 1]))
        elif n:
            out.append(mixed(np.array([(word[start:start + n] * _PLACES[:n]).sum() + np.uint64(n)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        start += n
    return out


def registers(hashes: np.ndarray) -> np.ndarray:
    """The SetSketch of a set of hashes. The larger register of two sketches is that of the sets' union."""
    least = np.full(REGISTERS, 2**64 - 1, np.uint64)
    for start in range(0, len(hashes), 1024):
        part = hashes[start:start + 1024]
        np.minimum(least, (_FACTORS[:, None] * part + _OFFSETS[:, None]).min(axis=1), out=least)
    value = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64 * (1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, TOP).astype(np.uint16)


def sample(hashes: np.ndarray) -> np.ndarray:
    """The upper halves of a set's smallest hashes, in order."""
    return np.minimum((hashes[:SAMPLE] >> np.uint64(32)).astype(np.uint32), NO_HASH - 1)


def sampled_similarity(one: np.ndarray, others: np.ndarray, full: bool, full_others: np.ndarray) -> np.ndarray:
    """Jaccard similarity of a set and others by their samples; NO_HASH fills the rows. full: there are more hashes than that."""
    last = np.where(full_others, np.max(np.where(others == NO_HASH, 0, others), axis=1), NO_HASH - 1)
    last = np.minimum(last, one[-1] if full else NO_HASH - 1)[:, None]
    inside = others <= last
    at = np.minimum(np.searchsorted(one, others), len(one) - 1)
    both = ((one[at] == others) & inside).sum(axis=1)
    return both / (np.searchsorted(one, last[:, 0], side="right") + inside.sum(axis=1) - both)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The Jaccard similarity at which the registers of pairs of sets with known sizes are most likely."""
    return estimate_counts((a > b).sum(axis=-1), (a < b).sum(axis=-1), n_a, n_b)


def may_reach(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, limits: Limits) -> np.ndarray:
    """Which pairs' estimates may reach the limit.

    The estimate is close to the share of equal registers, so the likelihood is only solved for pairs near the limit or above.
    """
    near = np.flatnonzero((a == b).sum(axis=-1) >= (limits.likely - 0.05) * REGISTERS)
    rows = [np.broadcast_to(x, b.shape)[near] for x in (a, b)]
    sizes = [np.broadcast_to(x, b.shape[:1])[near] for x in (n_a, n_b)]
    out = np.zeros(len(b), bool)
    out[near] = estimate(*rows, *sizes) >= limits.likely
    return out


def estimate_counts(more: np.ndarray, fewer: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    u = n_a / (n_a + n_b)
    v = 1 - u
    equal = REGISTERS - more - fewer

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        up, down = p(u - v * j), p(v - u * j)
        with np.errstate(divide="ignore", invalid="ignore"):
            parts = [np.where(n > 0, n * np.log(np.maximum(q, 1e-300)), 0.0)
                     for n, q in ((more, up), (fewer, down), (equal, 1 - up - down))]
        return parts[0] + parts[1] + parts[2]

    low, high = np.zeros(np.shape(u)), np.minimum(u / v, v / u)
    for _ in range(18):
        left, right = low + (high - low) * 0.382, low + (high - low) * 0.618
        rising = likelihood(left) < likelihood(right)
        low, high = np.where(rising, left, low), np.where(rising, high, right)
    return (low + high) / 2


def _sketch(width: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column("text"), width)
        return pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("mark"), pa.array([len(s) for s in sets], pa.int64()),
            pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
            pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary()),
            pa.array([sample(s).tobytes() if len(s) else None for s in sets], pa.binary()),
        ], names=["doc_id", "mark", "n_shingles", "set_digest", "sketch", "sample"])
    return run


def _table(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), REGISTERS)


def _buckets(limits: Limits):
    """(bucket, node): a row for each band of each sketch. A bucket's first byte is its band."""
    def run(batches):
        for batch in batches:
            bands = _table(batch.column("sketch"))[:, :limits.bands * limits.rows].reshape(-1, limits.bands, limits.rows).astype(np.uint64)
            key = np.broadcast_to(np.arange(1, limits.bands + 1, dtype=np.uint64), bands.shape[:2]) * _PLACES[15]
            for k in range(limits.rows):
                key = key + (bands[:, :, k] + np.uint64(1)) * _PLACES[k]
            raw = mixed(key.ravel()).tobytes()
            yield pa.RecordBatch.from_arrays([
                pa.array([bytes([i // 8 % limits.bands]) + raw[i:i + 8] for i in range(0, len(raw), 8)], pa.binary()),
                batch.column("node").take(pa.array(np.repeat(np.arange(batch.num_rows), limits.bands))),
            ], names=["bucket", "node"])
    return run


def _likely(limits: Limits):
    """The pairs whose estimate may reach the limit."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                sizes = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("n_a", "n_b")]
                likely = may_reach(_table(batch.column("sketch_a")), _table(batch.column("sketch_b")), *sizes, limits)
                yield batch.select(["a", "b"]).filter(pa.array(likely))
    return run


def _confirmed(limits: Limits):
    def run(batches):
        for whole in batches:
            # Rows come in order of a: its text is shingled once per run.
            for start in range(0, whole.num_rows, 64):
                batch = whole.slice(start, 64)
                a = batch.column("text_a").dictionary_encode()
                left = shingle_sets(a.dictionary, limits.width)
                right = shingle_sets(batch.column("text_b"), limits.width)
                keep = []
                for i, other in zip(a.indices.to_pylist(), right):
                    both = np.intersect1d(left[i], other, assume_unique=True).size
                    keep.append(both > 0 and 100 * both >= limits.percent * (len(left[i]) + len(other) - both))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def confirm(pairs: DataFrame, docs: DataFrame, limits: Limits) -> DataFrame:
    """The pairs (a, b) whose full sets reach the limit. docs: node, text."""
    pairs = stored(pairs, "near-pairs")
    used = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "near-used")
    texts = docs.join(used, "node", "left_semi")
    one = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    # A leader of a large bucket stands in many pairs.
    two = join_spread(one, texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a", F.col("b"), pairs)
    return two.select("a", "b", "text_a", "text_b").mapInArrow(released(_confirmed(limits)), "a bigint, b bigint").distinct()


def _sketched(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    def side(name: str) -> DataFrame:
        return classes.select(F.col("node").alias(name), F.col("n_shingles").alias(f"n_{name}"), F.col("sketch").alias(f"sketch_{name}"))
    pairs = stored(pairs, "near-stars-asked")
    return join_spread(pairs, side("a"), "a", F.col("b"), pairs).join(side("b"), "b")


def _between(limits: Limits):
    """Pairs of one block between different components that may reach the limit."""
    def facts(table: pa.Table):
        samples = [np.frombuffer(x, np.uint32) for x in table.column("sample").to_pylist()]
        filled = np.full((len(samples), SAMPLE), NO_HASH, np.uint32)
        for i, x in enumerate(samples):
            filled[i, :len(x)] = x
        size = table.column("n_shingles").to_numpy().astype(np.float64)
        return (_table(table.column("sketch").combine_chunks()), size, table.column("node").to_numpy(),
                table.column("component").to_numpy(), filled, size > SAMPLE)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        band = key[0].as_py()[0]
        left, right = table.filter(pc.field("side") == 0), table.filter(pc.field("side") == 1)
        sketch, size, node, component, hashes, full = facts(left)
        sketch2, size2, node2, component2, hashes2, full2 = facts(right if right.num_rows else left)
        found = [np.zeros((2, 0), np.int64)]
        banded = limits.bands * limits.rows
        for i in range(len(node)):
            other = np.flatnonzero(component2 != component[i])
            same = (sketch2[other, :banded] == sketch[i, :banded]).reshape(-1, limits.bands, limits.rows).all(axis=2)
            other = other[same.argmax(axis=1) == band]
            other = other[may_reach(sketch[i], sketch2[other], size[i], size2[other], limits)]
            if len(other):
                one = hashes[i][hashes[i] != NO_HASH]
                near = sampled_similarity(one, hashes2[other], full[i], full2[other])
                slack = np.where(full[i] | full2[other], SAMPLE_SLACK, 0.005)
                hit = node2[other[near >= limits.percent / 100 - slack]]
                found.append(np.stack([np.minimum(node[i], hit), np.maximum(node[i], hit)]))
        a, b = np.unique(np.concatenate(found, axis=1), axis=1)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run


def _rest(members: DataFrame, known: DataFrame, classes: DataFrame, limits: Limits) -> DataFrame:
    """Likely pairs between different components within buckets. members: bucket, node, without each bucket's leader."""
    placed = members.join(known, "node", "left")
    placed = stored(placed.select("bucket", "node", F.coalesce("component", "node").alias("component")), "near-placed")
    counts = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed_ = counts.groupBy("bucket").agg(
        F.max_by("component", "n").alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n_all"),
        F.count(F.lit(1)).alias("parts")).where(F.col("parts") > 1)
    rows = attach(placed, mixed_.drop("parts"), "bucket", "n_all", placed.count(), F.col("node")).where(F.col("n_all").isNotNull())
    others = F.ceil((F.col("n_all") - F.col("n_main")) / BLOCK)
    mains = F.ceil(F.col("n_main") / BLOCK)
    draw = F.xxhash64(F.lit(7), F.col("node"))
    own = F.pmod(draw, F.when(F.col("component") == F.col("main"), mains).otherwise(others))
    rows = rows.select("bucket", "node", "component", (F.col("component") == F.col("main")).alias("is_main"), own.alias("own"),
                       others.alias("others"), mains.alias("mains"))
    # A block is (x, y): chunk x of the others with chunk y of the others (y >= 0), or with chunk -1 - y of the main component.
    chunks = F.sequence(F.lit(0).cast("bigint"), F.col("others") - 1)
    as_left = F.transform(
        F.concat(F.filter(chunks, lambda y: y >= F.col("own")), F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("mains")), lambda y: -y)),
        lambda y: F.struct(F.col("own").alias("x"), y.alias("y"), F.lit(0).alias("side")))
    as_right = F.transform(F.filter(chunks, lambda x: x < F.col("own")), lambda x: F.struct(x.alias("x"), F.col("own").alias("y"), F.lit(1).alias("side")))
    as_main = F.transform(chunks, lambda x: F.struct(x.alias("x"), (-1 - F.col("own")).alias("y"), F.lit(1).alias("side")))
    blocks = rows.select("bucket", "node", "component", F.explode(
        F.when(F.col("is_main"), as_main).otherwise(F.concat(as_left, as_right))).alias("at")).select("bucket", "node", "component", "at.*")
    full = blocks.join(classes, "node")
    return full.groupBy("bucket", "x", "y").applyInArrow(_between(limits), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Each document with its set size and the least doc_id of its component; ``mark`` is a hash of its text."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = stored(map_steps(rows.withColumn("mark", F.xxhash64("text")), _sketch(limits.width),
                                "doc_id bigint, mark bigint, n_shingles bigint, set_digest binary, sketch binary, sample binary", release=True), "near-sketches")
    groups = stored(sketches.where(F.col("set_digest").isNotNull()).groupBy("set_digest").agg(
        F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("size"), F.first("n_shingles").alias("n_shingles"),
        F.first("sketch").alias("sketch"), F.first("sample").alias("sample")), "near-classes")
    # A doc_id with several texts is one node that may stand for several classes.
    classes = groups.where(F.col("node").isNotNull()).select("node", "n_shingles", "sketch", "sample")
    members = stored(classes.select("node", "sketch").mapInArrow(released(_buckets(limits)), "bucket binary, node bigint").distinct(), "near-buckets")
    leaders = members.groupBy("bucket").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    led = attach(members, leaders, "bucket", "size", members.count(), F.col("node")).where(
        F.col("leader").isNotNull() & (F.col("node") != F.col("leader")))
    led = stored(led.select("bucket", "node", "leader"), "near-led")
    texts = rows.withColumnRenamed("doc_id", "node")
    stars = _sketched(led.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), classes)
    stars = stored(stars.mapInArrow(released(_likely(limits)), "a bigint, b bigint").distinct(), "near-stars")
    links = stored(confirm(stars, texts, limits), "near-links")
    known = stored(components(links), "near-known")
    rest = stored(_rest(led.select("bucket", "node"), known, classes, limits), "near-rest")
    more = confirm(rest.join(stars, ["a", "b"], "left_anti"), texts, limits)
    whole = components(links.union(more))
    found = groups.join(whole, "node", "left").select("set_digest", "size", F.coalesce("component", "node").alias("component"))
    out = attach(sketches.drop("sketch", "sample"), found, "set_digest", "size", sketches.count(), F.col("doc_id"))
    component = F.coalesce(F.col("component"), F.col("doc_id"))
    return out.select("doc_id", "mark", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, limits: Limits) -> DataFrame:
    """One document of each component, with all its columns: the one with the least doc_id.

    Of several rows with that id one stays. Rows without a doc_id stay if no row with an id is in their component.
    """
    id_, mark, own, nth = unused(docs, "id", "mark", "own", "nth")
    verdicts = near_duplicates(docs, limits)
    stay = verdicts.where(F.col("kept") | F.col("component_id").isNull()).select(
        F.col("doc_id").alias(id_), F.col("mark").alias(mark)).distinct()
    marked = docs.withColumn(own, F.xxhash64("text"))
    found = marked.join(stay, F.col("doc_id").cast("bigint").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(mark)))
    # A row's group is its doc_id; rows without one are groups of their own.
    group = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    first = found.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id", group).orderBy(own)))
    return first.where(F.col(nth) == 1).select(*columns_of(docs))
