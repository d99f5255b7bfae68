"""Near duplicates by SimHash fingerprints and vantage-point trees over their Hamming distance.

A fingerprint's bit is 1 if most of the text's shingles have it in their XXH64. Equal fingerprints are one node from the start.
A vantage-point tree parts the nodes: at each branch those within a radius of the vantage point go inside, the others outside.
Its leaves are the shards. By the triangle inequality a node inside can only have a link to the outside if it lies less
than REACH within the radius; such nodes visit the shards beyond the boundary as queries, so each pair of nodes that may be linked meets in
one shard, and the search is exact. Inside a shard the same partition goes on in memory, down to groups that are compared outright.

The upper tree is fitted on at most SAMPLE nodes (chosen by a hash); every node is put into it. Its leaves grow with the square
root of the nodes, up to LEAVES: each more level of shards makes nodes visit two thirds more of them, while levels inside a task cost no shuffle. A
large shard, also one that no vantage point can part, is searched in blocks of bounded size. A task gives a spanning forest of the links
it finds, not all pairs, so a cluster of k nodes gives less than k rows a task.

The work grows with about the 1.75th power of the number of distinct fingerprints if these are spread like random ones (a
branch then spares a sixth of the pairs); copies add nothing.

Defined cases. A null or empty text, or one without words, has fingerprint zero, which is linked like any other. Rows that repeat a doc_id
follow their own texts. Rows without a doc_id link others as well; a component without any doc_id has a null id. Long texts
are read whole. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.components import components
from plumbline.llm.support import attach, map_steps, mixed, stored

WIDTH, SEED, REACH = 4, 42, 4
# Bounds of the fitted upper tree, and of the blocks that a larger shard is searched in.
SAMPLE, LEAVES = 200_000, 1024
BLOCK_HOMES, BLOCK_QUERIES = 1 << 16, 1 << 16
# In a task: groups up to this size are compared outright, so many pairs at a time.
GROUP, STEP_PAIRS = 128, 1 << 18
EDGES = 1 << 20


class Branch(NamedTuple):
    point: int
    radius: int
    inside: Branch | int
    outside: Branch | int


def shingle_hashes(text: bytes, width: int = WIDTH) -> list[int]:
    """XXH64 of each shingle of ``width`` words, joined by spaces; a shorter text is one shingle."""
    words = text.split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = list(accumulate(words, lambda at, w: at + 1 + len(w), initial=-1))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a + 1:b], SEED) for a, b in zip(ends, ends[width:])]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A fingerprint for each run of hashes: the bits that more than half of them have; 0 for an empty run."""
    votes = np.zeros((len(counts), 64), np.int64)
    filled = np.flatnonzero(counts)
    if len(filled):
        starts = (np.cumsum(counts) - counts)[filled]
        per_byte = hashes.view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            bits = np.unpackbits(np.ascontiguousarray(per_byte[:, byte])[:, None], axis=1, bitorder="little")
            votes[filled, 8 * byte:8 * byte + 8] = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    return np.packbits(votes * 2 > counts[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _fingerprints(width: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pc.cast(pc.ascii_lower(pc.fill_null(batch.column("text"), "")), pa.binary()).to_pylist()
        lists = [shingle_hashes(t, width) for t in texts]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((h for x in lists for h in x), np.uint64, int(counts.sum()))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(majority(flat, counts).view(np.int64), pa.int64())], names=["doc_id", "code"])
    return run


def distances(points: np.ndarray, to: int) -> np.ndarray:
    return np.bitwise_count(points ^ np.uint64(to)).astype(np.int16)


def split(points: np.ndarray, tries: int = 4) -> tuple[int, int] | None:
    """A vantage point among the points and a radius with points on both sides; None if all lie at one distance from each tried."""
    best = None
    for point in points[np.argsort(mixed(points[:4096]))[:tries]]:
        d = distances(points, point)
        radius = int(np.median(d))
        radius -= int(radius == d.max())
        if d.min() <= radius:
            near = ((d > radius - REACH) & (d <= radius + REACH)).sum()
            if best is None or near < best[0]:
                best = near, int(point), radius
    return best[1:] if best else None


def shards(nodes: int) -> int:
    return max(1, min(LEAVES, round(nodes ** 0.5 / 16)))


def plant(sample: np.ndarray, leaves: int) -> Branch | int:
    """A tree with at most so many leaves, which hold about as many points of the sample each."""
    ends = 0

    def grow(part: np.ndarray, share: int) -> Branch | int:
        nonlocal ends
        cut = split(part) if share > 1 and len(part) >= 16 else None
        if cut is None:
            ends += 1
            return ends - 1
        inside = distances(part, cut[0]) <= cut[1]
        left = min(share - 1, max(1, round(share * inside.mean())))
        return Branch(*cut, grow(part[inside], left), grow(part[~inside], share - left))

    return grow(sample, leaves)


def route(tree: Branch | int, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the point, leaf, home): each point's own leaf, and those that it visits."""
    out, stack = [], [(tree, np.arange(len(points)), np.ones(len(points), bool))]
    while stack:
        node, at, home = stack.pop()
        if not len(at):
            continue
        if not isinstance(node, tuple):
            out.append((at, np.full(len(at), node, np.int32), home))
            continue
        d = distances(points[at], node.point)
        inside = d <= node.radius
        visits_in = ~home & (d - REACH <= node.radius)
        visits_out = (~home | inside) & (d + REACH > node.radius)
        go_in, go_out = (home & inside) | visits_in, (home & ~inside) | visits_out
        stack.append((node.inside, at[go_in], home[go_in]))
        stack.append((node.outside, at[go_out], (home & ~inside)[go_out]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*out))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of n nodes can reach over the edges."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label != label[label]).any():
            label = label[label]
    return label


def linked(homes: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (point, least point of its tree) of the links between homes and queries. Homes are distinct."""
    points = np.unique(np.concatenate([homes, queries]))
    label = np.arange(len(points))
    edges, held = [np.zeros((2, 0), np.int64)], 0
    stack = [(np.searchsorted(points, homes), np.searchsorted(points, np.unique(queries)))]
    while stack:
        h, q = stack.pop()
        if not len(h) or not len(q):
            continue
        cut = split(points[h]) if len(h) > GROUP else None
        if cut is not None:
            dh, dq = distances(points[h], cut[0]), distances(points[q], cut[0])
            inside = dh <= cut[1]
            stack.append((h[inside], q[dq - REACH <= cut[1]]))
            stack.append((h[~inside], q[dq + REACH > cut[1]]))
            continue
        for i in range(0, len(h), 1024):
            some = h[i:i + 1024]
            step = max(1, STEP_PAIRS // len(some))
            for j in range(0, len(q), step):
                rows = q[j:j + step]
                if label[some[0]] == label[some].max() == label[rows].min() == label[rows].max():
                    continue  # all of one component already
                at, to = np.nonzero(np.bitwise_count(points[rows][:, None] ^ points[some][None, :]) <= REACH)
                if not len(at):
                    continue
                # Each query is linked to its first home, and each of its homes to the next one.
                first = np.concatenate([[True], at[1:] != at[:-1]])
                follows = np.unique(to[:-1][~first[1:]] * len(some) + to[1:][~first[1:]])
                new = np.concatenate([np.stack([rows[at[first]], some[to[first]]]),
                                      np.stack([some[follows // len(some)], some[follows % len(some)]])], axis=1)
                edges.append(new[:, new[0] != new[1]])
                held += edges[-1].shape[1]
                if held > EDGES:
                    label = forest(len(points), *np.concatenate([*edges, np.stack([np.arange(len(points)), label])], axis=1))
                    edges, held = [np.zeros((2, 0), np.int64)], 0
    label = forest(len(points), *np.concatenate([*edges, np.stack([np.arange(len(points)), label])], axis=1))
    moved = np.flatnonzero(label != np.arange(len(points)))
    return points[moved], points[label[moved]]


def _routed(tree: Branch | int):
    def run(batches):
        for batch in batches:
            codes = batch.column("code").to_numpy(zero_copy_only=False)
            for start in range(0, len(codes), 4096):
                part = codes[start:start + 4096]
                at, leaf, home = route(tree, part.view(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[at], pa.int64()), pa.array(leaf, pa.int32()), pa.array(home)], names=["code", "leaf", "home"])
    return run


def _search(table: pa.Table) -> pa.Table:
    codes = table.column("code").to_numpy().view(np.uint64)
    side = table.column("side").to_numpy()
    a, b = linked(codes[side != 1], codes[side != 0])
    return pa.table({"a": pa.array(a.view(np.int64), pa.int64()), "b": pa.array(b.view(np.int64), pa.int64())})


def links(codes: DataFrame, leaves: int | None = None, block_homes: int = BLOCK_HOMES, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """Links (a, b) that join the same distinct fingerprints (``code``) as all pairs within REACH bits do."""
    spark = codes.sparkSession
    total = codes.count()
    # As many by their hash as SAMPLE on average; the same ones in each run.
    share = min(1.0, SAMPLE / max(total, 1))
    chosen = codes.where(F.pmod(F.xxhash64(F.lit(11), "code"), F.lit(1 << 30)) < int(share * (1 << 30)) + (share == 1.0))
    sample = np.sort(np.array([r[0] for r in chosen.collect()], np.int64)).view(np.uint64)
    placed = stored(codes.mapInArrow(_routed(plant(sample, leaves or shards(total))), "code bigint, leaf int, home boolean"), "simhash-placed")
    sizes = placed.groupBy("leaf").agg(F.count_if("home").alias("homes"), F.count(F.lit(1)).alias("queries")).where("homes > 0").select(
        F.col("leaf"), F.ceil(F.col("homes") / block_homes).alias("hs"), F.ceil(F.col("queries") / block_queries).alias("qs"))
    # At most LEAVES rows.
    rows = placed.join(F.broadcast(sizes), "leaf")
    own = F.pmod(F.xxhash64(F.lit(12), "code"), F.col("hs"))
    asks = F.pmod(F.xxhash64(F.lit(13), "code"), F.col("qs"))
    # Block (x, y) searches the homes of chunk x for the queries of chunk y. side: 0 home, 1 query, 2 both.
    zero = F.lit(0).cast("bigint")
    as_home = F.transform(F.sequence(zero, F.col("qs") - 1), lambda y: F.struct(own.alias("x"), y.alias("y"), F.when(y == asks, 2).otherwise(0).alias("side")))
    as_query = F.transform(F.sequence(zero, F.col("hs") - 1), lambda x: F.struct(x.alias("x"), asks.alias("y"), F.lit(1).alias("side")))
    elsewhere = F.filter(as_query, lambda s: s["x"] != own)
    blocks = rows.select("leaf", "code", F.explode(F.when(F.col("home"), F.concat(as_home, elsewhere)).otherwise(as_query)).alias("at"))
    return blocks.select("leaf", "code", "at.*").groupBy("leaf", "x", "y").applyInArrow(_search, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Each document with its fingerprint and the least doc_id of its component."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = stored(map_steps(rows, _fingerprints(width), "doc_id bigint, code bigint"), "simhash-codes")
    groups = stored(prints.groupBy("code").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size")), "simhash-groups")
    whole = components(stored(links(groups.select("code")), "simhash-links"))
    placed = stored(groups.join(whole, F.col("code") == F.col("node"), "left").select(
        "code", "least", "size", F.coalesce("component", "code").alias("component")), "simhash-components")
    # A component's rows are counted, not gathered; its least id comes back to its fingerprints by a lookup safe for hot keys.
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("nodes"))
    key = F.encode(F.hex("component"), "UTF-8")
    named = attach(placed.withColumn("mark", key), least.select(key.alias("mark"), "component_id", "nodes"), "mark", "nodes", groups.count(), F.col("code"))
    named = stored(named.select(F.encode(F.hex("code"), "UTF-8").alias("mark"), "component_id", "size"), "simhash-named")
    out = attach(prints.withColumn("mark", F.encode(F.hex("code"), "UTF-8")), named, "mark", "size", prints.count(), F.col("doc_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")
