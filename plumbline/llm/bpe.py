"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary.

A text is split into pieces by the vocabulary's pattern. Each distinct piece is folded once: its bytes start as tokens, and
the adjacent pair whose concatenation has the least rank is merged, the leftmost first, until no pair has a rank. A rank is
a token's id. Decoding concatenates the tokens' bytes.

``encode`` and ``decode`` work on Arrow batches inside tasks, with a bounded memory of folded pieces per task. ``fold_words``
is the same fold as a Spark higher-order function over the byte arrays of a table of words, with the ranks as a literal (a
session variable that holds the map in an array of small maps by hash, because looking a key up in one map is a scan).
README.md has the measured reason why whole corpora do not take that form.

Defined cases. A null text counts as empty and has no tokens. Special tokens are ordinary text. Rows that repeat a document
are encoded each. Ids beyond the vocabulary are an error. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.support import map_steps
from plumbline.sources.state import small_table

BUCKETS = 1 << 16
# Folded pieces that a task remembers, and pieces of a text that it looks at together.
REMEMBERED = 1 << 19
TOGETHER = 1 << 16
# Longer pieces are folded with a queue of pairs.
SHORT = 48


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with a base64 token and its rank on each line; a vocabulary file is at most some MB."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def fold(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a piece's tokens."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) > SHORT:
        return _fold_long(piece, ranks)
    tokens = [piece[i:i + 1] for i in range(len(piece))]
    pairs = [ranks.get(a + b) for a, b in zip(tokens, tokens[1:])]
    while True:
        known = [r for r in pairs if r is not None]
        if not known:
            return [ranks[t] for t in tokens]
        at = pairs.index(min(known))
        tokens[at:at + 2] = [tokens[at] + tokens[at + 1]]
        del pairs[at]
        if at:
            pairs[at - 1] = ranks.get(tokens[at - 1] + tokens[at])
        if at < len(pairs):
            pairs[at] = ranks.get(tokens[at] + tokens[at + 1])


def _fold_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a queue of (rank, place), so that the time grows with n log n."""
    n = len(piece)
    ends = list(range(1, n + 1))  # the end of the token that starts at a place; 0 once it is merged away
    before = list(range(-1, n - 1))
    queue: list[tuple[int, int, int]] = []

    def offer(a: int) -> None:
        b = ends[a]
        if b < n and (rank := ranks.get(piece[a:ends[b]])) is not None:
            heapq.heappush(queue, (rank, a, ends[b]))

    for i in range(n - 1):
        offer(i)
    while queue:
        _, a, end = heapq.heappop(queue)
        b = ends[a]
        if not b or b >= n or ends[b] != end:
            continue
        ends[a], ends[b] = end, 0
        if end < n:
            before[end] = a
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    return [ranks[piece[i:ends[i]]] for i in range(n) if ends[i]]


class _Folded(dict):
    """Packed ids by piece; pieces that are new are folded."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        ids = pack(fold(piece.encode(), self.ranks))
        if len(self) >= REMEMBERED:
            self.clear()
        if len(piece) <= SHORT:
            self[piece] = ids
        return ids


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return b"".join(i.to_bytes(4, "little") for i in ids)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Each document with its tokens: (doc_id, n_tokens, ids), ids packed as little-endian unsigned 32-bit integers."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    remembered: list[_Folded] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not remembered:
            remembered.extend([_Folded(ranks), regex.compile(pattern)])
        folded, pieces = remembered
        out = []
        for text in batch.column("text").to_pylist():
            found = pieces.finditer(text or "")
            parts = []
            while part := b"".join([folded[m.group()] for m in islice(found, TOGETHER)]):
                parts.append(part)
            out.append(b"".join(parts))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(x) // 4 for x in out], pa.int64()), pa.array(out, pa.binary())],
            names=["doc_id", "n_tokens", "ids"])

    return map_steps(rows, run, "doc_id bigint, n_tokens bigint, ids binary")


def decode(tokens: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """The table with the bytes of the packed ``ids`` as ``decoded``."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pieces = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            pieces[rank] = token
        out = []
        for packed in batch.column("ids").to_pylist():
            ids = memoryview(packed or b"").cast("I")
            out.append(b"".join([pieces[i] for i in ids]))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    return map_steps(tokens, run, T.StructType([*tokens.schema.fields, T.StructField("decoded", T.BinaryType())]), "ids")


def digests(decoded: DataFrame) -> DataFrame:
    """Number of tokens, and SHA-256 of the packed ids and of the decoded bytes."""
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def fold_words(words: DataFrame, ranks: dict[bytes, int], name: str = "bpe_ranks") -> DataFrame:
    """The table with the ids of its binary ``word`` column, by a higher-order function and without Python tasks."""
    spark = words.sparkSession
    _declare_ranks(spark, ranks, name)
    table = F.expr(name)

    def rank(token: Column) -> Column:
        return F.try_element_at(F.element_at(table, F.hash(token).bitwiseAND(F.lit(BUCKETS - 1)) + 1), token)

    def let(value: Column, use) -> Column:
        return F.transform(F.array(value), use)[0]

    def merged(tokens: Column) -> Column:
        pairs = F.transform(F.slice(tokens, 1, F.size(tokens) - 1), lambda t, i: rank(F.concat(t, tokens[i + 1])))
        return F.when(F.size(tokens) < 2, tokens).otherwise(let(pairs, lambda r: F.when(
            F.array_min(r).isNull(), tokens).otherwise(let(F.array_position(r, F.array_min(r)).cast("int"), lambda at: F.concat(
                F.slice(tokens, 1, at - 1), F.array(F.concat(tokens[at - 1], tokens[at])), F.slice(tokens, at + 2, F.size(tokens)))))))

    word = F.col("word")
    start = F.transform(F.sequence(F.lit(1), F.octet_length(word)), lambda i: F.substring(word, i, F.lit(1)))
    tokens = F.aggregate(F.sequence(F.lit(1), F.octet_length(word)), start, lambda t, _: merged(t))
    return words.withColumn("ids", F.when(F.octet_length(word) == 0, F.array().cast("array<int>")).otherwise(F.transform(tokens, rank)))


def _declare_ranks(spark: SparkSession, ranks: dict[bytes, int], name: str) -> None:
    """A session variable with the ranks, in an array of maps by the token's hash."""
    rows = small_table(spark, list(ranks.items()), "token binary, rank int")
    spark.sql(f"DECLARE OR REPLACE VARIABLE {name} ARRAY<MAP<BINARY, INT>>")
    spark.sql(
        f"""SET VAR {name} = (
            SELECT transform(array_sort(collect_list(struct(b, m)), (x, y) -> x.b - y.b), x -> coalesce(x.m, map()))
            FROM (SELECT cast(id AS int) AS b, m FROM range({BUCKETS}) LEFT JOIN (
                SELECT hash(token) & {BUCKETS - 1} AS h, map_from_entries(collect_list(struct(token, rank))) AS m
                FROM {{ranks}} GROUP BY 1) ON id = h))""", ranks=rows)
