"""Ranked lexical search: the best documents of each item by a whole-number form of BM25, scored by bag classes.

Documents are cut to the items' vocabulary. What is left of a document is its bag (frequency of each vocabulary term) and
its length class m; documents with an equal hash of both and, verified, equal values are one class. Each class is scored once against
all items. A class outside an item's k best, by score and then by least doc_id, has k documents before all of its
own, so the k best classes of each item hold its k best documents. Only their members are looked up, at most k of each
class, in order of doc_id.

Items are taken in blocks of about BLOCK_ITEMS items and BLOCK_CHARS characters, so that what a task holds of them (vocabulary and postings) is
bounded; each block reads the documents once. Frequencies, number and length of documents are counted over all documents.

Defined cases. Null texts have no terms; documents without terms do not count. A row of items is an item of its own, also where
an item_id repeats; items without terms give no rows. Rows that repeat a doc_id are documents of their own. Documents without an
id come after those with one among equal scores. An empty table of documents or items gives an empty result. Only doc_id,
item_id and text are read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.support import map_steps, stored

BLOCK_ITEMS, BLOCK_CHARS = 2_000, 16_000_000
# Classes that are scored together.
STEP = 512

# Bytes that end a term become spaces: ASCII other than digits and letters. Only A-Z is lower-cased.
_TABLE = bytes(b if b >= 128 or 48 <= b < 58 or 97 <= b < 123 else b + 32 if 65 <= b < 91 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def _bags(vocabulary: dict[bytes, int]):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, bags = [], []
        for text in batch.column("text").to_pylist():
            words = terms(text)
            sizes.append(len(words))
            known = [i for i in map(vocabulary.get, words) if i is not None]
            if known:
                term, count = np.unique(np.array(known, np.uint32), return_counts=True)
                bags.append(np.stack([term, count.astype(np.uint32)], axis=1).tobytes())
            else:
                bags.append(None)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(bags, pa.binary())], names=["doc_id", "n", "bag"])
    return run


def _entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, term, frequency) of all bags."""
    raw = column.to_pylist()
    flat = np.frombuffer(b"".join(raw), np.uint32).reshape(-1, 2).astype(np.int64)
    return np.repeat(np.arange(len(raw)), [len(b) // 8 for b in raw]), flat[:, 0], flat[:, 1]


def _document_counts(batches):
    """(term, documents) of each batch of classes."""
    for batch in batches:
        if batch.num_rows:
            at, term, _ = _entries(batch.column("bag"))
            distinct, which = np.unique(term, return_inverse=True)
            found = np.zeros(len(distinct), np.int64)
            np.add.at(found, which, batch.column("size").to_numpy()[at])
            yield pa.RecordBatch.from_arrays([pa.array(distinct.astype(np.int32)), pa.array(found)], names=["term", "documents"])


class Postings:
    """For each term the items that hold it, with weight times occurrences."""

    def __init__(self, items: list[list[int]], weights: np.ndarray):
        rows = sorted((t, i, c) for i, known in enumerate(items) for t, c in Counter(known).items())
        table = np.array(rows, np.int64).reshape(-1, 3)
        self.items, self.n_items = table[:, 1], len(items)
        self.values = table[:, 2] * weights[table[:, 0]]
        self.starts = np.searchsorted(table[:, 0], np.arange(len(weights) + 1))

    def scores(self, bags: pa.Array, m: np.ndarray) -> np.ndarray:
        """Scores of classes (rows) for items (columns)."""
        at, term, tf = _entries(bags)
        part = (1_000_000_000 * tf) // (1000 * tf + 8 * m[at])
        count = self.starts[term + 1] - self.starts[term]
        entry = np.repeat(np.arange(len(term)), count)
        place = np.arange(len(entry)) - np.repeat(np.cumsum(count) - count, count) + self.starts[term][entry]
        out = np.zeros(len(m) * self.n_items, np.int64)
        np.add.at(out, at[entry] * self.n_items + self.items[place], self.values[place] * part[entry])
        return out.reshape(len(m), self.n_items)


def _best(postings: Postings, k: int):
    """The k best classes of each item in a task, as (item, score, first, mark, m, bag)."""
    def run(batches):
        item, score, first = (np.zeros(0, np.int64) for _ in range(3))
        rows: list[tuple] = []
        least = np.ones(postings.n_items, np.int64)
        for whole in batches:
            for start in range(0, whole.num_rows, STEP):
                batch = whole.slice(start, STEP)
                found = postings.scores(batch.column("bag"), batch.column("m").to_numpy())
                at, to = np.nonzero(found >= least)
                if not len(at):
                    continue
                marks, ms, bags = (batch.column(c) for c in ("mark", "m", "bag"))
                new = [(marks[i].as_py(), ms[i].as_py(), bags[i].as_py()) for i in at.tolist()]
                ids = batch.column("first").fill_null(2**63 - 1).to_numpy()
                item, score, first = (np.concatenate(x) for x in ((item, to), (score, found[at, to]), (first, ids[at])))
                rows += new
                order = np.lexsort((first, -score, item))
                rank = np.arange(len(order)) - np.searchsorted(item[order], item[order])
                order = order[rank < k]
                item, score, first, rows = item[order], score[order], first[order], [rows[i] for i in order.tolist()]
                full = np.bincount(item, minlength=postings.n_items) >= k
                lowest = np.full(postings.n_items, 2**63 - 1)
                np.minimum.at(lowest, item, score)
                least = np.where(full, lowest, 1)
        if rows:
            mark, m, bag = zip(*rows)
            yield pa.RecordBatch.from_arrays([
                pa.array(item.astype(np.int32)), pa.array(score), pa.array(first), pa.array(mark, pa.int64()), pa.array(m, pa.int64()),
                pa.array(bag, pa.binary())], names=["item", "score", "first", "mark", "m", "bag"])
    return run


def _block(spark, rows: DataFrame, items: list, k: int, id_type: str) -> DataFrame:
    known = [terms(r["text"]) for r in items]
    vocabulary = {t: i for i, t in enumerate(sorted({t for x in known for t in x}))}
    bags = stored(map_steps(rows, _bags(vocabulary), "doc_id bigint, n bigint, bag binary"), "search-bags")
    n_docs, length = bags.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    m = F.expr(f"100L - 75L + ((75L * n * {n_docs}L) div {max(length, 1)}L)")
    marked = bags.where("bag is not null").withColumn("m", m).withColumn("mark", F.xxhash64("bag", "m"))
    # Grouped by the hash and by what it stands for: an equal hash of different bags makes two classes.
    classes = stored(marked.groupBy("mark", "m", "bag").agg(
        F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("first")), "search-classes")
    # One row per term of the block's vocabulary.
    documents = np.zeros(len(vocabulary), np.int64)
    for r in classes.select("bag", "size").mapInArrow(_document_counts, "term int, documents bigint").groupBy("term").agg(
            F.sum("documents").alias("documents")).collect():
        documents[r["term"]] = r["documents"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in documents.tolist()], np.int64)
    postings = Postings([[vocabulary[t] for t in x] for x in known], weights)
    ranked = classes.select("mark", "m", "bag", "first").mapInArrow(_best(postings, k), "item int, score bigint, first bigint, mark bigint, m bigint, bag binary")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "first")
    best = stored(ranked.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).drop("nth", "first"), "search-best")
    # At most k marks for each item of the block.
    asked = F.broadcast(best.select("mark").distinct())
    by_id = Window.partitionBy("mark", "m", "bag").orderBy(F.col("doc_id").asc_nulls_last())
    members = marked.join(asked, "mark", "left_semi").select("mark", "m", "bag", "doc_id").withColumn("nth", F.row_number().over(by_id))
    found = best.join(members.where(F.col("nth") <= k).drop("nth"), ["mark", "m", "bag"])
    last = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    out = found.select("item", "doc_id", "score", F.row_number().over(last).alias("rank")).where(F.col("rank") <= k)
    ids = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(items)], f"item int, item_id {id_type}")
    return out.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def top_documents(docs: DataFrame, items: DataFrame, k: int = 10, block_items: int = BLOCK_ITEMS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, equal scores by doc_id."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = items.select("item_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    n, chars = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // block_items), -(-chars // block_chars))
    block = F.pmod(F.xxhash64(F.lit(5), "item_id", "text"), F.lit(blocks))
    id_type = items.schema["item_id"].dataType.simpleString()
    out = None
    for b in range(blocks):
        part = _block(spark, rows, asked.where(block == b).orderBy("item_id", "text").collect(), k, id_type)
        out = part if out is None else out.unionByName(part)
    return out
