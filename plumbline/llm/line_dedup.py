"""Line deduplication by content-defined chunks, and by the runs of lines at their edges.

A text's lines are hashed, and a rolling hash over neighbouring line hashes chooses where a chunk ends. So the same run of
lines is cut at the same places wherever it stands, also after lines were put in before it. A chunk of several lines that
is found more than once in the whole table stays where it comes first, by doc_id and place; elsewhere it is removed.
A boundary follows a line if the rolling hash over it and the line before is divisible by DIVISOR, and only if the chunk has
two lines or more by then; what a text's last boundary leaves is its last chunk.

``deduplicate_lines`` stops there: it takes whole chunks. A repeated run that begins or ends inside a chunk, or is shorter than one,
loses only the chunks that lie in it.

``deduplicate_runs`` goes on from the chunks to the edges of the runs. Outside the chunks that repeat an earlier one, and
across their edges, it nominates every window of two neighbouring lines of which one has a word, and, where two or more lines without
a word follow one another, the window from the line with a word before them to the one after. A window that stands at an
earlier place of the table loses its lines, unless it overlaps its first occurrence in the same text. So a
run of two or more lines that stands earlier loses all its lines with a word, however it is surrounded, and copies of long passages
cost one key a chunk, not one a line. Each removed line still stands at an earlier place; its neighbours there may have gone as part
of another run. A window inside a repeated chunk has its first place outside of one, so skipping it changes no decision.

Hashes only nominate: a chunk or window goes only if all of its 128-bit hash are equal byte by byte (with two texts of one
hash, both would stay).

Defined cases. A null text has no lines and stays null. Single lines, and chunks or windows without a word, are never removed. Rows that
repeat a doc_id with an equal text are one document and are cut alike. A row without a doc_id comes before all others. A
text that loses all its lines becomes empty. An empty table gives an empty result. Other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.support import attach, map_steps, stored, unused

DIVISOR = 3
MIN_LINES = 2

# (first, past last line) of a piece, and whether its bytes go with its hash.
Choice = Callable[[list[str], list[dict] | None], Iterable[tuple[int, int, bool]]]


def chunks(text: str, divisor: int = DIVISOR) -> list[tuple[int, int]]:
    """The (first, past last) line numbers of a text's chunks."""
    return _chunks(text.split("\n"), divisor)


def _chunks(lines: list[str], divisor: int) -> list[tuple[int, int]]:
    if len(lines) < MIN_LINES:
        return [(0, len(lines))]
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in lines), np.uint64, len(lines))
    # A cyclic polynomial over two line hashes.
    rolling = hashes[1:] ^ (hashes[:-1] << np.uint64(1) | hashes[:-1] >> np.uint64(63))
    out, start = [], 0
    for end in (np.flatnonzero(rolling % np.uint64(divisor) == 0) + 2).tolist():
        if end - start >= MIN_LINES:
            out.append((start, end))
            start = end
    if start < len(lines):
        out.append((start, len(lines)))
    return out


def windows(lines: list[str]) -> list[tuple[int, int]]:
    """The (first, past last) line numbers of the shortest runs that are compared."""
    word = [bool(x) and not x.isspace() for x in lines]
    out = [(a, a + MIN_LINES) for a in range(len(lines) - MIN_LINES + 1) if any(word[a:a + MIN_LINES])]
    full = [k for k, w in enumerate(word) if w]
    return out + [(a, b + 1) for a, b in zip(full, full[1:]) if b - a > MIN_LINES]


def _all_chunks(divisor: int) -> Choice:
    """The chunks that may be removed."""
    def choose(lines: list[str], _) -> Iterable[tuple[int, int, bool]]:
        for a, b in _chunks(lines, divisor):
            if b - a >= MIN_LINES and any(x and not x.isspace() for x in lines[a:b]):
                yield a, b, False
    return choose


def _nominated(_: list[str], wanted: list[dict] | None) -> Iterable[tuple[int, int, bool]]:
    """The pieces that were found again, with their bytes."""
    return [(w["line"], w["line"] + w["span"], True) for w in wanted or []]


def _chunks_and_windows(lines: list[str], wanted: list[dict] | None) -> Iterable[tuple[int, int, bool]]:
    """The nominated chunks with their bytes, and the windows that no later chunk holds whole."""
    yield from _nominated(lines, wanted)
    chunk = [-1] * len(lines)
    for k, w in enumerate(wanted or []):
        if w["later"]:
            chunk[w["line"]:w["line"] + w["span"]] = [k] * w["span"]
    for a, b in windows(lines):
        if chunk[a] < 0 or chunk[a] != chunk[b - 1]:
            yield a, b, False


_PIECE = "_id bigint, _mark bigint, line int, span int, key binary, piece string"


def _pieces(texts: DataFrame, choose: Choice) -> DataFrame:
    """Hash and, where asked for, bytes of the chosen pieces of each text; ``choose`` is given the lines and the cell of ``wanted``."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, starts, spans, keys, pieces = [], [], [], [], []
        told = batch.column("wanted").to_pylist() if "wanted" in batch.schema.names else [None] * batch.num_rows
        for i, (text, wanted) in enumerate(zip(batch.column("_text").to_pylist(), told)):
            lines = text.split("\n")
            for a, b, whole in choose(lines, wanted):
                piece = "\n".join(lines[a:b])
                rows.append(i)
                starts.append(a)
                spans.append(b - a)
                keys.append(xxhash.xxh3_128_digest(piece))
                pieces.append(piece if whole else None)
        at = pa.array(rows, pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column("_id").take(at), batch.column("_mark").take(at), pa.array(starts, pa.int32()), pa.array(spans, pa.int32()),
             pa.array(keys, pa.binary()), pa.array(pieces, pa.string())],
            names=["_id", "_mark", "line", "span", "key", "piece"])
    return map_steps(texts, run, _PIECE, "_text", release=True)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("text").isNotNull()).select(
        F.col("doc_id").cast("bigint").alias("_id"), F.xxhash64("text").alias("_mark"), F.col("text").alias("_text"))


def _place() -> Column:
    return F.struct("_id", "_mark", "line")


def _found_again(marks: DataFrame, name: str) -> DataFrame:
    """(_id, _mark, wanted): per document the pieces whose hash stands at several places, and whether it stands at an earlier one."""
    groups = marks.groupBy("key").agg(
        F.min(_place()).alias("first"), F.max(_place()).alias("last"), F.count(F.lit(1)).alias("size")
    ).where(~F.col("first").eqNullSafe(F.col("last"))).select("key", "size", "first")
    found = attach(marks.drop("piece"), groups, "key", "size", marks.count(), _place()).where(F.col("first").isNotNull())
    later = (~_place().eqNullSafe(F.col("first"))).alias("later")
    return stored(found.groupBy("_id", "_mark").agg(F.collect_set(F.struct("line", "span", later)).alias("wanted")), name)


def _with_wanted(texts: DataFrame, wanted: DataFrame, how: str) -> DataFrame:
    named = wanted.select(F.col("_id").alias("_i"), F.col("_mark").alias("_m"), "wanted")
    same = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_mark") == F.col("_m"))
    return texts.join(named.hint("merge"), same, how).select("_id", "_mark", "_text", "wanted")


def _later(pieces: DataFrame, name: str) -> DataFrame:
    """(_id, _mark, line, span) of the pieces that stand at an earlier place, compared by their bytes."""
    # Grouping by the piece itself compares bytes.
    equal = pieces.groupBy("key", "piece").agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("size"))
    firsts = equal.groupBy("key").agg(F.count(F.lit(1)).alias("texts"), F.min("first").alias("first"), F.sum("size").alias("size"))
    firsts = stored(firsts.where("texts = 1").select("key", "size", "first"), name)
    placed = attach(pieces.drop("piece"), firsts, "key", "size", pieces.count(), _place()).where(F.col("first").isNotNull())
    within = F.col("_id").eqNullSafe(F.col("first._id")) & (F.col("_mark") == F.col("first._mark"))
    later = ~within | (F.col("line") >= F.col("first.line") + F.col("span"))
    return placed.where(later).select("_id", "_mark", "line", "span")


def _by_document(later: DataFrame) -> DataFrame:
    return stored(later.groupBy("_id", "_mark").agg(F.collect_set(F.struct("line", "span")).alias("gone")), "line-gone")


def repeated_chunks(docs: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """(_id, _mark, gone): per document, by its id and a hash of its text, the (line, span) of the chunks to remove."""
    texts = _texts(docs)
    marks = stored(_pieces(texts, _all_chunks(divisor)), "line-chunks")
    wanted = _found_again(marks, "line-wanted")
    pieces = stored(_pieces(_with_wanted(texts, wanted, "inner"), _nominated), "line-pieces")
    return _by_document(_later(pieces, "line-firsts"))


def repeated_runs(docs: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """(_id, _mark, gone): per document, by its id and a hash of its text, the (line, span) of the chunks and windows to remove."""
    texts = _texts(docs)
    marks = stored(_pieces(texts, _all_chunks(divisor)), "line-chunks")
    repeated = _found_again(marks, "line-repeated")
    both = stored(_pieces(_with_wanted(texts, repeated, "left"), _chunks_and_windows), "line-windows")
    of_chunks = _later(both.where(F.col("piece").isNotNull()), "line-firsts")
    wanted = _found_again(both.where(F.col("piece").isNull()), "line-wanted")
    pieces = stored(_pieces(_with_wanted(texts, wanted, "inner"), _nominated), "line-pieces")
    return _by_document(of_chunks.unionByName(_later(pieces, "line-firsts")))


def _rest(text: str, gone: list[dict]) -> tuple[str, int]:
    """The text without the given pieces, and how many lines went."""
    lines = text.split("\n")
    away = {k for w in gone for k in range(w["line"], w["line"] + w["span"])}
    return "\n".join(x for k, x in enumerate(lines) if k not in away), len(away)


def _rest_of_runs(text: str, gone: list[dict]) -> tuple[str, int]:
    """The text without the windows that lie in the given pieces, and how many lines went."""
    lines = text.split("\n")
    away = set()
    for w in gone:
        start = w["line"]
        for a, b in windows(lines[start:start + w["span"]]):
            away.update(range(start + a, start + b))
    return "\n".join(x for k, x in enumerate(lines) if k not in away), len(away)


def deduplicate_lines(docs: DataFrame, divisor: int = DIVISOR, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """The table with repeated chunks taken out of ``text``, and two columns with the number of lines and of removed lines.

    Columns of the table that have the names of the two are replaced.
    """
    docs = docs.drop(*counts)
    return _without(docs, repeated_chunks(docs, divisor), _rest, counts)


def deduplicate_runs(docs: DataFrame, divisor: int = DIVISOR, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """The table with repeated runs of lines taken out of ``text``, and two columns as by ``deduplicate_lines``."""
    docs = docs.drop(*counts)
    return _without(docs, repeated_runs(docs, divisor), _rest_of_runs, counts)


def _without(docs: DataFrame, repeated: DataFrame, rest: Callable, counts: tuple[str, str]) -> DataFrame:
    """The table with each text's ``rest`` after what is repeated, and the two counts."""
    own, id_, mark, gone = unused(docs, "own", "id", "mark", "gone")
    found = repeated.select(F.col("_id").alias(id_), F.col("_mark").alias(mark), F.col("gone").alias(gone))
    keyed = docs.withColumn(own, F.xxhash64("text"))
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(mark))
    joined = keyed.join(found.hint("merge"), same, "left").drop(own, id_, mark)
    schema = joined.drop(gone).schema.add(counts[0], "long").add(counts[1], "long")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, gone_ = batch.column("text").to_pylist(), batch.column(gone).to_pylist()
        n = [t.count("\n") + 1 if t is not None else 0 for t in texts]
        done = [rest(t, g) if g else (t, 0) for t, g in zip(texts, gone_)]
        columns = []
        for name in batch.schema.names:
            if name == "text":
                columns.append(pa.array([t for t, _ in done], batch.schema.field("text").type))
            elif name != gone:
                columns.append(batch.column(name))
        names = [x for x in batch.schema.names if x != gone]
        return pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array([k for _, k in done], pa.int64())],
                                          names=[*names, *counts])

    return map_steps(joined, run, schema, release=True)
