"""Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary gives the pieces. Each language has a probability per piece; a word's probability is the sum
over all its segmentations into pieces, found by a forward recursion over the word. The probabilities are learned by
expectation maximisation: the expected number of each piece over all segmentations, by forward and backward recursion.
A text's score is the sum over its words (runs of letters, in lower case), plus the language's log share of the learned rows.

The fit may use a bounded sample: about ``fit_rows`` rows per language, drawn by a hash of the row; predictions cover
every whole text. All letter pieces of the vocabulary take part, whatever their length. The piece table has at most one row per
piece and language and goes to every task (0.2 MB a language): fit to tens of languages, not to thousands.

Defined cases. A text that is null or has no letter is ``und`` with score 0. Characters beyond the vocabulary share one
piece. Runs of over 40 letters are scored in runs of 40. Equal scores go to the first language in order. Without learned
rows every text is ``und``. Only doc_id, text and lang are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.support import codes_of, group_sums, map_steps, stored

FIT_ROWS = 1500
ROUNDS = 3
LONGEST_RUN = 40
_START = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(path: str) -> list[str]:
    """The pieces of letters in a sentence-piece model, in lower case, with the mark of a word's start."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    plain = {p for p in pieces if p.removeprefix(_START).isalpha()}
    letters = {c for p in plain for c in p}
    return sorted(plain | letters | {_START})


class Lattice:
    """All pieces within words, by hash. Piece number ``other`` stands for any single character beyond the vocabulary."""

    def __init__(self, pieces: list[str]):
        hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.other = len(pieces)
        self.size = len(pieces) + 1
        self.longest = max(map(len, pieces))
        self.powers = np.array([pow(int(_BASE), k, 1 << 64) for k in range(self.longest + 1)], np.uint64)

    @staticmethod
    def _hash(piece: str) -> int:
        value = 0
        for c in piece:
            value = (value * int(_BASE) + ord(c)) & (2**64 - 1)
        return value

    def spans(self, words: np.ndarray):
        """(start, end, rows, pieces) of the pieces in equally long words, in order of their end; words: code points."""
        n, length = words.shape
        prefix = np.zeros((length + 1, n), np.uint64)
        for j in range(length):
            prefix[j + 1] = prefix[j] * _BASE + words[:, j]
        every = np.arange(n)
        for end in range(1, length + 1):
            for size in range(1, min(self.longest, end) + 1):
                key = prefix[end] - prefix[end - size] * self.powers[size]
                at = np.minimum(np.searchsorted(self.hashes, key), len(self.hashes) - 1)
                found = self.hashes[at] == key
                if size == 1:
                    yield end - 1, end, every, np.where(found, self.order[at], self.other)
                elif found.any():
                    rows = np.flatnonzero(found)
                    yield end - size, end, rows, self.order[at[rows]]

    def forward(self, words: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language. p: probabilities by piece and language."""
        n, length = words.shape
        alpha = np.zeros((length + 1, n, p.shape[1]))
        alpha[0] = 1
        for start, end, rows, pieces in self.spans(words):
            if len(rows) == n:
                alpha[end] += alpha[start] * p[pieces]
            else:
                alpha[end][rows] += alpha[start][rows] * p[pieces]
        return np.log(alpha[length])

    def expected(self, words: np.ndarray, weights: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected number of each piece in weighted words of one language. p: probabilities by piece."""
        n, length = words.shape
        alpha, beta = np.zeros((length + 1, n)), np.zeros((length + 1, n))
        alpha[0], beta[length] = 1, 1
        spans = list(self.spans(words))
        for start, end, rows, pieces in spans:
            alpha[end][rows] += alpha[start][rows] * p[pieces]
        for start, end, rows, pieces in sorted(spans, key=lambda s: -s[0]):
            beta[start][rows] += beta[end][rows] * p[pieces]
        out = np.zeros(self.size)
        share = weights / alpha[length]
        for start, end, rows, pieces in spans:
            out += np.bincount(pieces, alpha[start][rows] * p[pieces] * beta[end][rows] * share[rows], self.size)
        return out


def letter_runs(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs of letters in lower case, at most LONGEST_RUN long, and their number in each text."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(text, "")), r"[^\pL]+", " ")
    plain = pc.replace_substring_regex(plain, rf"(\pL{{{LONGEST_RUN}}})", r"\1 ")
    lists = pc.split_pattern(plain, " ")
    flat = lists.flatten()
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.not_equal(flat, "")
    counts = group_sums(full.to_numpy(zero_copy_only=False).astype(np.int64), lengths)
    return flat.filter(full), counts


def matrices(words: pa.Array):
    """(rows, code points with the start mark) of the words, by length."""
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
    starts = np.cumsum(lengths) - lengths
    for length in np.unique(lengths):
        for rows in np.array_split(at := np.flatnonzero(lengths == length), len(at) // 20000 + 1):
            table = np.full((len(rows), length + 1), ord(_START), np.uint64)
            table[:, 1:] = points[starts[rows][:, None] + np.arange(length)]
            yield rows, table


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(5)) == 0


def learn(rows: DataFrame, lattice: Lattice, fit_rows: int = FIT_ROWS, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, their shares of the rows, and probabilities by piece and language. rows: text, lang, a hash ``_draw``."""
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    # One row per language.
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return [], np.zeros(0), np.zeros((0, 0))
    share = F.lit(0.0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, fit_rows / counts[lang]))).otherwise(share)
    sample = rows.where((F.pmod(F.col("_draw"), F.lit(1 << 30)) / F.lit(1 << 30)) < share).select("text", "lang")

    def runs(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, n = letter_runs(batch.column("text"))
        owner = np.repeat(np.arange(len(n)), n)
        table = pa.table({"lang": batch.column("lang").take(pa.array(owner)), "word": flat})
        sums = table.group_by(["lang", "word"]).aggregate([([], "count_all")]).combine_chunks()
        return pa.RecordBatch.from_arrays([sums.column(c).combine_chunks() for c in ("lang", "word", "count_all")], names=["lang", "word", "n"])

    words = map_steps(sample, runs, "lang string, word string, n bigint")
    words = stored(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    p = np.full((lattice.size, len(langs)), 1 / lattice.size)

    for _ in range(rounds):
        def expect(batches, p=p):
            total = np.zeros((len(langs), lattice.size))
            for batch in batches:
                lang = pc.index_in(batch.column("lang"), pa.array(langs)).to_numpy(zero_copy_only=False)
                weights = batch.column("n").to_numpy(zero_copy_only=False).astype(np.float64)
                for k in range(len(langs)):
                    own = np.flatnonzero(lang == k)
                    if len(own):
                        for at, table in matrices(batch.column("word").take(pa.array(own))):
                            total[k] += lattice.expected(table, weights[own[at]], p[:, k])
            k, piece = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(k, pa.int32()), pa.array(piece, pa.int32()), pa.array(total[k, piece])], names=["k", "piece", "n"])

        sums = words.mapInArrow(expect, "k int, piece int, n double").groupBy("k", "piece").agg(F.sum("n").alias("n")).toArrow()
        counts_ = np.full(p.shape, 0.1)
        counts_[sums["piece"].to_numpy(), sums["k"].to_numpy()] += sums["n"].to_numpy()
        p = counts_ / counts_.sum(axis=0)
    whole = sum(counts.values())
    return langs, np.array([counts[x] / whole for x in langs]), p


def identify(docs: DataFrame, vocabulary_path: str, fit_rows: int = FIT_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"), F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        F.xxhash64(F.lit(1), F.col("doc_id")).alias("_draw"))
    lattice = Lattice(vocabulary(vocabulary_path))
    langs, shares, p = learn(rows.where(~F.col("held_out")), lattice, fit_rows, rounds)

    def predict(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        flat, counts = letter_runs(batch.column("text"))
        lang, score = np.full(n, -1), np.zeros(n)
        if langs and len(flat):
            codes, words = codes_of(flat)
            logs = np.zeros((len(words), len(langs)))
            for at, table in matrices(words):
                logs[at] = lattice.forward(table, p)
            sums = group_sums(logs[codes], counts) + np.log(shares)
            posterior = np.exp(sums - sums.max(axis=1, keepdims=True))
            posterior /= posterior.sum(axis=1, keepdims=True)
            lang = np.where(counts > 0, sums.argmax(axis=1), -1)
            score = np.where(counts > 0, posterior.max(axis=1), 0.0)
        names = pa.array([*langs, "und"])
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), names.take(pa.array(np.where(lang < 0, len(langs), lang))), pa.array(score)],
            names=["doc_id", "held_out", "lang_pred", "score"])

    return map_steps(rows.select("doc_id", "held_out", "text"), predict, "doc_id bigint, held_out boolean, lang_pred string, score double")
