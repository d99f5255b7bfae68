"""Fill-in-the-middle: texts cut into prefix, middle and suffix, and dealt out anew around three marks.

Each byte of a text gets a class: continuation of a character, character inside a word, first of a word, outside words, first of
a line. A wavelet matrix over the classes of a batch counts any class before any place (rank). A unit (character, word or line)
starts at the bytes of some of the classes, so the number of units before a place is a sum of ranks. A cut after k units is the
last place with at most k units before it; all cuts of a batch are bisected together. A cut never parts a character.

Which cuts and which form a text gets follows from a hash of its doc_id alone, so reruns agree.

Defined cases. A null text counts as empty; an empty text, or one that holds a mark, stays plain. A missing doc_id is hashed as
no digits. Rows that repeat a doc_id are cut by the same draws, each in its own text. Long texts are cut whole. An empty table
gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.support import map_steps

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ANY_MARK = "<[PSM]>"

# Classes of bytes. The first character of a line is 5 if it also starts a word, else 4.
INNER, IN_WORD, WORD_START, OUTSIDE, LINE_START, LINE_AND_WORD_START = range(6)
BITS = 3
UNITS = {
    "character": (IN_WORD, WORD_START, OUTSIDE, LINE_START, LINE_AND_WORD_START),
    "word": (WORD_START, LINE_AND_WORD_START),
    "line": (LINE_START, LINE_AND_WORD_START),
}

_bytes = np.arange(256)
_IN_WORDS = (_bytes >= 128) | np.isin(_bytes, np.frombuffer(
    b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8))


class Draws(NamedTuple):
    """``unit`` is what the cuts count; percent of texts that stay plain, and percent of the others with the suffix first."""

    unit: str = "character"
    plain_percent: int = 10
    suffix_first_percent: int = 20
    seed: str = "1"


class WaveletMatrix:
    """Ranks over a sequence of small codes: one bit vector for each bit of a code, zeros sorted before ones at each level."""

    def __init__(self, codes: np.ndarray, bits: int = BITS):
        self.size = len(codes)
        self.levels = []
        for shift in range(bits - 1, -1, -1):
            bit = (codes >> shift) & 1
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(len(codes) // 64 + 1, np.uint64)
            words.view(np.uint8)[:len(packed)] = packed
            before = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=before[1:])
            self.levels.append((shift, words, before, self.size - int(before[-1])))
            codes = np.concatenate([codes[bit == 0], codes[bit == 1]])

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[block] + np.bitwise_count(words[block] & below)

    def rank(self, code: int, at: np.ndarray) -> np.ndarray:
        """How often the code stands among the first ``at`` places."""
        ends = np.stack([np.zeros_like(at), at])
        for shift, words, before, zeros in self.levels:
            ones = self._ones(words, before, ends)
            ends = zeros + ones if code >> shift & 1 else ends - ones
        return ends[1] - ends[0]

    def starts(self, classes: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        """Units before the places: the ranks of all classes that start one."""
        return sum(self.rank(c, at) for c in classes)


def flat_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row (null: none), and where each text starts, with the end of the last."""
    whole = pc.cast(pc.fill_null(text, ""), pa.large_string())
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset:whole.offset + len(whole) + 1]
    data = whole.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def byte_classes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    lead = (data & 0xC0) != 0x80
    word = _IN_WORDS[data]
    after_word = np.concatenate([[False], word[:-1]])
    first = np.concatenate([[False], data[:-1] == 10])
    begins = offsets[:-1][np.diff(offsets) > 0]
    after_word[begins], first[begins] = False, True
    codes = np.where(word, np.where(after_word, IN_WORD, WORD_START), OUTSIDE).astype(np.uint8)
    codes[first] += 3 - (codes[first] == OUTSIDE) * np.uint8(2)
    codes[~lead] = INNER
    return codes


def cut_places(matrix: WaveletMatrix, classes: tuple[int, ...], start: np.ndarray, end: np.ndarray, units: np.ndarray) -> np.ndarray:
    """The last place between start and end with at most ``units`` units between start and it."""
    limit = matrix.starts(classes, start) + units
    low, high = start.copy(), end.copy()
    while (low < high).any():
        middle = (low + high + 1) >> 1
        fits = matrix.starts(classes, middle) <= limit
        low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
    return low


def _draws_of(ids: list, seed: str) -> np.ndarray:
    """Four unsigned 32-bit numbers for each doc_id."""
    raw = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(raw, ">u4").reshape(-1, 4).astype(np.int64)


def _cut(draws: Draws):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = pc.fill_null(batch.column("text"), "")
        data, offsets = flat_bytes(text)
        start, end = offsets[:-1], offsets[1:]
        matrix = WaveletMatrix(byte_classes(data, offsets))
        units = UNITS[draws.unit]
        n = matrix.starts(units, end) - matrix.starts(units, start)
        h = _draws_of(batch.column("doc_id").to_pylist(), draws.seed)
        one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
        cuts = cut_places(matrix, units, np.tile(start, 2), np.tile(end, 2), np.concatenate([np.minimum(one, two), np.maximum(one, two)]))
        cuts = cuts.reshape(2, -1)
        marked = pc.match_substring_regex(text, ANY_MARK).to_numpy(zero_copy_only=False)
        plain = (start == end) | marked | (h[:, 2] % 100 >= 100 - draws.plain_percent)
        first = h[:, 3] % 100 < draws.suffix_first_percent
        form = np.where(plain, "plain", np.where(first, "spm", "psm"))
        raw, p, s, m = data.tobytes(), PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
        out = []
        for kind, a, b, c, d in zip(form, start.tolist(), cuts[0].tolist(), cuts[1].tolist(), end.tolist()):
            if kind == "plain":
                out.append(raw[a:d])
            elif kind == "psm":
                out.append(b"".join((p, raw[a:b], s, raw[c:d], m, raw[b:c])))
            else:
                out.append(b"".join((s, raw[c:d], p, raw[a:b], m, raw[b:c])))
        chars = [matrix.starts(UNITS["character"], x) for x in (start, *cuts)]
        return pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()),
            pa.array(chars[1] - chars[0], pa.int64(), mask=plain), pa.array(chars[2] - chars[1], pa.int64(), mask=plain),
            pc.cast(pa.array(out, pa.binary()), pa.string()),
        ], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
    return run


def fill_in_middle(docs: DataFrame, draws: Draws = Draws()) -> DataFrame:
    """Each document's ``output`` text with its form, its number of units and the characters of prefix and middle.

    psm is prefix, suffix, middle; spm is suffix, prefix, middle; plain is the text as it is.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_steps(rows, _cut(draws),
                     "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. A text with a mark stays plain, so the marks of the others part their pieces."""
    parts = F.split(output, ANY_MARK, -1)
    return (F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
            .when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output))


def digests(cut: DataFrame) -> DataFrame:
    """The table of ``fill_in_middle`` with SHA-256 digests of the output and of the text rebuilt from it in place of the text."""
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
