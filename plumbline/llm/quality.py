"""Quality rules by distribution divergence.

Each document's histogram of character classes and its histogram of common words are compared with references of the
languages by Jensen-Shannon distance (base 2, 0 to 1); the nearest language counts. A reference is the mean histogram of all
documents with that language that pass the base rules. A short text's histogram lies far from any reference by chance, so both limits
widen with the inverse of its length; below MIN_WORDS words only the characters are judged.

The words are those of four languages. A document whose lang names another language has no reference for its words: only its
characters are judged, against the nearest of the references. Without a lang all references are tried.

Defined cases. A null text has no words: it fails the base rules. Without any reference (no known language) only the base
rules decide. Each row is judged by itself, so repeated rows get equal verdicts. Only doc_id, text and lang are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.support import codes_of, group_sums, map_steps, mixed, stored, words_of

# The most frequent function words of four languages.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden".split(),
    "en": "the of and to in a is that for it was on are as with be by this from or an have not they".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce".split(),
}
WORD_LIST = sorted({w for words in COMMON_WORDS.values() for w in words})
SYMBOLS = b"#*$%&|<>"
STEP = 1 << 20  # bytes of text in one numpy step: its arrays take some 20 times that
CLASSES = 7  # lower, upper, digit, white space, punctuation, beyond ASCII, symbols

# Limits of the method: for n characters MAX_CLASS_DISTANCE + CLASS_ALLOWANCE / n, for n words MAX_WORD_DISTANCE + WORD_ALLOWANCE / n.
MIN_WORDS = 60
MAX_CLASS_DISTANCE = 0.25
CLASS_ALLOWANCE = 10
MAX_WORD_DISTANCE = 0.18
WORD_ALLOWANCE = 18

_FACTS = ("doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
          "lang string, classes array<int>, common array<int>")


def _class_table() -> np.ndarray:
    """The character class of each byte in UTF-8; CLASSES for bytes that continue a character."""
    table = np.full(256, 4, np.int64)
    for b in range(128):
        c = chr(b)
        table[b] = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if b in b" \t\n\v\f\r" else 4
    table[list(b"#*$%&|<>@=\\^~`_{}[]+/")] = 6
    table[128:192] = CLASSES
    table[192:] = 5
    return table


def _repeat_words(codes: np.ndarray, counts: np.ndarray, width: int = 5) -> np.ndarray:
    """Per text, the words that lie in a window of ``width`` words found twice or more in the text."""
    n = len(codes)
    owner = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
    if n < width:
        return np.zeros(len(counts), np.int64)
    key = np.zeros(n - width + 1, np.uint64)
    word = mixed(codes.astype(np.uint64) + np.uint64(1))
    for k in range(width):
        key = key * np.uint64(0x9E3779B97F4A7C15) + word[k:n - width + 1 + k]
    key = mixed(key + mixed(owner[:n - width + 1].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93))
    whole = np.flatnonzero(owner[:n - width + 1] == owner[width - 1:])
    _, back, times = np.unique(key[whole], return_inverse=True, return_counts=True)
    starts = whole[times[back] > 1]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return group_sums((np.cumsum(edge[:n]) > 0).astype(np.int64), counts)


def _dup_lines(text: pa.Array) -> np.ndarray:
    """Per text, the lines with a word that equal an earlier line."""
    lists = pc.split_pattern(text, "\n")
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    lined = pc.not_equal(pc.ascii_trim_whitespace(flat), "").to_numpy(zero_copy_only=False)
    codes, values = codes_of(flat)
    owner = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
    keys = (owner * (len(values) + 1) + codes)[lined]
    distinct = np.unique(keys) // (len(values) + 1)
    return group_sums(lined.astype(np.int64), lengths) - np.bincount(distinct, minlength=len(lengths)).astype(np.int64)


def _facts(batch: pa.RecordBatch) -> pa.RecordBatch:
    text = pc.fill_null(batch.column("text"), "")
    flat, counts = words_of(text)
    codes, values = codes_of(flat)
    chars = pc.utf8_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
    n = len(text)
    # Character classes and symbols over the UTF-8 bytes.
    sizes = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = np.frombuffer("".join(text.to_pylist()).encode(), np.uint8)
    owner = np.repeat(np.arange(n, dtype=np.int64), sizes)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    symbols = np.bincount(owner[symbol[joined]], minlength=n).astype(np.int64)
    # In place: one such array is eight times the text.
    owner *= CLASSES + 1
    owner += _class_table()[joined]
    classes = np.bincount(owner, minlength=n * (CLASSES + 1)).reshape(n, CLASSES + 1)[:, :CLASSES]
    del owner
    # Common words, without marks around them; the last bin holds all other words.
    plain = pc.utf8_lower(pc.utf8_trim(values, ".,;:!?\"'()#*$%&|<>"))
    bins = pc.fill_null(pc.index_in(plain, pa.array(WORD_LIST)), len(WORD_LIST)).to_numpy(zero_copy_only=False).astype(np.int64)
    width = len(WORD_LIST) + 1
    word_owner = np.repeat(np.arange(n, dtype=np.int64), counts)
    common = np.bincount(word_owner * width + bins[codes], minlength=n * width).reshape(n, width)

    def lists(table: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(0, table.size + 1, table.shape[1]), pa.int32()), pa.array(table.ravel(), pa.int32()))

    return pa.RecordBatch.from_arrays([
        batch.column("doc_id"), pa.array(counts), pa.array(group_sums(chars[codes], counts)), pa.array(symbols),
        pa.array(_dup_lines(text)), pa.array(_repeat_words(codes, counts)), batch.column("lang"), lists(classes), lists(common),
    ], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lang", "classes", "common"])


def js_distance(rows: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row's distribution to the reference's; rows without a count get 0."""
    total = rows.sum(axis=1, keepdims=True)
    p = rows / np.maximum(total, 1)
    q = np.broadcast_to(reference / max(reference.sum(), 1), p.shape)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.where(total[:, 0] > 0, np.sqrt(np.clip((left + right) / 2, 0, 1)), 0.0)


def base_failed():
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def _references(facts: DataFrame) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(language, classes, words): per language the summed shares of the documents: at most one row per language of COMMON_WORDS.

    Each document weighs the same, so that a few long ones don't make a reference. Shares are whole millionths, so that the
    order of summation doesn't show.
    """
    width = len(WORD_LIST) + 1
    known = facts.where(F.col("lang").isin(list(COMMON_WORDS)) & ~base_failed())
    classed = F.aggregate("classes", F.lit(0).cast("bigint"), lambda total, n: total + n)
    known = known.select("lang", "classes", "common", classed.alias("n_classed"), "n_words")

    def share(name: str, i: int, total: str):
        return F.sum(F.floor(F.col(name)[i].cast("bigint") * 1_000_000 / F.col(total)))

    sums = known.groupBy("lang").agg(
        *[share("classes", i, "n_classed").alias(f"a{i}") for i in range(CLASSES)],
        *[share("common", i, "n_words").alias(f"w{i}") for i in range(width)])
    return [
        (r["lang"], np.array([float(r[f"a{i}"]) for i in range(CLASSES)]), np.array([float(r[f"w{i}"]) for i in range(width)]))
        for r in sorted(sums.collect(), key=lambda r: r["lang"])
    ]


def _verdicts(facts: pa.RecordBatch, references: list[tuple[str, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Base figures, verdicts and distances of a batch of facts."""
    def table(name: str, width: int) -> np.ndarray:
        return facts.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)

    classes, common = table("classes", CLASSES), table("common", len(WORD_LIST) + 1)
    class_distance, word_distance = np.zeros(facts.num_rows), np.zeros(facts.num_rows)
    if references and facts.num_rows:
        class_distance = np.min([js_distance(classes, a) for _, a, _ in references], axis=0)
        word_distance = np.min([js_distance(common, w) for _, _, w in references], axis=0)
        known = pa.array([lang for lang, _, _ in references])
        foreign = pc.and_(pc.is_valid(facts.column("lang")), pc.invert(pc.is_in(facts.column("lang"), known)))
        word_distance = np.where(foreign.to_numpy(zero_copy_only=False), 0.0, word_distance)
    words, repeated = (facts.column(c).to_numpy(zero_copy_only=False) for c in ("n_words", "n_repeat_words"))
    failed = (words < 10) | (100 * repeated > 20 * words)
    chars = classes.sum(axis=1)
    far = (class_distance > MAX_CLASS_DISTANCE + CLASS_ALLOWANCE / np.maximum(chars, 1)) | (
        (words >= MIN_WORDS) & (word_distance > MAX_WORD_DISTANCE + WORD_ALLOWANCE / np.maximum(words, 1)))
    figures = [facts.column(i) for i in range(6)]
    return pa.RecordBatch.from_arrays(
        [*figures, pa.array(failed), pa.array(~failed & ~far), pa.array(class_distance), pa.array(word_distance)],
        names=[*facts.schema.names[:6], "base_failed", "kept", "class_distance", "word_distance"])


def _rows(docs: DataFrame) -> DataFrame:
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"), lang.alias("lang"))


def judge(docs: DataFrame) -> DataFrame:
    """Base figures and verdict of each document."""
    facts = stored(map_steps(_rows(docs), _facts, _FACTS, size=STEP, release=True), "quality-facts")
    references = _references(facts)

    def run(batches):
        for batch in batches:
            yield _verdicts(batch, references)

    head = ", ".join(_FACTS.split(", ")[:6])
    return facts.mapInArrow(run, f"{head}, base_failed boolean, kept boolean, class_distance double, word_distance double")


def passing(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns. The texts are read twice, and nothing is shuffled but sums."""
    references = _references(map_steps(_rows(docs), _facts, _FACTS, size=STEP, release=True))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang = batch.column("lang") if "lang" in batch.schema.names else pa.nulls(batch.num_rows, pa.string())
        own = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), lang], names=["doc_id", "text", "lang"])
        return batch.filter(_verdicts(_facts(own), references).column("kept"))

    return map_steps(docs, run, docs.schema, size=STEP, release=True)
