"""Byte-level BPE against the public library, and language identification."""

import base64
import hashlib
import itertools
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from odd import LONG, ROWS, documents, odd_docs
from pyspark.sql import functions as F

from plumbline.llm import bpe, language
from plumbline.llm.queries import QUERIES

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = [
    "Hello world's  end,\n\n\tit's 12345 tests… <|endoftext|>", "", None, " ", "   x\u0085y​", "日本語のテキスト ひらがな",
    "a" * 700, "ab" * 300 + "x", "éèê😀👩‍👩‍👧 " * 20, "".join(random.Random(1).choice("abc é\n9!") for _ in range(3000)), LONG[:20000],
    "thstnding ononeswh ofanthher " * 30, "\r\n\r\n  \n", "١٢٣ ⅷ ²",
]


def digests_of(text):
    ids = LIBRARY.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_tokens_against_the_library(spark):
    done = bpe.digests(bpe.decode(bpe.encode(documents(spark, TEXTS), RANKS, public_tokenizers.PATTERN), RANKS))
    for r in done.collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == digests_of(TEXTS[r.doc_id]), TEXTS[r.doc_id]


def test_tokens_on_odd_rows(spark):
    done = bpe.digests(bpe.decode(bpe.encode(odd_docs(spark), RANKS, public_tokenizers.PATTERN), RANKS))
    assert sorted(map(str, ((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in done.collect()))) == sorted(
        map(str, ((r[0], *digests_of(r[1])) for r in ROWS)))
    assert bpe.encode(odd_docs(spark).limit(0), RANKS, public_tokenizers.PATTERN).collect() == []


def test_higher_order_fold(spark):
    words = sorted({p for t in TEXTS if t for p in __import__("regex").findall(public_tokenizers.PATTERN, t) if len(p) < 40})
    table = documents(spark, words).select(F.encode("text", "UTF-8").alias("word"))
    for r in bpe.fold_words(table, RANKS).collect():
        assert list(r.ids) == LIBRARY.encode_ordinary(bytes(r.word).decode())


def test_long_pieces_fold_alike():
    rng = random.Random(7)
    for _ in range(60):
        piece = "".join(rng.choice("abcdeé") for _ in range(rng.randrange(49, 300))).encode()
        tokens = [piece[i:i + 1] for i in range(len(piece))]
        while True:
            pairs = [(RANKS[a + b], i) for i, (a, b) in enumerate(zip(tokens, tokens[1:])) if a + b in RANKS]
            if not pairs:
                break
            _, i = min(pairs)
            tokens[i:i + 2] = [tokens[i] + tokens[i + 1]]
        assert bpe.fold(piece, RANKS) == [RANKS[t] for t in tokens]


def test_ranks_file():
    line = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").readline().split()
    assert RANKS[base64.b64decode(line[0])] == int(line[1])


PIECES = ["▁", "▁a", "▁ab", "a", "b", "ab", "ba", "aba"]


def segmentations(word, p, lattice_pieces, other):
    """Sum over all segmentations, by listing them."""
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts, start = [], 0
        for i, cut in enumerate(cuts, 1):
            if cut:
                parts.append(word[start:i])
                start = i
        parts.append(word[start:])
        value = 1.0
        for x in parts:
            value *= p[lattice_pieces.index(x)] if x in lattice_pieces else p[other] if len(x) == 1 else 0.0
        total += value
    return total


def test_forward_sums_all_segmentations():
    lattice = language.Lattice(PIECES)
    rng = np.random.default_rng(1)
    p = rng.random((lattice.size, 2))
    p /= p.sum(axis=0)
    for word in ("a", "abab", "aabba", "zab", "ababab"):
        points = np.array([[ord(c) for c in "▁" + word]] * 3, np.uint64)
        got = np.exp(lattice.forward(points, p))
        for k in range(2):
            assert np.allclose(got[:, k], segmentations("▁" + word, p[:, k], PIECES, lattice.other))


def test_expected_counts():
    lattice = language.Lattice(PIECES)
    p = np.full(lattice.size, 1 / lattice.size)
    points = np.array([[ord(c) for c in "▁abab"]], np.uint64)
    got = lattice.expected(points, np.array([2.0]), p)
    lengths = np.array([len(x) for x in PIECES] + [1])
    assert np.isclose((got * lengths).sum(), 2 * 5)
    step = 1e-6
    for i in range(lattice.size):
        up = p.copy()
        up[i] *= 1 + step
        slope = (lattice.forward(points, up[:, None])[0, 0] - lattice.forward(points, p[:, None])[0, 0]) / step
        assert abs(2 * slope - got[i]) < 1e-3


def test_long_pieces_take_part():
    """Every letter piece of the vocabulary is in the lattice, also those of over eight letters."""
    from sentencepiece import SentencePieceProcessor
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = SentencePieceProcessor(model_file=path)
    whole = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    pieces = language.vocabulary(path)
    assert {p for p in whole if p.removeprefix("▁").isalpha()} <= set(pieces)
    long = max((p for p in pieces if p[0] == "▁"), key=len)
    lattice = language.Lattice(pieces)
    p = np.zeros((lattice.size, 1))
    p[pieces.index(long)] = 0.25
    points = np.array([[ord(c) for c in long]], np.uint64)
    with np.errstate(divide="ignore"):
        assert len(long) > 9 and np.isclose(np.exp(lattice.forward(points, p))[0, 0], 0.25)


def test_language_on_odd_rows(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    found = language.identify(odd_docs(spark), path, rounds=1).collect()
    assert len(found) == len(ROWS) and all(0 <= r.score <= 1 for r in found)
    by_id = {r.doc_id: r for r in found}
    assert by_id[3].lang_pred == by_id[4].lang_pred == by_id[5].lang_pred == "und" and by_id[3].score == 0
    assert {r.lang_pred for r in found} <= {"en", "de", "fr", "und"}
    assert language.identify(odd_docs(spark).limit(0), path).collect() == []
    unlearned = odd_docs(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(unlearned, path).collect()} == {"und"}


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.001"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op2_language_id"](spark, folder).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and held
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)


@pytest.mark.parametrize("lang, text", [("de", "Der Hund und die Katze"), ("en", "the dog of the house")])
def test_letter_runs(lang, text):
    import pyarrow as pa
    flat, counts = language.letter_runs(pa.array([text + " 12 x" + "y" * 95, None, "1 2 ."]))
    assert counts.tolist() == [len(text.split()) + 3, 0, 0]
    assert flat.to_pylist()[:2] == text.lower().split()[:2]
