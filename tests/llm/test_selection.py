"""Sharding, mixing and quality rules."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from odd import ROWS, documents, odd_docs

from plumbline.llm import mixing, quality, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_shards_on_odd_rows(spark):
    found = sharding.shard_documents(odd_docs(spark), shards=3, slots=64).collect()
    want = sorted(str((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode()))) for r in ROWS)
    assert sorted(str((r.doc_id, r.size, r.text_crc32)) for r in found) == want
    places = defaultdict(list)
    for r in found:
        places[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 3
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert sharding.shard_documents(odd_docs(spark).limit(0)).collect() == []


def test_shards_are_even_and_repeat(spark):
    rng = random.Random(2)
    docs = documents(spark, ["y" * rng.randrange(2000) for _ in range(3000)]).repartition(5)
    rows = sharding.shard_documents(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.size
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) < 0.001 * sum(sizes.values()) / 8
    again = sharding.shard_documents(docs.repartition(3)).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in rows) == sorted((r.doc_id, r.shard, r.slot) for r in again)


def test_slot_map_versions(spark):
    loads = [random.Random(s).randrange(100) for s in range(200)]
    slots = sharding.SlotMap(spark, 4, 200)
    slots.rebalance(loads)
    slots.grow(loads)
    maps = [[r.shard for r in slots.table(v).orderBy("slot").collect()] for v in range(3)]
    assert maps[0] == [s % 4 for s in range(200)] and maps[2] == slots.shard_of and slots.shards == 5
    full = [[sum(x for x, s in zip(loads, m) if s == k) for k in range(5)] for m in maps]
    assert max(full[1][:4]) - min(full[1][:4]) <= 2
    assert all(b in (a, 4) for a, b in zip(maps[1], maps[2]))
    assert abs(full[2][4] - sum(loads) / 5) < 100 and sharding.rebalanced([0, 0], [0, 0], 2) == [0, 0]


def brute_targets(sizes):
    order = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    low, high = 0.0, 1e12
    for _ in range(300):
        level = (low + high) / 2
        if sum(min(2 * sizes[s], level * weight[s]) for s in sizes) < 1.5 * sum(sizes.values()):
            low = level
        else:
            high = level
    return {s: min(2 * sizes[s], high * weight[s]) for s in sizes}


def check_mix(rows, texts):
    by_source, taken = defaultdict(int), defaultdict(int)
    for r, (_, text, source) in zip(rows, texts):
        size = len(WORD.findall(text or ""))
        by_source[source] += size
        assert r.size == size and 0 <= r.taken <= 2 * size
        taken[source] += r.taken
    want = brute_targets(by_source)
    for r, (_, _, source) in zip(rows, texts):
        assert r.source_size == by_source[source] and math.isclose(r.target, want[source], rel_tol=1e-6, abs_tol=1e-6)
    return taken, want


def test_mix_against_brute_force(spark):
    rng = random.Random(9)
    texts = [" ".join(["w"] * rng.randrange(90)) for _ in range(900)]
    source = [rng.choice(["a", "a", "a", "b", "é", "Z", "zz", None]) for _ in texts]
    docs = documents(spark, texts, source=source)
    rows = sorted(mixing.mix(docs).collect(), key=lambda r: r.doc_id)
    taken, want = check_mix(rows, [(i, t, s) for i, (t, s) in enumerate(zip(texts, source))])
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = sorted(mixing.mix(docs.repartition(7)).collect(), key=lambda r: r.doc_id)
    assert [r.taken for r in rows] == [r.taken for r in again]
    other = sorted(mixing.mix(docs, seed=1).collect(), key=lambda r: r.doc_id)
    assert [r.taken for r in rows] != [r.taken for r in other]
    mixture = Counter(r.doc_id for r in mixing.mixture(docs).collect())
    assert mixture == Counter({r.doc_id: r.copies for r in rows if r.copies})


def test_mix_on_odd_rows(spark):
    rows = mixing.mix(odd_docs(spark)).collect()
    assert len(rows) == len(ROWS)
    order = lambda x: str((x[0], len(WORD.findall(x[1] or "")), x[2]))
    texts = sorted(((r[0], r[1], r[3]) for r in ROWS), key=order)
    check_mix(sorted(rows, key=lambda r: str((r.doc_id, r.size, r.source))), texts)
    whole = mixing.mixture(odd_docs(spark))
    assert whole.columns == odd_docs(spark).columns
    assert whole.count() == sum(r.copies for r in rows)
    assert mixing.mix(odd_docs(spark).limit(0)).collect() == [] and mixing.mixture(odd_docs(spark).limit(0)).collect() == []


def test_fit_is_the_best_sum():
    rng = random.Random(1)
    for _ in range(300):
        sizes = sorted(rng.sample(range(30), rng.randrange(1, 7)))
        counts = [rng.randrange(1, 5) for _ in sizes]
        budget = rng.randrange(sum(s * c for s, c in zip(sizes, counts)) + 4)
        reach = {0}
        for s, c in zip(sizes, counts):
            reach = {x + s * k for x in reach for k in range(c + 1)}
        take = mixing._reach(sizes, counts, budget)
        assert all(0 <= t <= c for t, c in zip(take, counts))
        assert sum(s * t for s, t in zip(sizes, take)) == max(x for x in reach if x <= budget)
    sizes = sorted(rng.sample(range(1, 40_000), 6000))
    counts = [rng.randrange(1, 9) for _ in sizes]
    total = sum(s * c for s, c in zip(sizes, counts))
    for share in (0.01, 0.5, 0.99):
        take = mixing.fit(sizes, counts, int(total * share))
        assert sum(s * t for s, t in zip(sizes, take)) == int(total * share) and all(0 <= t <= c for t, c in zip(take, counts))


def brute_base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    inside = {k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside),
            len(words) < 10 or 100 * len(inside) > 20 * len(words))


def naive_distance(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x > 0)
    return math.sqrt(max(0.0, (kl(p) + kl(q)) / 2))


def histograms(text):
    kinds = [0] * quality.CLASSES
    for c in text:
        kinds[5 if ord(c) > 127 else 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c in " \t\n\v\f\r"
              else 6 if c in "#*$%&|<>@=\\^~`_{}[]+/" else 4] += 1
    words = [0] * (len(quality.WORD_LIST) + 1)
    for w in WORD.findall(text):
        w = w.strip(".,;:!?\"'()#*$%&|<>").lower()
        words[quality.WORD_LIST.index(w) if w in quality.WORD_LIST else -1] += 1
    return kinds, words


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(8)
    words = "the of and to in house river stone a is that walk for it was on green as with be by this light from".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(5, 200))).capitalize() + "." for _ in range(60)]
    junk = [" ".join(rng.choice(words) + "&%#" for _ in range(120)), " | ".join(f"item{rng.random()}" for _ in range(120)),
            "SALE!! " * 60, "again and again and so on " * 20, "a b\n" * 12 + "c", None, "", "\n \n"]
    return texts + junk


def test_quality_against_brute_force(spark, prose):
    rows = sorted(quality.judge(documents(spark, prose)).collect(), key=lambda r: r.doc_id)
    base = [brute_base(t) for t in prose]
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows] == base
    known = [histograms(t or "") for t, b in zip(prose, base) if not b[5]]
    reference = [np.sum([np.array(h[k]) / sum(h[k]) for h in known], axis=0).tolist() for k in (0, 1)]
    for r, text, b in zip(rows, prose, base):
        kinds, words = histograms(text or "")
        near = [naive_distance(kinds, reference[0]) if sum(kinds) else 0, naive_distance(words, reference[1]) if sum(words) else 0]
        assert math.isclose(r.class_distance, near[0], abs_tol=1e-3) and math.isclose(r.word_distance, near[1], abs_tol=1e-3)
        far = near[0] > 0.25 + 10 / max(sum(kinds), 1) or (b[0] >= 60 and near[1] > 0.18 + 18 / b[0])
        assert r.kept == (not b[5] and not far)
    assert not any(r.kept for r in rows[60:]) and all(r.kept or r.base_failed for r in rows[:60])
    passing = quality.passing(documents(spark, prose))
    assert sorted(r.doc_id for r in passing.collect()) == [r.doc_id for r in rows if r.kept]


def test_quality_on_odd_rows(spark):
    rows = quality.judge(odd_docs(spark)).collect()
    assert sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in rows) == sorted(
        str((r[0], *brute_base(r[1]))) for r in ROWS)
    assert quality.passing(odd_docs(spark)).columns == odd_docs(spark).columns
    assert quality.judge(odd_docs(spark).limit(0)).collect() == [] and quality.passing(odd_docs(spark).limit(0)).collect() == []
    unknown = quality.judge(odd_docs(spark).drop("lang")).collect()
    assert all(r.kept == (not r.base_failed) for r in unknown)


def test_quality_of_short_junk_and_of_other_languages(spark, prose):
    """Symbol junk below 60 words goes; a language without a reference is not held against foreign words."""
    junk = " ".join(f"{w} {'%*&#'[i % 4] * (3 + i // 4)}" for i, w in enumerate("house of river stone light walk green was".split()))
    assert 10 <= len(junk.split()) < 60
    rng = random.Random(9)
    polish = "dom rzeka kamień jest zielony spacer światło które tylko bardzo przez oraz swoje wszystko można dzień noc".split()
    foreign = [" ".join(rng.choice(polish) for _ in range(150)) for _ in range(5)]
    texts = [*prose, junk, *foreign]
    lang = ["en"] * (len(prose) + 1) + ["pl"] * 5
    rows = {r.doc_id: r for r in quality.judge(documents(spark, texts, lang=lang)).collect()}
    assert not rows[len(prose)].kept and not rows[len(prose)].base_failed
    assert all(rows[i].kept and rows[i].word_distance == 0 for i in range(len(prose) + 1, len(texts)))
    held = {r.doc_id for r in quality.passing(documents(spark, texts, lang=lang)).collect()}
    assert held == {i for i, r in rows.items() if r.kept}
