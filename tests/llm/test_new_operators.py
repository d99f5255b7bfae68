"""Fill-in-middle, SimHash near-deduplication and ranked search against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from odd import ROWS, documents, odd_docs

from plumbline.llm import fim, search, simhash
from plumbline.llm.components import components
from plumbline.llm.queries import QUERIES
from plumbline.sources.state import small_table

SF = "/root/testdata/sf0.001"


# Fill-in-middle

def brute_fim(doc_id, text):
    text = text or ""
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_wavelet_matrix_ranks():
    rng = np.random.default_rng(3)
    for size in (0, 1, 63, 64, 65, 1000):
        codes = rng.integers(0, 8, size).astype(np.uint8)
        matrix = fim.WaveletMatrix(codes)
        at = np.arange(size + 1)
        for code in range(8):
            want = np.concatenate([[0], np.cumsum(codes == code)])
            assert (matrix.rank(code, at) == want).all()


@pytest.mark.parametrize("unit, pattern", [
    ("character", r"(?s)."), ("word", r"[0-9A-Za-z\u0080-\U0010FFFF]+"), ("line", r"(?m)^(?=[\s\S])")])
def test_units_and_cuts(unit, pattern):
    texts = ["", "a", "é😀\n\nx y", "one two\nthree\n", "\n", "  lead", "naïve-test 123,4", "日本 語\r\nx"]
    data, offsets = fim.flat_bytes(pa.array(texts))
    matrix = fim.WaveletMatrix(fim.byte_classes(data, offsets))
    classes = fim.UNITS[unit]
    for text, start, end in zip(texts, offsets, offsets[1:]):
        begins = [len(text[:m.start()].encode()) for m in re.finditer(pattern, text)]
        assert matrix.starts(classes, np.array([end]))[0] - matrix.starts(classes, np.array([start]))[0] == len(begins)
        for k in range(len(begins) + 1):
            place = fim.cut_places(matrix, classes, np.array([start]), np.array([end]), np.array([k]))[0]
            assert place - start == (begins[k] if k < len(begins) else len(text.encode()))


def test_fill_in_middle_on_odd_rows(spark):
    rows = ROWS + [(i, f"mark <{m}> in {i}", "en", "s", 1, None, 7, "m", 1, 2, "x", 9) for i, m in enumerate("PSM", 100)]
    rows += [(i, f"tricky <P <S<M {i} >P> 😀<", "en", "s", 1, None, 7, "m", 1, 2, "x", 9) for i in range(200, 260)]
    cut = fim.fill_in_middle(odd_docs(spark, rows))
    found = cut.withColumn("again", fim.restored(cut.output, cut.form)).collect()
    key = repr
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found), key=key) == sorted(
        ((r[0], *brute_fim(r[0], r[1])) for r in rows), key=key)
    assert sorted(((r.doc_id, r.again) for r in found), key=key) == sorted(((r[0], r[1] or "") for r in rows), key=key)
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    empty = fim.digests(fim.fill_in_middle(odd_docs(spark).limit(0)))
    assert empty.collect() == [] and empty.columns[-1] == "restored_sha256"


def test_fill_in_middle_by_words(spark):
    docs = documents(spark, [f"word {i}, and ünï\nnext line {i}" for i in range(300)])
    cut = fim.fill_in_middle(docs, fim.Draws(unit="word", plain_percent=0, suffix_first_percent=50))
    found = cut.withColumn("again", fim.restored(cut.output, cut.form)).join(docs, "doc_id").collect()
    assert all(r.again == r.text and r.n == 7 for r in found) and {r.form for r in found} == {"psm", "spm"}
    for r in found:
        prefix = r.text[:r.prefix_chars]
        assert not prefix or not re.search(r"\w\Z", prefix) or prefix == r.text
    assert 100 < sum(r.form == "spm" for r in found) < 200


# SimHash

def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(x >> bit & 1 for x in h) > len(h))


def brute_components(prints):
    """Component (least value) of each distinct fingerprint."""
    values = sorted(set(prints))
    head = {v: v for v in values}

    def find(v):
        while head[v] != v:
            v = head[v]
        return v
    a = np.array(values, np.uint64)
    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1:] ^ a[i]) <= 4):
            one, two = find(v), find(values[i + 1 + j])
            head[max(one, two)] = min(one, two)
    return {v: find(v) for v in values}


def check_simhash(rows, found):
    prints = [brute_print(t) for _, t in rows]
    part = brute_components(prints)
    least = defaultdict(list)
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[part[p]].append(i)
    want = [(i, f"{p:016x}", min(least[part[p]], default=None)) for (i, _), p in zip(rows, prints)]
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in found), key=repr) == sorted(want, key=repr)


def test_simhash_on_odd_rows(spark):
    check_simhash([(r[0], r[1]) for r in ROWS], simhash.near_duplicates(odd_docs(spark)).collect())
    assert simhash.near_duplicates(odd_docs(spark).limit(0)).collect() == []


def test_simhash_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_simhash(rows, QUERIES["op12_simhash_dedup"](spark, SF).collect())


def planted(n, seed, families=30, far=True):
    """Random fingerprints, chains and dense families around some of them."""
    rng = np.random.default_rng(seed)
    codes = list(rng.integers(0, 2**64, n, np.uint64)) if far else []
    for _ in range(families):
        at = int(rng.integers(0, 2**64, 1, np.uint64)[0])
        for _ in range(40):
            codes.append(np.uint64(at))
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                at ^= 1 << int(bit)
    return np.unique(np.array(codes, np.uint64))


def test_routing_brings_near_pairs_together():
    codes = planted(3000, 1)
    tree = simhash.plant(codes[::3], 40)
    at, leaf, home = simhash.route(tree, codes)
    assert len(set(leaf.tolist())) > 15
    homes = dict(zip(at[home].tolist(), leaf[home].tolist()))
    assert sorted(homes) == list(range(len(codes)))
    seen = {(int(i), int(x)) for i, x in zip(at, leaf)}
    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes[i + 1:] ^ codes[i]) <= 4) + i + 1:
            assert (i, homes[j]) in seen or (j, homes[i]) in seen


@pytest.mark.parametrize("block_homes, block_queries", [(1 << 16, 1 << 17), (150, 400)])
def test_links_give_the_same_components(spark, block_homes, block_queries):
    codes = planted(3000, 2)
    table = small_table(spark, [(int(x),) for x in codes.view(np.int64)], "code bigint").repartition(3)
    found = components(simhash.links(table, 20, block_homes, block_queries)).collect()
    got = {r.node: r.component for r in found}
    head = brute_components(codes.tolist())
    groups, want = defaultdict(set), defaultdict(set)
    for c in codes.tolist():
        signed = int(np.array([c], np.uint64).view(np.int64)[0])
        groups[got.get(signed, signed)].add(c)
        want[head[c]].add(c)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_dense_family_gives_a_forest_and_not_all_pairs():
    rng = random.Random(4)
    codes = {0}
    while len(codes) < 6000:
        codes.add(sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    points = np.array(sorted(codes), np.uint64)
    a, b = simhash.linked(points, points)
    assert len(a) == len(points) - 1 and (b == points[0]).all()


def test_hubs_are_looked_up_by_broadcast(spark):
    """A node with half of all links: no join task gets its links by their key."""
    rows = [(0, i) for i in range(1, 3001)] + [(5000 + 2 * i, 5001 + 2 * i) for i in range(1500)]
    found = {r.node: r.component for r in components(small_table(spark, rows, "a bigint, b bigint")).collect()}
    assert all(found[i] == 0 for i in range(3001)) and all(found[5001 + 2 * i] == 5000 + 2 * i for i in range(1500))


# Ranked search

def brute_search(docs, items, k=10):
    def terms(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(i, terms(t)) for i, t in docs]
    n_docs, total = sum(bool(w) for _, w in bags), sum(len(w) for _, w in bags)
    df = Counter(x for _, w in bags for x in set(w))
    out = []
    for item, text in items:
        asked, scored = Counter(terms(text)), []
        for i, w in bags:
            tf = Counter(w)
            score = 0
            for x, c in asked.items():
                if tf[x]:
                    m = 100 - 75 + (75 * len(w) * n_docs) // total
                    score += c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10**9 * tf[x]) // (1000 * tf[x] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def ranked(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def test_search_on_odd_rows(spark):
    items = [(1, "same text twice"), (1, "two words"), (2, None), (3, "..."), (4, "ÉMILE émile 😀 word1 WORD2 line5 word1"), (None, "null id of an item")]
    table = small_table(spark, items, "item_id bigint, text string")
    want = brute_search([(r[0], r[1]) for r in ROWS], items)
    assert ranked(search.top_documents(odd_docs(spark), table)) == want
    assert ranked(search.top_documents(odd_docs(spark), table, block_items=2)) == want
    assert search.top_documents(odd_docs(spark).limit(0), table).collect() == []
    assert search.top_documents(odd_docs(spark), table.limit(0)).collect() == []


def test_search_with_hot_classes_and_ties(spark):
    """One class with half of the rows, other classes with equal scores, ids out of order."""
    texts = ["apple pie with cream"] * 2000 + [f"apple pie no {i}" for i in range(300)] + ["pie apple cream with"] * 300 + ["nothing of it"] * 400
    ids = list(range(len(texts)))
    random.Random(6).shuffle(ids)
    rows = list(zip(ids, texts))
    docs = small_table(spark, rows, "doc_id bigint, text string").repartition(5)
    items = [(7, "apple pie"), (8, "cream"), (9, "no 17"), (10, "missing")]
    table = small_table(spark, items, "item_id int, text string")
    assert ranked(search.top_documents(docs, table)) == brute_search(rows, items)
    assert ranked(search.top_documents(docs, table, k=3)) == brute_search(rows, items, 3)
