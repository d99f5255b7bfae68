"""Exact, line and near deduplication."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from odd import LONG, ROWS, documents, odd_docs

from plumbline.llm import exact_dedup, line_dedup, near_dedup
from plumbline.llm.components import components
from plumbline.llm.near_dedup import Limits
from plumbline.llm.queries import QUERIES
from plumbline.sources.state import small_table


def test_exact_on_odd_rows(spark):
    found = exact_dedup.deduplicate(odd_docs(spark), exact_dedup.DigestIndex(spark, buckets=4)).collect()
    by_text = defaultdict(list)
    for r in ROWS:
        by_text[r[1] or ""].append(r[0])
    assert len(found) == len(ROWS)
    want = sorted((str(i), str(max((x for x in ids if x is not None), default=None)), len(ids), hashlib.sha256(t.encode()).hexdigest())
                  for t, ids in by_text.items() for i in ids)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in found) == want
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.keep_id) for r in found)


def test_exact_index_persists(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    exact_dedup.deduplicate(documents(spark, ["a", "b", "a"]), index).collect()
    index.close()
    again = exact_dedup.DigestIndex(spark, index.path, buckets=4)
    later = small_table(spark, [(10, "a"), (11, "c"), (12, "c")], "doc_id bigint, text string")
    found = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.deduplicate(later, again).collect()}
    assert found == {10: (2, False), 11: (12, False), 12: (12, True)}
    assert again.table().count() == 3


def test_exact_hot_group_and_empty_table(spark):
    texts = ["hot"] * 3000 + [f"t{i % 2500}" for i in range(5000)]
    found = exact_dedup.deduplicate(documents(spark, texts), exact_dedup.DigestIndex(spark, buckets=4)).collect()
    assert len(found) == 8000 and sum(r.kept for r in found) == 2501
    assert {r.keep_id for r in found if r.doc_id < 3000} == {2999}
    empty = exact_dedup.deduplicate(documents(spark, ["x"]).limit(0), exact_dedup.DigestIndex(spark, buckets=4))
    assert empty.collect() == [] and empty.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_chunks_resist_shifts():
    rng = random.Random(5)
    lines = [f"line {rng.random()}" for _ in range(60)]
    plain = {"\n".join(lines[a:b]) for a, b in line_dedup.chunks("\n".join(lines))}
    shifted = ["new 1", "new 2", "new 3", *lines]
    moved = {"\n".join(shifted[a:b]) for a, b in line_dedup.chunks("\n".join(shifted))}
    assert len(plain & moved) >= len(plain) - 3
    spans = line_dedup.chunks("\n".join(lines))
    assert spans[0][0] == 0 and spans[-1][1] == 60 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert all(b - a >= line_dedup.MIN_LINES for a, b in spans[:-1])
    assert line_dedup.chunks("") == [(0, 1)]


def brute_lines(rows):
    """First occurrences by (doc_id, place), nulls first; equal rows with one id count once."""
    places = defaultdict(set)
    for i, t in rows:
        if t is not None:
            lines = t.split("\n")
            for k, (a, b) in enumerate(line_dedup.chunks(t)):
                piece = "\n".join(lines[a:b])
                if b - a >= 2 and piece.strip():
                    places[piece].add((i is not None, i or 0, t, k))
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None, 0))
            continue
        lines, kept, n = t.split("\n"), [], 0
        for k, (a, b) in enumerate(line_dedup.chunks(t)):
            piece = "\n".join(lines[a:b])
            # Texts that share an id are ordered by a hash, so the fixtures have no repeat between them.
            if piece in places and (i is not None, i or 0, t, k) != min(places[piece], key=lambda p: (p[0], p[1], p[3])):
                n += b - a
            else:
                kept.extend(lines[a:b])
        out.append((i, "\n".join(kept), n))
    return sorted(out, key=str)


def test_lines_against_brute_force(spark):
    rng = random.Random(3)
    passage = "\n".join(f"shared line {k} of a passage that many have" for k in range(9))
    texts = []
    for i in range(120):
        own = [f"own {i} {k} {rng.random()}" for k in range(rng.randrange(12))]
        if i % 3 == 0:
            at = rng.randrange(len(own) + 1)
            own[at:at] = passage.split("\n")
        texts.append("\n".join(own))
    texts += [texts[4], texts[7], None, "", "\n\n\n", "a\n" * 50]
    docs = documents(spark, texts)
    found = line_dedup.deduplicate_lines(docs)
    assert found.columns == [*docs.columns, "n_lines", "n_removed"]
    rows = found.collect()
    assert sorted(((r.doc_id, r.text, r.n_removed) for r in rows), key=str) == brute_lines(list(enumerate(texts)))
    assert sum("shared line 4 of a passage" in (r.text or "") for r in rows) < 40


def test_lines_on_odd_rows(spark):
    found = line_dedup.deduplicate_lines(odd_docs(spark))
    rows = found.collect()
    assert found.columns == [*odd_docs(spark).columns, "n_lines", "n_removed"] and len(rows) == len(ROWS)
    assert sorted(((r.doc_id, r.text, r.n_removed) for r in rows), key=str) == brute_lines([(r[0], r[1]) for r in ROWS])
    assert all(r["a.b"] == "x" and r.mark == "m" and r.own == 7 for r in rows)
    assert line_dedup.deduplicate_lines(odd_docs(spark).limit(0)).collect() == []


def runs_gone(texts):
    """The lines with a word that stand in a run of two or more lines found at an earlier place, by comparing all places; never by chunks()."""
    places = [(i, k) for i, t in enumerate(texts) if t is not None for k in range(t.count("\n") + 1)]
    lines = [None if t is None else t.split("\n") for t in texts]
    by_line = defaultdict(list)
    for i, k in places:
        by_line[lines[i][k]].append((i, k))
    gone = set()
    for i, k in places:
        for j, m in by_line[lines[i][k]]:
            if (j, m) >= (i, k):
                break
            n = 0
            while k + n < len(lines[i]) and m + n < len(lines[j]) and lines[i][k + n] == lines[j][m + n] and (j < i or m + n < k):
                n += 1
            if n >= 2 and any(x.strip() for x in lines[i][k:k + n]):
                gone |= {(i, k + x) for x in range(n) if lines[i][k + x].strip()}
    return gone


def test_runs_recall_against_brute_force(spark):
    rng = random.Random(9)
    passages = [[f"passage {p} line {k}" for k in range(2 + p % 5)] for p in range(12)]
    passages += [["before blanks", "", "", "after blanks"], ["one blank", "", "then more"], ["single line"]]
    texts = []
    for i in range(80):
        text = [f"own {i} {k}" for k in range(rng.randrange(1, 9))]
        for p in rng.sample(passages, 2):
            at = rng.randrange(len(text) + 1)
            text[at:at] = p
        texts.append("\n".join(text))
    texts += [None, "", "a\n" * 7 + "a", "x\ny\nx\ny\nx", "t\nt\nt", "\n\n\n"]
    rows = line_dedup.deduplicate_runs(documents(spark, texts)).collect()
    gone = runs_gone(texts)
    kept = {r.doc_id: r.text for r in rows}
    assert len(rows) == len(texts) and len(gone) > 300
    for i, t in enumerate(texts):
        want = None if t is None else [x for k, x in enumerate(t.split("\n")) if (i, k) not in gone and x.strip()]
        assert (None if t is None else [x for x in kept[i].split("\n") if x.strip()]) == want
    # The chunks left some of them.
    chunked = {r.doc_id: r.text for r in line_dedup.deduplicate_lines(documents(spark, texts)).collect()}
    assert sum(len((t or "").split("\n")) for t in chunked.values()) > sum(len((t or "").split("\n")) for t in kept.values())


def test_runs_do_not_depend_on_where_chunks_end(spark):
    rng = random.Random(11)
    passages = [[f"passage {p} line {k}" if (p + k) % 4 else "" for k in range(2 + p)] for p in range(9)]
    texts = []
    for i in range(60):
        text = [f"own {i} {k}" for k in range(rng.randrange(4))]
        for p in rng.choices(passages, k=3):
            at = rng.randrange(len(text) + 1)
            text[at:at] = p
        texts.append("\n".join(text))
    texts += texts[:20]
    docs = documents(spark, texts)
    found = [sorted((r.doc_id, r.text, r.n_removed) for r in line_dedup.deduplicate_runs(docs, d).collect()) for d in (1, 3, 2**63)]
    assert found[0] == found[1] == found[2]


def test_a_later_chunk_gives_no_windows():
    lines = [f"line {k}" for k in range(10)]
    wanted = [{"line": 2, "span": 4, "later": True}, {"line": 6, "span": 2, "later": False}]
    found = list(line_dedup._chunks_and_windows(lines, wanted))
    assert [x for x in found if x[2]] == [(2, 6, True), (6, 8, True)]
    assert [a for a, b, whole in found if not whole] == [0, 1, 5, 6, 7, 8]


def test_the_query_removes_runs(spark, tmp_path):
    passage = ["two lines that", "many texts share"]
    texts = ["\n".join([f"before {i}", *passage, f"after {i}"]) for i in range(30)]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op3_line_dedup"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_removed) for r in rows) == [(i, 2 * (i > 0)) for i in range(30)]


def test_runs_on_odd_rows(spark):
    found = line_dedup.deduplicate_runs(odd_docs(spark))
    rows = found.collect()
    assert found.columns == [*odd_docs(spark).columns, "n_lines", "n_removed"] and len(rows) == len(ROWS)
    # The text of the row without an id comes first; of the two rows with id 13, the one that repeats it loses both lines.
    assert sorted((r.text or "", r.n_removed) for r in rows if r.doc_id in (None, 13)) == [
        ("", 0), ("", 2), ("A text without an id.\nIt has two lines.", 0), ("Another text with the same id.", 0)]
    assert all(r["a.b"] == "x" and r.mark == "m" and r.own == 7 for r in rows)
    assert line_dedup.deduplicate_runs(odd_docs(spark).limit(0)).collect() == []


def brute_near(rows, width=3, percent=85):
    sets = []
    for _, t in rows:
        w = (t or "").translate({c: c + 32 for c in range(65, 91)}).replace("\x0b", " ").replace("\x0c", " ")
        w = [x for x in w.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
        sets.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(root(i), []).append(d)
    low = {r: min((x for x in ds if x is not None), default=None) for r, ds in least.items()}
    return sorted(((d, len(sets[i]), low[root(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def varied(rng, words, share):
    return [w if rng.random() > share else f"new{rng.randrange(10**6)}" for w in words]


@pytest.fixture(scope="module")
def near_texts():
    rng = random.Random(11)
    texts = []
    for _ in range(6):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 300))]
        texts += [" ".join(varied(rng, base, rng.choice([0, 0.004, 0.01, 0.02, 0.05, 0.2]))) for _ in range(25)]
    # A chain: each text is like the next, the ends are not alike.
    chain = [f"c{k}" for k in range(400)]
    texts += [" ".join(chain[k * 6:k * 6 + 200]) for k in range(30)]
    return texts + ["Only Two", "only two", "solo", "SOLO", None, "", "  \n", "only two x", LONG]


def test_near_against_brute_force(spark, near_texts):
    found = near_dedup.near_duplicates(documents(spark, near_texts)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == brute_near(list(enumerate(near_texts)))
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_with_small_blocks(spark, near_texts, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    limits = Limits(width=5, percent=80, bands=25, rows=4)
    found = near_dedup.near_duplicates(documents(spark, near_texts), limits).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == brute_near(list(enumerate(near_texts)), 5, 80)


def test_near_on_odd_rows(spark):
    found = near_dedup.near_duplicates(odd_docs(spark)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == brute_near([(r[0], r[1]) for r in ROWS])
    assert near_dedup.near_duplicates(odd_docs(spark).limit(0)).collect() == []
    kept = near_dedup.one_of_each(odd_docs(spark), Limits())
    assert kept.columns == odd_docs(spark).columns
    # 1 and 2 are one, 9 and 10 differ by letter case only, the text without an id is that of 13.
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 3, 4, 5, 6, 7, 8, 9, 11, 12, 13, None], key=str)


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(2)
    for share in (0.3, 0.8, 0.9):
        n = 4000
        both = int(n * 2 * share / (1 + share))
        a, b = rng.integers(0, 2**63, n, np.uint64), rng.integers(0, 2**63, n, np.uint64)
        b[:both] = a[:both]
        x, y = near_dedup.registers(a), near_dedup.registers(b)
        assert (near_dedup.registers(np.concatenate([a, b])) == np.maximum(x, y)).all()
        j = near_dedup.estimate(x[None], y[None], np.array([float(n)]), np.array([float(n)]))[0]
        assert abs(j - share) < 0.13


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {x: x for l in links for x in l}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = {r.node: r.component for r in components(small_table(spark, links, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in linked}
    assert components(small_table(spark, [], "a bigint, b bigint")).collect() == []


def test_words_of_all_white_space():
    from plumbline.llm.support import words_of
    flat, counts = words_of(pa.array(["a\x0bb\x0cc d\x1ce", None, "", " x y "]))
    assert flat.to_pylist() == ["a", "b", "c", "d\x1ce", "x y"] and counts.tolist() == [4, 0, 0, 1]


def test_join_spread_deals_out_hot_keys(spark, monkeypatch):
    """One key with half of the rows: its values are copied and no task of the join gets all of its rows."""
    from pyspark.sql import functions as F

    from plumbline.llm import support
    rows = [(0 if i % 2 else i, i) for i in range(4000)]
    pairs = small_table(spark, rows, "a bigint, b bigint").repartition(4)
    values = small_table(spark, [(i, f"text {i}") for i in range(4000)], "a bigint, t string")
    monkeypatch.setattr(support, "HOT_SHARE", 20)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        done = support.join_spread(pairs, values, "a", F.col("b"), pairs)
        sizes = done.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert max(r["count"] for r in sizes) < 0.25 * 4000
        found = done.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted((r.a, r.b, r.t) for r in found) == sorted((a, b, f"text {a}") for a, b in rows)
