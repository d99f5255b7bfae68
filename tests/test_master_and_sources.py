"""Entities, deduplication, workflows, readers and writers."""

import datetime as dt
import json
import random
from typing import NamedTuple

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import layout, master
from plumbline.params import NullParams, ProfileParams
from plumbline.plans import workflows
from plumbline.sources import readers, state, writers
from plumbline.sources.state import small_table


def _union_find(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for node, link in links:
        a, b = find(("n", node)), find(("l", link))
        parent[a] = b
    groups = {}
    for node, _ in links:
        groups.setdefault(find(("n", node)), set()).add(node)
    return {node: min(g) for g in groups.values() for node in g}


@pytest.mark.parametrize("hot_share", [1_000, 3])
@pytest.mark.parametrize("shape", ["chain", "random", "hot"])
def test_entities_equal_connected_components(spark, monkeypatch, shape, hot_share):
    monkeypatch.setattr(layout, "HOT_SHARE", hot_share)
    rng = random.Random(4)
    if shape == "chain":
        rows = [(i, f"m{i // 2}", f"5{(i + 1) // 2:04d}") for i in range(60)]
    elif shape == "hot":
        rows = [(i, "shared@x" if i % 3 == 0 else f"m{i}", f"{rng.randrange(60):04d}") for i in range(90)]
    else:
        rows = [(i, f"m{rng.randrange(70)}", f"{rng.randrange(90):04d}") for i in range(80)]
    df = spark.createDataFrame(rows, "id int, mail string, phone string")
    found = {r["id"]: r["entity_id"] for r in master.resolve_entities(df, {"mail": "text", "phone": "phone"}, "id").collect()}
    links = [(i, f"m:{m}") for i, m, _ in rows] + [(i, f"p:{p}") for i, _, p in rows]
    assert found == _union_find(links)


def test_rows_without_key_stay_alone(spark):
    df = spark.createDataFrame([(1, " A@x "), (2, "a@X"), (3, None), (4, ""), (5, "b")], "id int, mail string")
    found = {r["id"]: r["entity_id"] for r in master.resolve_by_key(df, "mail", "id").collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_phone_keys_compare_digits(spark):
    df = spark.createDataFrame([(1, "(555) 123-4567"), (2, "555.123.4567"), (3, "none")], "id int, phone string")
    found = {r["id"]: r["entity_id"] for r in master.resolve_by_key(df, "phone", "id", "phone").collect()}
    assert found == {1: 1, 2: 1, 3: 3}


def test_no_shared_key_leaves_every_row_its_own_entity(spark):
    df = spark.createDataFrame([(1, "a", "1"), (2, "b", "2")], "id int, mail string, phone string")
    found = master.resolve_entities(df, {"mail": "text", "phone": "phone"}, "id").collect()
    assert {r["id"]: r["entity_id"] for r in found} == {1: 1, 2: 2}


def edited(rng, text, n):
    for _ in range(n):
        at = rng.randrange(len(text) + 1)
        text = rng.choice([text[:at] + rng.choice("abc") + text[at:], text[:at] + text[at + 1:], text[:at] + rng.choice("abc") + text[at + 1:]])
    return text


@pytest.mark.parametrize("distance", [1, 2])
def test_keys_share_an_anchor_exactly_within_the_distance(spark, distance):
    rng = random.Random(distance)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    pairs = [(w, edited(rng, w, n)) for w in words for n in range(5)] + [("né", "ne"), ("日本", "日"), ("ab", "ba"), ("abc", "bcd")]
    df = small_table(spark, [p for p in pairs if p[1]], "s string, t string")
    links = df.select("s", "t", master.edit_links("s", distance).alias("a"), master.edit_links("t", distance).alias("b"))
    shared = F.expr("exists(a, x -> exists(b, y -> x.link = y.link and (x.anchor or y.anchor)))")
    rows = links.select("s", "t", shared.alias("shared"), F.levenshtein("s", "t").alias("d")).collect()
    assert [(r.s, r.t, r.d) for r in rows if r.shared != (r.d <= distance)] == []
    assert 200 < sum(r.shared for r in rows) < len(rows) - 200


def within(a, b, d):
    """Edit distance at most d, by the usual table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1] <= d


@pytest.mark.parametrize("distance", [1, 2])
def test_similar_keys_against_brute_force(spark, monkeypatch, distance):
    monkeypatch.setattr(layout, "HOT_SHARE", 5)
    rng = random.Random(20 + distance)
    names = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(25)]
    people = [(i, edited(rng, rng.choice(names), rng.randrange(3))) for i in range(120)]
    # One key holds a third of the rows, and one cluster many keys that differ at one place.
    people += [(i, " SHARED key") for i in range(200, 290)] + [(i, f"cluster {i % 10}") for i in range(300, 330)]
    people += [(400, None), (401, ""), (402, "  "), (403, "q"), (404, "r"), (405, "shared kez")]
    entity = {i: i for i, _ in people}
    keys = {i: (k or "").strip().lower() for i, k in people}
    distinct = sorted(set(keys.values()) - {""})
    group = {k: k for k in distinct}
    for a in distinct:
        for b in distinct:
            if a < b and group[a] != group[b] and within(a, b, distance):
                old, new = group[b], group[a]
                group = {k: new if g == old else g for k, g in group.items()}
    for i, k in keys.items():
        if k:
            entity[i] = min(j for j, other in keys.items() if other and group[other] == group[k])
    df = small_table(spark, people, "id int, name string").withColumn("entity", F.lit(1))
    found = master.resolve_similar(df, "name", "id", distance)
    assert found.columns == ["id", "name", "entity", "entity_id"]
    assert {r.id: r.entity_id for r in found.collect()} == entity
    assert master.resolve_similar(df.limit(0), "name", "id", distance).collect() == []


def test_rounds_do_not_multiply_the_estimated_size(spark, monkeypatch):
    # One chain of keys, each one edit from the next: many rounds. Estimates of joins on estimates had 2,800,234 digits.
    chain = ["a" * i + "b" * (40 - i) for i in range(41)]
    df = small_table(spark, [(i, k) for i, k in enumerate(chain)], "id int, name string")
    bits = []

    def watched(links):
        roots = components(links)
        bits.append(roots._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length())
        return roots

    components = master.components
    monkeypatch.setattr(master, "components", watched)
    assert {r.entity_id for r in master.resolve_similar(df, "name", "id").collect()} == {0}
    assert 0 < bits[0] < 200


def test_longer_keys_fail_the_query(spark):
    df = small_table(spark, [(1, "a" * 9), (2, "b")], "id int, name string")
    with pytest.raises(Exception, match="more than 8 characters"):
        master.resolve_similar(df, "name", "id", 1, longest=8)
    with pytest.raises(ValueError, match="1 or 2"):
        master.resolve_similar(df, "name", "id", 3)


def test_deduplicate_keeps_the_first_and_is_idempotent(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (4, None)], "id int, t string")
    once = master.deduplicate(df, ["t"], ["id"])
    assert sorted(r["id"] for r in once.collect()) == [1, 2]
    assert master.deduplicate(once, ["t"], ["id"]).count() == 2
    report = master.deduplicate_with_report(df, ["t"], ["id"]).report.first()
    assert (report["original_rows"], report["unique_rows"], report["removed_rows"]) == (4, 2, 2)


def test_tag_source_keeps_existing_columns(spark):
    df = spark.createDataFrame([(1, "CRM")], "id int, source_system string")
    tagged = master.tag_source(df, "ERP", "2024-01-01").first()
    assert tagged["source_system"] == "CRM" and tagged["created_date"] == dt.datetime(2024, 1, 1)


def test_master_workflow_report(spark):
    rows = [(1, "a@x.org", "same"), (2, "a@x.org", "same"), (3, "A@x.org", "other"), (4, "b@y.org", "z")]
    df = spark.createDataFrame(rows, "id int, mail string, t string")
    found = workflows.master_workflow(df, "id", {"mail": "text"}, "CRM", "2024-01-01")
    report = found.report.first()
    assert (report["original_rows"], report["unique_rows"], report["removed_rows"]) == (4, 3, 1)
    assert (report["entities"], report["pii_rows"]) == (2, 3)
    assert {r["column"]: r["suggested_classification"] for r in found.column_tags.collect()}["mail"] == "confidential"


def test_profile_workflow_stops_below_the_limit(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, None)], "id int, t string")
    found = workflows.profile_workflow(df, ["id"])
    assert [r["state"] for r in found.steps.orderBy("step").collect()] == ["done", "stopped", "stopped"]
    assert found.column_profile is None
    assert "critical" in {r["severity"] for r in found.findings.collect()}


def test_digest_and_run_record(spark):
    found = spark.createDataFrame(
        [("t", "x", "critical", "c", "k", "bad"), ("t", "y", "info", "c", "k", "fine")],
        "dataset string, column string, severity string, category string, type string, message string")
    digest = {r["severity"]: r for r in workflows.findings_digest(found).collect()}
    assert digest["critical"]["messages"] == ["x | bad"] and digest["info"]["messages"] == []
    record = workflows.run_record(spark, "profile", "t", ["a"], ProfileParams(top_n_values=3), dt.datetime(2024, 1, 1), 1.5).first()
    assert record["parameters"]["top_n_values"] == "3" and record["fields"] == ["a"] and record["seconds"] == 1.5


def test_csv_types_and_missing_tokens(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,amount,flag,zip,note\n1,2.5,TRUE,0123,NA\n2,N/A,false,0456,x\n3,7,,0789,null\n")
    df = readers.read_csv(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"id": "bigint", "amount": "double", "flag": "boolean", "zip": "bigint", "note": "string"}
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, 2.5, True, 123, None), (2, None, False, 456, "x"), (3, 7.0, None, 789, None)]


def test_tolerant_csv_skips_only_long_lines(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,name,city\n1,"a, b",x\n2,c\n3,d,e,f,g\n4,"q",y\n')
    df, report = readers.read_csv_tolerant(spark, str(tmp_path / "t.csv"))
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "a, b", "x"), (2, "c", None), (4, "q", "y")]
    assert tuple(report.first()) == (4, 1)


def test_tolerant_csv_keeps_lines_equal_to_the_header_and_line_breaks(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,name\n1,a\nid,name\n2,"b\nc"\n3,x,y\n')
    df, report = readers.read_csv_tolerant(spark, str(tmp_path / "t.csv"), multi_line=True)
    assert sorted(tuple(r) for r in df.collect()) == [("1", "a"), ("2", "b\nc"), ("id", "name")]
    assert tuple(report.first()) == (4, 1)


def test_long_whole_numbers_keep_their_digits(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1234567890123456789,98765432109876543210\n1234567890123456788,1\n")
    df = readers.read_csv(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"a": "bigint", "b": "decimal(38,0)"}
    assert {int(r["b"]) for r in df.collect()} == {98765432109876543210, 1} and df.select("a").distinct().count() == 2


def test_json_array(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([{"id": 1, "mail": "x"}, {"id": 2, "mail": None}, {"id": 3, "mail": ""}]))
    df = readers.read_json_records(spark, str(tmp_path / "t.json"))
    assert {r["id"]: r["mail"] for r in df.collect()} == {1: "x", 2: None, 3: None}


def test_collections_pair_by_name(spark, tmp_path):
    for side in ("old", "new"):
        (tmp_path / side).mkdir()
        (tmp_path / side / "a.csv").write_text("x\n1\n")
    old = readers.read_collection(spark, [str(tmp_path / "old" / "a.csv")])
    new = readers.read_collection(spark, [str(tmp_path / "new" / "a.csv")])
    assert list(readers.pair_tables(old, new)) == ["a"]
    with pytest.raises(ValueError):
        readers.pair_tables(old, {"b": new["a"]})
    with pytest.raises(ValueError):
        readers.read_collection(spark, ["x.docx"])


def test_results_and_cleaned_tables_are_written(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (2, "a")], "id int, t string")
    result = master.deduplicate_with_report(df, ["id", "t"], ["id"])
    writers.write_results(result, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "report")).first()["removed_rows"] == 1
    document = json.loads(writers.report_json(result).first()["report"])
    assert document == {"report": [{"original_rows": 3, "unique_rows": 2, "removed_rows": 1}]}
    paths = writers.write_cleaned({"t": result.table}, str(tmp_path / "clean"))
    assert spark.read.parquet(paths["t"]).count() == 2


def test_record_summary(spark):
    df = spark.createDataFrame([(1, "a")], "id int, t string")
    assert tuple(readers.record_summary(df).first()) == ("id,t", 1)


def test_durable_tables_have_no_lineage(spark):
    df = state.durable(spark.range(5).withColumn("x", F.col("id") * 2))
    assert df.count() == 5 and spark.sparkContext.getCheckpointDir()


class _Tables(NamedTuple):
    first: DataFrame
    second: DataFrame
    note: str = "not a table"


def test_results_are_written_with_their_record(spark, tmp_path):
    first = small_table(spark, [(1, "a"), (2, None), (None, None)], "id int, `odd.name` string")
    folder = str(tmp_path / "out")
    writers.write_recorded(_Tables(first, first.limit(0)), folder, "operator", "orders", NullParams(auto=True))
    record = {r["table"]: r for r in spark.read.parquet(f"{folder}/run_record").collect()}
    assert record["first"]["rows"] == 3 and record["first"]["nulls"] == {"id": 1, "odd.name": 2}
    assert record["second"]["rows"] == 0 and record["first"]["parameters"]["auto"] == "True"
    assert {r["status"] for r in record.values()} == {"written"} and all(r["seconds"] > 0 for r in record.values())
    assert spark.read.parquet(f"{folder}/first").count() == 3


def test_a_failed_table_leaves_its_record(spark, tmp_path):
    good = small_table(spark, [(1,)], "id int")
    bad = good.select(F.raise_error(F.lit("broken")).alias("x"))
    folder = str(tmp_path / "out")
    with pytest.raises(Exception, match="broken"):
        writers.write_recorded(_Tables(good, bad), folder, "operator", "orders", fmt="json")
    record = {r["table"]: r for r in spark.read.parquet(f"{folder}/run_record").collect()}
    assert record["first"]["status"] == "written" and record["second"]["status"] == "failed"
    assert "broken" in record["second"]["error"]
