import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import audit, code, paging, ranks


def test_ranks_and_parts(spark):
    rng = random.Random(3)
    rows = list({(rng.choice(["hot", "hot", "a", None]), f"m{rng.randrange(500)}") for _ in range(900)})
    frame = spark.createDataFrame(rows, "k string, m string").repartition(5)
    got = {(r.k, r.m): (r["rank"], r["size"]) for r in ranks.ranked(frame, ["k"], ["m"]).collect()}
    for k in ("hot", "a", None):
        own = sorted(m for x, m in rows if x == k)
        assert all(got[k, m] == (i, len(own)) for i, m in enumerate(own))
    parts = {(r.k, r.part): list(r.members) for r in ranks.parts_of(frame.unionByName(frame), ["k"], "m", 40).collect()}
    own = sorted(m for x, m in rows if x == "hot")
    assert [parts["hot", i] for i in range(-(-len(own) // 40))] == [own[i : i + 40] for i in range(0, len(own), 40)]


@pytest.mark.parametrize("n", [0, 1, 103])
def test_pages_of_a_listing(spark, n):
    rows = spark.createDataFrame([((i * 37) % 103, f"x{i}") for i in range(n)], "k int, v string").repartition(3)
    stored = ranks.listing(rows, [F.col("k")])
    want = [tuple(r) for r in rows.orderBy("k").collect()]
    assert stored.total == n
    for offset, limit in ((0, 10), (0, 1000), (50, 20), (95, 20), (103, 5), (n, 1)):
        assert [tuple(r) for r in stored.page(offset, limit).collect()] == want[offset : offset + limit]
    at, cursor, found = 0, None, []
    while True:
        page, cursor = paging.by_offset(stored, [], "t", "s", {}, 40, cursor)
        found += [tuple(r) for r in page.collect()]
        at += 1
        if cursor is None:
            break
    assert found == want and at == max(-(-n // 40), 1)


def test_a_deep_page_reads_its_ranges_only(spark):
    stored = ranks.listing(spark.range(4000).withColumnRenamed("id", "k"), ["k"])
    plan = stored.page(3990, 5)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(rk_part" in plan or "PartitionFilters: [(rk_part" in plan or "PartitionFilters: [rk_part" in plan
    assert [r.k for r in stored.page(3990, 5).collect()] == list(range(3990, 3995))


def test_findings_of_hot_groups_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(audit, "MEMBERS", 4)
    rows = [(f"u{i:02}", "T", "Same Title" if i % 3 == 0 else f"own {i}", [], ["Tag" if i % 2 else "tag", "x"]) for i in range(30)]
    pages = spark.createDataFrame(rows, "uri string, type string, title string, aliases array<string>, tags array<string>")
    got = sorted(list(r.uris) for r in audit.duplicate_identities(pages).collect())
    own = [f"u{i:02}" for i in range(0, 30, 3)]
    assert got == [own[i : i + 4] for i in range(0, 10, 4)]
    fragments = audit.tag_fragments(pages).collect()
    assert sorted(u for r in fragments for u in r.uris) == [r[0] for r in rows] and max(len(r.uris) for r in fragments) == 4
    assert {tuple(r.evidence) for r in fragments} == {("Tag", "tag")}


def test_candidate_sets_and_adjacency_equal_a_nested_loop(spark, monkeypatch):
    monkeypatch.setattr(code, "SET", 3)
    rng = random.Random(11)
    names = ["run", "get", "x.y", "", None]
    symbols = [(f"s{i:02}", f"d{rng.randrange(4)}", rng.choice(names), rng.choice([*names, f"q{i}"])) for i in range(24)]
    relations = [(f"r{i:02}", f"d{rng.randrange(5)}", rng.choice([*names, "q3"]), rng.choice([*names, "q5", "nobody"])) for i in range(18)]
    frames = spark.createDataFrame(symbols, "id string, document_id string, name string, qualified_name string"), spark.createDataFrame(relations, "id string, document_id string, source string, target string")
    resolved = code.resolve(frames[1], frames[0], code.candidate_sets(frames[0], 3))
    for r in resolved.collect():
        own = sorted(s[0] for s in symbols if r.target and r.target in s[2:])
        assert list(r.candidates) == own[:3] and r.n_candidates == len(own) and r.resolution == ("unresolved", "resolved", "ambiguous")[min(len(own), 2)]
    given = {r.id: list(r.candidates) for r in resolved.collect()}
    given["r00"] = ["s05", "get"]
    own = resolved.withColumn("candidates", F.when(F.col("id") == "r00", F.array(F.lit("s05"), F.lit("get"))).otherwise(F.col("candidates")))
    adjacent = code.adjacency(own, frames[0])
    source = lambda r, s: r[1] == s[1] or bool(r[2]) and r[2] in s[2:]
    target = lambda r, s: bool(r[3]) and r[3] in s[2:] or any(c and c in (s[0], *s[2:]) for c in given[r[0]])
    for symbol in symbols[:6]:
        for direction, near, far in (("out", source, target), ("in", target, source)):
            want = {}
            for r in sorted(relations):
                for s in symbols:
                    if near(r, symbol) and far(r, s) and s[0] != symbol[0]:
                        want.setdefault(s[0], r[0])
            assert [tuple(x) for x in code.neighbours(adjacent, symbol[0], direction).collect()] == sorted(want.items())


def test_rows_of_adjacency_are_linear(spark):
    n = 2000
    symbols = spark.range(n).selectExpr("concat('s', id) AS id", "'doc' AS document_id", "concat('n', id) AS name", "CAST(NULL AS STRING) AS qualified_name")
    relations = spark.range(n).selectExpr("concat('r', id) AS id", "'doc' AS document_id", "'' AS source", "concat('n', (id * 7) % 50) AS target")
    adjacent = code.adjacency(relations, symbols)
    assert adjacent.symbols.count() + adjacent.relations.count() <= 6 * n
    assert code.neighbours(adjacent, "s1000").count() == 50
