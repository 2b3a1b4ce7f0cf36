"""Findings of the third round: tables of many files, large groups, whole candidate sets."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import audit, code, graph, lexical
from quillspark.plans import catalogue


def _written(spark, folder, **tables):
    for name, frame in tables.items():
        frame.repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def _equal(spark, folder, name, tables):
    """The rows of a query over tables that are folders of files, which must be those of its SQL."""
    con = duckdb.connect()
    for table in tables:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    want = con.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = sorted((tuple(r[c] for c in columns) for r in catalogue.QUERIES[name](spark, folder).collect()), key=repr)
    assert got == sorted(want.fetchall(), key=repr)
    return got


@pytest.mark.parametrize("rows", [30, 0])
def test_streams_read_tables_of_many_files(spark, tmp_path, rows):
    turns = spark.range(rows).selectExpr("id DIV 5 AS conv_id", "id % 5 AS turn", "'user' AS role", "'x' AS text")
    events = spark.range(rows).selectExpr("id AS event_id", "id % 7 AS user_id", "'view' AS event_type")
    folder = _written(spark, tmp_path, conversations=turns, events=events)
    assert len(_equal(spark, folder, "stream_runs", ["conversations"])) == rows / 5
    assert len(_equal(spark, folder, "stream_deliveries", ["events"])) == min(rows, 7)


def test_large_groups_are_one_row_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(audit, "MEMBERS", 3)
    part = spark.range(60).selectExpr("id AS p_partkey", "concat('N ', id % 4) AS p_name", "concat('T', id % 2) AS p_type", "concat('Brand#', id % 3) AS p_brand")
    folder = _written(spark, tmp_path, part=part)
    assert [r[1] for r in _equal(spark, folder, "audit_tag_fragmentation", ["part"])] == [20, 20, 20]
    assert len(_equal(spark, folder, "audit_duplicate_identity", ["part"])) == 4


def _parts(spark, n):
    return spark.range(n).selectExpr("id AS p_partkey", "concat('N ', id % 4) AS p_name", "concat('T', id % 2) AS p_type", "concat('Brand#', id % 3) AS p_brand", "CAST(id % 5 AS INT) AS p_size")


def test_candidates_are_whole(spark, tmp_path):
    """A name of more symbols than one part of the dictionary holds."""
    folder = _written(spark, tmp_path, part=_parts(spark, 4 * code.SET + 40))
    got = _equal(spark, folder, "code_resolve", ["part"])
    assert max(len(r[2].split(",")) for r in got if r[2]) == code.SET + 10


def test_neighbours_list_no_candidates(spark, tmp_path, monkeypatch):
    folder = _written(spark, tmp_path, part=_parts(spark, 200))
    _equal(spark, folder, "code_neighbors", ["part"])
    monkeypatch.setattr(code, "resolve", None)
    catalogue.QUERIES["code_neighbors"](spark, folder)


def test_a_step_over_pairs_shuffles_no_pairs(spark):
    """A step along rows of pairs is that of a loop, and the rows meet the frontier where they are read."""
    rng = random.Random(5)
    rows = [(f"r{i % 7}", f"s{rng.randrange(9)}", f"s{rng.randrange(9)}") for i in range(40)] + [("r0", "s1", None)]
    pairs = spark.createDataFrame(rows, "relation_id string, from_id string, to_id string")
    near = spark.createDataFrame([(0, "s3"), (1, "s1")], "place int, at string")
    for direction, a, b in (("out", 1, 2), ("in", 2, 1)):
        want = {}
        for place, at in ((0, "s3"), (1, "s1")):
            for r in sorted(r for r in rows if r[a] == at and r[b]):
                want.setdefault(r[b], (place, at, r[0]))
        step = code.Pairs(pairs).step(F.broadcast(near), direction)
        assert {r.symbol_id: (r.place, r.came, r.relation_id.relation_id) for r in step.collect()} == want
    plan = step._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_hops_over_an_edge_table_store_no_arcs(spark, monkeypatch):
    """Levels and paths over edges as they are, whichever way a frontier is met, equal those over stored arcs."""
    rng = random.Random(3)
    rows = {(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}", "r") for _ in range(60)}
    edges = spark.createDataFrame(sorted(rows), "from_uri string, to_uri string, relation string")
    both, stored = graph.directed(edges, "both"), graph.stored(edges).along("both")
    first = min(rows)[0]
    want = sorted(tuple(r) for r in graph.reached(stored, first, 3).collect())
    ways = sorted(map(str, graph.paths_from(stored, first, 3).collect()))
    for named, hashed, ordered in ((0, 0, 0), (0, 1000, 0), (1000, 1000, 1000)):
        monkeypatch.setattr(graph, "NAMED", named)
        monkeypatch.setattr(graph, "HASHED", hashed)
        monkeypatch.setattr(graph, "SORTED", ordered)
        assert sorted(tuple(r) for r in graph.reached(both, first, 3).collect()) == want
        assert sorted(map(str, graph.paths_from(both, first, 3).collect())) == ways


@pytest.mark.parametrize("name", ["graph_reachable_by_level", "graph_shortest_paths", "graph_path_status", "code_path"])
def test_searches_by_foreign_keys_shuffle_no_table(spark, monkeypatch, name):
    monkeypatch.setattr(graph, "stored", None)
    catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").collect()


def test_token_counts_equal_tokens(spark):
    """Counts equal the tokens made one by one, also for odd runs of separators, stop words in compounds and letters of other scripts."""
    rng = random.Random(2)
    pieces = ["the", "of", "Apache", "licençe", "漢字", "x1", "İ", "é", "Ⅷ", "-", "_", "/", ".", "--", " ", "\n", "(", " ", "a-the", "src3/12.md"]
    texts = [None, "", "-", "the-of", "._a-b_."] + ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25))) for _ in range(300)]
    wanted = ["apache", "x1", "the", "a-the", "src3/12.md", "md"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in frame.select(T.tokens(F.col("text")).alias("tokens"), T.token_counts(F.col("text"), wanted).alias("c")).collect():
        assert r.c.len == len(r.tokens) and list(r.c.tf) == [r.tokens.count(q) for q in wanted], r


@pytest.mark.parametrize("name", ["lex_bm25_topk", "lex_name_search", "lex_memory_scoped", "ctx_rrf", "ctx_budget"])
def test_single_questions_build_no_index(spark, monkeypatch, name):
    monkeypatch.setattr(lexical, "build", None)
    assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
