import random
from collections import deque

from quillspark.operators import graph


def _bfs(arcs, source, target, depth):
    out = {}
    for a, b in arcs:
        out.setdefault(a, set()).add(b)
    queue, seen = deque([[source]]), {source}
    while queue:
        path = queue.popleft()
        if path[-1] == target:
            return path
        if depth >= 0 and len(path) > depth:
            continue
        for n in sorted(out.get(path[-1], ())):
            if n not in seen:
                seen.add(n)
                queue.append([*path, n])
    return []


def test_paths_equal_breadth_first_search(spark):
    rnd = random.Random(4)
    arcs = list({(f"n{rnd.randrange(14)}", f"n{rnd.randrange(14)}") for _ in range(26)})
    edges = spark.createDataFrame([(a, b, rnd.choice("pq"), b) for a, b in arcs], "from_uri string, to_uri string, relation string, raw string").cache()
    for depth in (2, -1):
        found = {r.node: list(r.path) for r in graph.paths_from(edges, "n0", depth).collect()}
        for n in range(14):
            assert found.get(f"n{n}", []) == _bfs(arcs, "n0", f"n{n}", depth)


def test_stored_arcs_give_the_same_paths(spark, monkeypatch):
    monkeypatch.setattr(graph, "BUCKETS", 3)
    rnd = random.Random(7)
    arcs = list({(f"n{rnd.randrange(16)}", f"n{rnd.randrange(16)}") for _ in range(30)})
    edges = spark.createDataFrame([(a, b, rnd.choice("pq")) for a, b in arcs] * 2, "from_uri string, to_uri string, relation string")
    walk = graph.stored(edges)
    both = arcs + [(b, a) for a, b in arcs]
    for t in range(0, 16, 3):
        found = graph.shortest_path(walk, "n0", f"n{t}")
        assert found["nodes"] == _bfs(arcs, "n0", f"n{t}", -1) and len(found["relations"]) == max(len(found["nodes"]) - 1, 0)
        assert graph.shortest_path(walk.along("in"), "n0", f"n{t}", 3)["nodes"] == _bfs([(b, a) for a, b in arcs], "n0", f"n{t}", 3)
        monkeypatch.setattr(graph, "NAMED", 2)
        assert graph.shortest_path(walk.along("both"), "n0", f"n{t}")["nodes"] == _bfs(both, "n0", f"n{t}", -1)
        monkeypatch.setattr(graph, "NAMED", 1000)
    monkeypatch.setattr(graph, "SORTED", 2)
    found = {r.node: list(r.path) for r in graph.paths_from(walk.along("both"), "n0", 3).collect()}
    assert found == {f"n{n}": way for n in range(16) if (way := _bfs(both, "n0", f"n{n}", 3))}
    assert {r.node: r.level + 1 for r in graph.reached(walk.along("both"), "n0", 3).collect()} == {n: len(way) for n, way in found.items()}
    only = walk.along("out", ("p",))
    assert graph.shortest_path(only, "n0", "n1")["nodes"] == _bfs([(r.from_uri, r.to_uri) for r in edges.where("relation = 'p'").collect()], "n0", "n1", -1)


def test_a_hop_reads_the_buckets_of_its_frontier(spark):
    edges = spark.createDataFrame([(f"a{i}", f"b{i}", "r") for i in range(200)], "from_uri string, to_uri string, relation string")
    walk = graph.stored(edges)
    plan = walk.rows(["a1", "a2"], False)._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan
    assert "In(node, [a1,a2])" in plan and walk.rows(["a1", "a2"], False).count() == 2


def test_status_and_cycles(spark):
    edges = spark.createDataFrame([("a", "b", "r", "b"), ("b", "c", "r", "c"), ("b", "c", "q", "c")], "from_uri string, to_uri string, relation string, raw string")
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "uri string")
    status = lambda *a, **k: graph.path_status(edges, nodes, *a, **k)
    assert status("a", "c") == {"status": "found", "nodes": ["a", "b", "c"], "relations": ["r", "q"]}
    assert status("a", "c", depth=1)["status"] == "depth_exceeded" and status("a", "d")["status"] == "disconnected"
    assert status("x", "a")["status"] == "unknown_source" and status("a", "x")["status"] == "unknown_target"
    assert status("a", "a", depth=0)["nodes"] == ["a"] and status("c", "a", direction="in")["status"] == "found"
    long = [(f"p{i:02d}", f"p{i + 1:02d}", "x") for i in range(40)] + [("p40", None, None), ("s", "s", "x"), ("t", None, "gone")]
    chains = {r.uri: r for r in graph.supersession(spark.createDataFrame(long, "uri string, next string, authored string")).collect()}
    assert chains["p00"].status == "depth_exceeded" and chains["p20"].last == "p40" and chains["t"].status == "missing_target" and list(chains["s"].chain) == ["s", "s"]
