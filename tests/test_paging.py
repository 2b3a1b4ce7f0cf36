import pytest
from pyspark.sql import functions as F

from quillspark.functions import vectors
from quillspark.operators import code, graph, paging, semantic, trace
from quillspark.sources import payloads, stores, vault


def test_cursors_are_bound_and_strict(spark):
    rows = spark.range(25).select(F.col("id").alias("k"))
    first, cursor = paging.by_offset(rows, ["k"], "t", "s1", {"a": 1}, 10)
    second, more = paging.by_offset(rows, ["k"], "t", "s1", {"a": 1}, 10, cursor)
    third, end = paging.by_offset(rows, ["k"], "t", "s1", {"a": 1}, 10, more)
    assert [r.k for f in (first, second, third) for r in f.collect()] == list(range(25)) and end is None
    for kind, snapshot, request in (("u", "s1", {"a": 1}), ("t", "s2", {"a": 1}), ("t", "s1", {"a": 2})):
        with pytest.raises(paging.InvalidCursor):
            paging.by_offset(rows, ["k"], kind, snapshot, request, 10, cursor)
    for bad in ("", "x", "!!!!", cursor + "AAAA", paging.encode({"after": 1}), paging.encode({**paging.decode(cursor, {"version", "kind", "snapshot", "request", "offset"}), "more": 1})):
        with pytest.raises(paging.InvalidCursor):
            paging.by_offset(rows, ["k"], "t", "s1", {"a": 1}, 10, bad)
    assert paging.by_offset(rows.limit(0), ["k"], "t", "s1", {}, 10)[1] is None


def test_keyset_guard_and_fields(spark):
    rows = spark.createDataFrame([(f"u{i}", i, "T" if i % 2 else "S", f"t{i % 3}") for i in range(9)], "uri string, n int, type string, title string")
    page, cursor = paging.by_key(rows, "uri", 4)
    after, _ = paging.by_key(rows, "uri", 4, cursor)
    assert [r.uri for r in page.collect()] + [r.uri for r in after.collect()] == [f"u{i}" for i in range(8)]
    with pytest.raises(paging.InvalidCursor):
        paging.by_key(rows.where("uri <> 'u3'"), "uri", 4, cursor)
    assert [r.n for r in paging.by_key(rows, "n", 3, paging.encode({"after": 5}), descending=True)[0].collect()] == [4, 3, 2]
    assert paging.guarded(rows, 9).count() == 9
    for limit in (8, 0, 10_001):
        with pytest.raises(ValueError, match="limit"):
            paging.guarded(rows, limit)
    assert paging.fields(rows, " n, uri ", ("uri",), ("uri", "n")).columns == ["n", "uri"] and paging.fields(rows, "", ("uri",), ("uri",)).columns == ["uri"]
    for bad in ("n,n", "n,", "x"):
        with pytest.raises(ValueError, match="field"):
            paging.fields(rows, bad, ("uri",), ("uri", "n"))
    assert [r.uri for r in paging.refs_of_type(rows, "T").collect()] == ["u3", "u1", "u7", "u5"]
    assert [r.uri for r in paging.of_type(rows, "S").collect()] == ["u0", "u2", "u4", "u6", "u8"]


def test_fields_that_a_new_version_does_not_know_are_kept(spark):
    one = spark.createDataFrame([({"a": "1", "b": "2", "c": "3"}, {"a": "9"}), (None, {"a": "8"})], "cur map<string,string>, new map<string,string>")
    got = [r[0] for r in one.select(paging.merged_fields(F.col("cur"), F.col("new"), ("b",))).collect()]
    assert got == [{"a": "9", "c": "3"}, {"a": "8"}]


def test_code_path_counts_visits(spark):
    arcs = [("r1", "A", "B"), ("r2", "B", "A"), ("r3", "B", "C"), ("r0", "A", "D"), ("r4", "A", "B"), ("r5", "D", "E")]
    adjacent = spark.createDataFrame(arcs, "relation_id string, from_id string, to_id string")
    assert code.path(adjacent, "A", "C") == {"symbols": ["A", "B", "C"], "relations": ["r1", "r3"], "truncated": False}
    assert code.path(adjacent, "A", "C", limit=1) == {"symbols": [], "relations": [], "truncated": True}
    # visited in order: A, B, D, C, E
    assert code.path(adjacent, "A", "C", limit=4)["symbols"] == ["A", "B", "C"] and code.path(adjacent, "A", "C", limit=3)["truncated"]
    assert code.path(adjacent, "A", "C", depth=1) == {"symbols": [], "relations": [], "truncated": False}
    assert code.path(adjacent, "C", "A", "in")["symbols"] == ["C", "B", "A"] and code.path(adjacent, "A", "A")["symbols"] == ["A"]
    symbols = spark.createDataFrame([("A",)], "id string")
    assert code.symbol(symbols, "A").count() == 1
    with pytest.raises(KeyError):
        code.symbol(symbols, "Z")
    spans = spark.createDataFrame([(1, 1, 1, 1), (1, 5, 2, 1), (1, 5, 1, 4), (0, 1, 1, 1), (3, 1, 2, 9)], "a int, b int, c int, d int")
    assert [r[0] for r in spans.select(code.span_is_valid(*[F.col(c) for c in "abcd"])).collect()] == [True, True, False, False, False]
    paths = spark.createDataFrame([(p,) for p in ("a/b.go", "", "/a", ".", "../a", "a/../b", None)], "p string")
    assert [r[0] for r in paths.select(code.path_is_valid(F.col("p"))).collect()] == [True] + [False] * 6


def test_learning_from_runs(spark):
    schema = "run_id string, sequence int, kind string, content string, metadata string, knowledge_uri string, knowledge_revision string, feedback string"
    meta = '{"success": %s, "procedure_uri": "kb://p", "procedure_revision": "%s"}'
    rows = [("a", 0, "knowledge_use", "x", None, "kb://k", "r", None), ("a", 1, "outcome", "fine", meta % ("true", "1"), None, None, None), ("b", 0, "feedback", "y", None, "kb://k", "r", "up"), ("b", 1, "outcome", "bad", meta % ("false", "1"), None, None, None), ("c", 1, "outcome", "gap", meta % ("true", "1"), None, None, None), ("d", 0, "outcome", "q", '{"success": "yes"}', None, None, None), ("e", 0, "outcome", "o", meta % ("true", "2"), None, None, None)]
    entries = spark.createDataFrame(rows, schema)
    runs = trace.selected_runs([("b", "key"), (" a ", "key ")])
    got = trace.learned(entries, runs)
    assert [(r.run_id, r.supporting) for r in got["outcomes"].collect()] == [("a", True), ("b", False)]
    assert [r.feedback for r in got["attributions"].collect()] == [None, "up"] and got["evidence"].count() == 4
    text = trace.proposal(got, "T", "body")
    assert "supports: fine (run a, entry 1)" in text and "contradicts: bad" in text and "kb://p at 1" in text
    for bad, most in ((["c"], 200), (["a", "b"], 3), (["a", "e"], 200), (["zz"], 200)):
        with pytest.raises(ValueError, match="run|exceeds|procedure"):
            trace.learned(entries, bad, most)
    with pytest.raises(Exception, match="boolean"):
        trace.learned(entries, ["d"])["outcomes"].collect()
    for bad in ([], [("a", "k"), ("a", "k")], [("a", "k"), ("b", "l")], [("", "k")], [("a", " ")]):
        with pytest.raises(ValueError):
            trace.selected_runs(bad)


def test_vector_codecs_and_query(spark):
    v = spark.createDataFrame([([1.0, -2.5, 0.0],), (None,)], "v array<float>")
    got = v.select(vectors.literal(F.col("v")).alias("t"), vectors.from_bytes(vectors.to_bytes(F.col("v"))).alias("b")).collect()
    assert got[0].t == "[1,-2.5,0]" and list(got[0].b) == [1.0, -2.5, 0.0] and got[1].t is None and got[1].b is None
    assert list(spark.range(1).select(vectors.from_literal(F.lit("[1,-2.5,0]"))).first()[0]) == [1.0, -2.5, 0.0]
    chunks = semantic.embed(spark.createDataFrame([("a", 0, "red fox"), ("b", 0, "blue sea"), ("gone", 0, "red fox")], "uri string, chunk int, content string"), semantic.hash_embedder(16))
    live = spark.createDataFrame([("a", "active"), ("b", "archived")], "uri string, status string")
    meta = {"model": "m", "fingerprint": "f", "dimensions": 16}
    got = semantic.query(chunks, meta, "red fox", semantic.hash_embedder(16), live, "m", "f", 16, 5).collect()
    assert [(r.uri, r.status) for r in got] == [("a", "active"), ("b", "archived")]
    asked = []
    for wrong in (None, meta | {"model": "n"}, meta | {"fingerprint": "g"}, meta | {"dimensions": 8}):
        with pytest.raises(ValueError, match="index"):
            semantic.query(chunks, wrong, "q", lambda x: asked.append(x), live, "m", "f", 16, 5)
    assert not asked


def test_pointer_is_never_missing_and_conflicts(spark, tmp_path):
    pointer, other = (stores.Pointer(spark, str(tmp_path / "current")) for _ in range(2))
    mark = pointer.replace({"n": 0}, None)
    seen = []
    rename = pointer.fs.rename

    class Watched:
        """A reader looks between the writer's steps."""

        def __getattr__(self, name):
            seen.append(other.read()[0])
            return getattr(stores.Pointer(spark, str(tmp_path / "current")).fs, name)

    pointer.fs = Watched()
    for n in range(1, 15):
        mark = pointer.replace({"n": n}, mark)
    assert rename is not None and all(s is not None for s in seen) and seen[-1]["n"] >= 13
    with pytest.raises(stores.Conflict):
        other.replace({"n": 99}, None)
    assert other.read()[0] == {"n": 14} and len(list((tmp_path / "current").glob("*.json"))) == stores.KEPT_STATES
    cursor = stores.SourceCursor(spark, str(tmp_path), "a/b")
    state, mark = cursor.load()
    assert state == {"since": None, "page": 1}
    mark = cursor.paused(None, 4, mark)
    assert cursor.load()[0]["page"] == 4
    cursor.completed(1000.0, mark)
    assert cursor.load()[0] == {"since": 940.0, "page": 1}
    with pytest.raises(stores.Conflict):
        cursor.completed(2000.0, mark)


def test_listings_have_no_cap_and_resume(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"{i:03}.json").write_text(f'[{{"id": {i}}}]')
    spark.dataSource.register(payloads.PagedListing)
    read = lambda **o: spark.read.format("paged_listing").options(path=str(tmp_path), **o).load().count()
    assert read() == 30 and read(firstPage=26) == 5 and read(firstPage=3, maxPages=4) == 4


def test_write_rules_and_bundle(spark, tmp_path):
    (tmp_path / "v").mkdir()
    files = {"concepts/note.md": "---\ntype: Concept\ntitle: Note\npath: notes\n---\nx", "notes/a.md": "---\ntype: Note\ntitle: A\n---\nx"}
    for path, content in files.items():
        (tmp_path / "v" / path).parent.mkdir(exist_ok=True)
        (tmp_path / "v" / path).write_text(content)
    pages = vault.scan(spark, str(tmp_path / "v"), "v").cache()
    root = pages.first()["root"]
    page = lambda body, type_="Note", title="title: B\n": f"---\ntype: {type_}\n{title}---\n{body}"
    assert vault.check_write(pages, root, "v", "notes/b.md", page("[a](a.md)"))["title"] == "B"
    for path, content, why in (("notes/b.md", page("x", title=""), "title"), ("notes/b.md", page("x", "Other"), "no Concept"), ("else/b.md", page("x"), "outside"), ("notes/b.md", page("[z](z.md)"), "nothing")):
        with pytest.raises(ValueError, match=why):
            vault.check_write(pages, root, "v", path, content)
    with pytest.raises(ValueError, match="already"):
        vault.check_write(pages, "/other/root", "v", "notes/a.md", page("x"))
    assert vault.check_write(pages, "/other/root", "v", "notes/a.md", page("x"), update=True)
    assert vault.write_page(spark, str(tmp_path / "v"), "notes/b.md", "one") and vault.write_page(spark, str(tmp_path / "v"), "notes/b.md", "two")
    assert (tmp_path / "v/notes/b.md").read_text() == "two" and not vault.write_page(spark, str(tmp_path / "v"), "notes/b.md", "two")
    assert not list((tmp_path / "v/notes").glob("*.new"))
    both = vault.effective(pages.unionByName(vault.bundled(spark)))
    assert both.count() == 2 + len(vault.BUNDLED) and both.where("problem IS NOT NULL").count() == 0
    assert [r.vault for r in vault.vaults(spark, [("v", "/v")]).orderBy("precedence").collect()] == ["v", "core"] and vault.vaults(spark, [("core", "/c")]).count() == 1


def test_neighbours_come_in_order(spark):
    edges = spark.createDataFrame([("b", "x", "r", "1"), ("a", "x", "s", "1"), ("a", "x", "r", "2"), ("a", "x", "r", "1")], "from_uri string, to_uri string, relation string, raw string").repartition(3)
    assert [(r.from_uri, r.relation, r.raw) for r in graph.neighbours(edges, "x").collect()] == [("a", "r", "1"), ("a", "s", "1"), ("b", "r", "1")]


def test_service_answers_are_checked_and_pages_synced(spark, tmp_path):
    import json

    answer = lambda items: lambda texts: json.dumps({"data": items}).encode()
    good = answer([{"index": 1, "embedding": [0, 1]}, {"index": 0, "embedding": [1, 0]}])
    assert semantic.service_embedder(good)(["a", "b"]) == [[1.0, 0.0], [0.0, 1.0]]
    for bad in ([{"index": 0, "embedding": [1]}], [{"index": 0, "embedding": [1]}] * 2, [{"index": 0, "embedding": [1]}, {"index": 2, "embedding": [1]}], [{"index": 0, "embedding": [1]}, {"index": 1, "embedding": [1, 2]}]):
        with pytest.raises(ValueError):
            semantic.service_embedder(answer(bad))(["a", "b"])
    with pytest.raises(ValueError, match="bytes"):
        semantic.service_embedder(good, most=10)(["a", "b"])
    index = stores.VectorIndex(spark, str(tmp_path / "i"))
    pages = spark.createDataFrame([("a", "red fox"), ("b", "x" * 7000)], "uri string, body string")
    semantic.sync(pages, semantic.hash_embedder(8), lambda c, f, n: index.replace(c, "s", "hash", f, n), "f1")
    assert index.read("s").count() == 3 and index.meta("s")["dimensions"] == 8
    for empty, embedder in ((pages.limit(0), semantic.hash_embedder(8)), (pages, lambda texts: [[0.0, 0.0]] * len(texts))):
        with pytest.raises(ValueError):
            semantic.sync(empty, embedder, lambda *_: None, "f")


def test_maintainer_tries_again(spark, tmp_path):
    from quillspark.streaming import pipelines

    files = spark.createDataFrame([("a.py", "1", "python", "x")], "path string, digest string, language string, text string")
    symbols = spark.createDataFrame([("s", "d", "a", "a")], "id string, document_id string, name string, qualified_name string")
    relations = spark.createDataFrame([("r", "d", "a", "b")], "id string, document_id string, source string, target string")
    calls = []

    def analyze(_files):
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("not yet")
        return symbols, relations

    kept = pipelines.IndexMaintainer(stores.GenerationStore(spark, str(tmp_path / "g")), lambda: files, analyze, wait=0.01)
    kept.reconcile()
    assert len(calls) == 3 and kept.state == "current" and kept.read_current()["symbols"].count() == 1
    stuck = pipelines.IndexMaintainer(stores.GenerationStore(spark, str(tmp_path / "h")), lambda: files, lambda _f: 1 / 0, retries=1, wait=0.01)
    with pytest.raises(ZeroDivisionError):
        stuck.reconcile()
    assert stuck.state == "failed"
