import json
import os

import pytest
from pyspark.sql import functions as F

from quillspark.operators import audit, semantic
from quillspark.sources import code as code_source
from quillspark.sources import payloads, stores
from quillspark.streaming import pipelines


def test_snapshots(spark, tmp_path):
    store = stores.SnapshotStore(spark, str(tmp_path / "s"))
    pages = spark.createDataFrame([("a.md", b"x"), ("b.md", b"x"), ("c.md", b"y")], "path string, content binary")
    mark = store.publish(pages, None)
    assert {(r.path, bytes(r.content)) for r in store.read().collect()} == {("a.md", b"x"), ("b.md", b"x"), ("c.md", b"y")}
    with pytest.raises(stores.Conflict):
        store.publish(pages, None)
    store.publish(pages.where("path <> 'c.md'"), mark)
    assert store.read().count() == 2


def test_snapshot_names_are_hashed_in_parts(spark, tmp_path):
    store = stores.SnapshotStore(spark, str(tmp_path / "s"))
    pages = spark.createDataFrame([("a.md", b"x"), ("b.md", b"x"), ("c.md", b"y")], "path string, content binary")
    store.publish(pages, None)
    want = audit.snapshot_digest(pages.select(F.col("path").alias("uri"), F.sha2("content", 256).alias("revision"))).first()["digest"]
    assert "sha256:" + store.current.read()[0]["manifest"] == want
    assert store.read().count() == 3


def test_generations(spark, tmp_path):
    store = stores.GenerationStore(spark, str(tmp_path / "g"), kept=1)
    for i in range(4):
        store.publish({"t": spark.range(i + 1)}, f"g{i}")
    assert store.read()["t"].count() == 4 and not (tmp_path / "g" / "generation=g0").exists() and (tmp_path / "g" / "generation=g2").exists()
    with pytest.raises(stores.Conflict):
        store.dispose("g3")


def test_records(spark, tmp_path):
    store = stores.RecordStore(spark, str(tmp_path / "r"), ["key"], ["value"])
    rows = lambda *r: spark.createDataFrame(list(r), "key int, value string, seen string")
    assert store.record(rows((1, "a", "x"), (2, "b", "x"), (2, "b", "y"))) == {"created": 2, "unchanged": 1}
    assert store.record(rows((1, "a", "later"), (2, "c", "x"), (3, "d", "x"))) == {"unchanged": 1, "conflict": 1, "created": 1}
    assert store.read().count() == 3


def test_vectors(spark, tmp_path):
    index, embedder = stores.VectorIndex(spark, str(tmp_path / "v")), semantic.hash_embedder(16)
    pages = spark.createDataFrame([("u1", "apples and pears"), ("u2", "bolts and nuts"), ("u3", "")], "uri string, body string")
    index.replace(semantic.embed(semantic.chunks(pages), embedder), "s", "hash", "f", 16)
    semantic.check_meta(index.meta("s"), "hash", "f", 16)
    for bad in (("other", "f", 16), ("hash", "g", 16), ("hash", "f", 8)):
        with pytest.raises(ValueError):
            semantic.check_meta(index.meta("s"), *bad)
    assert semantic.nearest(index.read("s"), embedder(["apples and pears"])[0], 1).first().uri == "u1"
    with pytest.raises(ValueError):
        index.read("other")


def test_chunks():
    assert [len(x) for x in semantic.pack_paragraphs("a" * 4000 + "\n\n" + "b" * 3000)] == [4000, 3000]
    assert [len(x) for x in semantic.pack_paragraphs("a" * 6001)] == [6000, 1]
    assert semantic.pack_paragraphs("") == [""] and semantic.pack_paragraphs("a\n\nb") == ["a\n\nb"]


def test_paged_listing_and_payloads(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"p{i}.json").write_text(json.dumps([{"node_id": f"n{i}{j}", "updated_at": "2024-01-01T00:00:00Z"} for j in range(2)]))
    spark.dataSource.register(payloads.PagedListing)
    found = payloads.normalised(spark.read.format("paged_listing").option("maxPages", "2").load(str(tmp_path)))
    assert sorted(r.source_id for r in found.collect()) == ["n00", "n01", "n10", "n11"]
    assert payloads.signature_ok(b"k", b"x", "sha256=" + __import__("hmac").new(b"k", b"x", "sha256").hexdigest()) and not payloads.signature_ok(b"k", b"x", "sha256=00")
    made = spark.createDataFrame([("d", '{"commits": [{"sha": "1"}, {"sha": "2"}], "issue": null}')], "delivery_id string, raw_payload string")
    assert payloads.exploded(made, ("commits", "issue")).count() == 2


def _files(spark, root):
    found = code_source.snapshot(spark, str(root), ("python", "go"))
    return found.where("reject IS NULL")


def test_incremental_index(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    (root / "a.py").write_text("def f():\n    return g()\n")
    (root / "b.py").write_text("def g():\n    pass\n")
    (root / "skip.bin").write_bytes(b"\0\1")
    (root / "broken.py").write_text("def (")
    store = stores.GenerationStore(spark, str(tmp_path / "index"))
    keeper = pipelines.IndexMaintainer(store, lambda: _files(spark, root), lambda f: code_source.analyze(f)[:2])
    hints = pipelines.file_hints(spark, str(root))
    keeper.start(hints, str(tmp_path / "ck"), once=True).awaitTermination(120)
    tables = keeper.read_current()
    calls = tables["relations"].where("kind = 'calls'").first()
    assert keeper.state == "current" and calls.target == "g" and calls.resolution == "resolved"
    (root / "b.py").write_text("def h():\n    pass\n")
    keeper.start(pipelines.ticks(spark), str(tmp_path / "ck2"), once=True).awaitTermination(120)
    assert keeper.read_current()["relations"].where("kind = 'calls'").first().resolution == "unresolved"
    assert sorted(r["name"] for r in keeper.read_current()["symbols"].collect()) == ["f", "h"]
    _, _, problems = code_source.analyze(_files(spark, root))
    assert problems.first().path == "broken.py"
    assert {r.path: r.reject for r in code_source.snapshot(spark, str(root), ("python",)).where("reject IS NOT NULL").collect()}.keys() == {"skip.bin"}


def _stream(spark, tmp_path, schema, batches):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, rows in enumerate(batches):
        (folder / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(folder / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def test_deliveries_stream(spark, tmp_path):
    stream = _stream(spark, tmp_path, "delivery_id string, digest string", [[{"delivery_id": "a", "digest": "1"}], [{"delivery_id": "a", "digest": "1"}, {"delivery_id": "b", "digest": "1"}], [{"delivery_id": "a", "digest": "2"}]])
    pipelines.deliveries(stream).writeStream.format("memory").queryName("deliveries").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination(120)
    assert sorted((r.delivery_id, r.result) for r in spark.table("deliveries").collect()) == [("a", "conflict"), ("a", "created"), ("a", "unchanged"), ("b", "created")]


def test_runs_stream(spark, tmp_path):
    rows = lambda *s: [{"run_id": "r", "sequence": n, "kind": k} for n, k in s]
    stream = _stream(spark, tmp_path, "run_id string, sequence long, kind string", [rows((0, "x"), (2, "outcome")), rows((1, "x"))])
    pipelines.run_completeness(stream).writeStream.outputMode("update").format("memory").queryName("runs").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination(120)
    assert [(r.entries, r.complete) for r in spark.table("runs").orderBy("entries").collect()] == [(1, False), (3, True)]


def test_hooks_and_notices(spark, tmp_path):
    events = spark.createDataFrame([("kb://v/a/b.md", "write"), ("kb://v/ab.md", "write")], "uri string, operation string")
    rules = spark.createDataFrame([("p", "prefix", "kb://v/a/"), ("q", "page", "kb://v/ab.md"), ("all", "vault", None), ("none", "prefix", "kb://v/a/b")], "hook string, scope string, target string")
    due = pipelines.deliveries_due(events, rules)
    assert sorted((r.hook, r.uri[-4:]) for r in due.collect()) == [("all", "b.md"), ("all", "b.md"), ("p", "b.md"), ("q", "b.md")]
    assert {r.hook for r in due.where("uri LIKE '%/a/b.md'").collect()} == {"all", "p"}

    def send(row):
        import time

        if row["hook"] == "p":
            time.sleep(3)
        if row["hook"] == "q":
            raise RuntimeError("token s3cret refused")
        return "said s3cret " + "x" * 100

    got = {r.hook: (r.result, r.output) for r in pipelines.deliver(due, send, timeout=0.5, output=20, secrets=("s3cret",)).collect()}
    assert got == {"all": ("delivered", "said [redacted] xxxx"), "p": ("timeout", ""), "q": ("failed", "token [redacted] ref")}
    told, now = [], [spark.createDataFrame([("a", "1", "o"), ("b", "1", "o")], "uri string, revision string, origin string"), spark.createDataFrame([("a", "2", "o"), ("c", "1", "o")], "uri string, revision string, origin string")]
    run = pipelines.notices(stores.GenerationStore(spark, str(tmp_path / "n")), lambda: now[0], lambda u, c: told.append((u, c)))
    run(None, 0)
    now.pop(0)
    run(None, 1)
    assert told == [("a", "updated"), ("b", "removed"), ("c", "added")]
