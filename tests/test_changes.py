import json
import os
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from quillspark.sources import changes
from quillspark.streaming import pipelines


def _drain(stream, table, tmp_path, mode="append"):
    """What a run that ends by itself has told, as rows of a table that runs add up in."""
    out = []
    query = stream.writeStream.outputMode(mode).foreachBatch(lambda frame, _n: out.extend(frame.collect())).option("checkpointLocation", str(tmp_path / table)).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return out


def test_edits_renames_and_deletions_are_events(spark, tmp_path):
    root = tmp_path / "src" / "deep"
    root.mkdir(parents=True)
    (root / "a.py").write_text("1")
    (root / "b.py").write_text("1")
    stream = lambda: pipelines.file_changes(spark, str(tmp_path / "src"), str(tmp_path / "state"))
    told = lambda: sorted((r.path, r.change) for r in _drain(stream(), "ck", tmp_path))
    assert told() == [("deep/a.py", "new"), ("deep/b.py", "new")]
    assert told() == []
    (root / "a.py").write_text("22")
    (root / "b.py").rename(root / "c.py")
    assert told() == [("deep/a.py", "changed"), ("deep/b.py", "gone"), ("deep/c.py", "new")]
    (root / "c.py").unlink()
    os.utime(root / "a.py", (1, 1))
    assert told() == [("deep/a.py", "changed"), ("deep/c.py", "gone")]
    assert len(list((tmp_path / "state").iterdir())) <= 2


def test_a_batch_that_is_planned_again_has_the_same_rows(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x").write_text("1")
    reader = lambda: changes.FileChangesReader({"path": str(tmp_path / "a"), "state": str(tmp_path / "s")})
    first = reader()
    end = first.latestOffset()
    (tmp_path / "a" / "x").unlink()
    again = reader()
    rows = [r for p in again.partitions(first.initialOffset(), end) for r in again.read(p)]
    assert [r[:2] for r in rows] == [("x", "new")]
    later = again.latestOffset()
    again.commit(end)
    assert [r[:2] for p in again.partitions(end, later) for r in again.read(p)] == [("x", "gone")]


@pytest.fixture
def service():
    class State:
        records = {"/issues": [{"id": i, "updated_at": f"2024-01-{i + 1:02}T00:00:00Z"} for i in range(7)], "/commits": [{"id": 100 + i, "updated_at": "2024-01-01T00:00:00Z"} for i in range(3)]}
        allowed, reset, asked = 100, "0", []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            at = urlsplit(self.path)
            query = {k: int(v[0]) for k, v in parse_qs(at.query).items()}
            State.asked.append((at.path, query["page"]))
            State.allowed -= 1
            self.send_response(200 if State.allowed >= 0 else 429)
            if State.allowed < 0:
                self.send_header("X-RateLimit-Reset", State.reset)
            self.end_headers()
            n, page = query["per_page"], query["page"]
            self.wfile.write(json.dumps(State.records[at.path][n * (page - 1) : n * page]).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    State.url = f"http://127.0.0.1:{server.server_port}"
    yield State
    server.shutdown()


def test_a_stopped_listing_goes_on_without_loss_or_repeats(spark, tmp_path, service):
    spark.dataSource.register(changes.RestListing)
    options = {"url": service.url, "listings": "issue=/issues,commit=/commits", "state": str(tmp_path / "log"), "perPage": "3", "pagesPerBatch": "2", "every": "1000000"}
    drain = lambda: _drain(spark.readStream.format("rest_listing").options(**options).load(), "ck", tmp_path)
    ids = lambda rows: sorted(json.loads(r.raw_payload)["id"] for r in rows)
    service.allowed = 1
    assert ids(drain()) == [0, 1, 2]
    assert drain() == []  # still refused; the offset stays
    service.allowed = 100
    found = []
    for _ in range(4):
        found += drain()
    assert ids(found) == [3, 4, 5, 6, 100, 101, 102]
    assert {r.kind for r in found} == {"issue", "commit"}
    asked = len(service.asked)
    assert drain() == [] and len(service.asked) == asked  # the next round is not due
    # pages stay until the batch after theirs is planned
    assert sorted(int(x.stem) for x in (tmp_path / "log").iterdir()) == [3, 4, 5]


def test_a_later_round_counts_what_was_updated_since(tmp_path, service):
    now = [1_704_412_800.0]  # 2024-01-05
    reader = changes.RestListingReader({"url": service.url, "listings": "issue=/issues", "state": str(tmp_path / "log"), "perpage": "5", "pagesperbatch": "9"}, clock=lambda: now[0])
    rows = lambda a, b: [json.loads(r[2])["id"] for p in reader.partitions(a, b) for r in reader.read(p)]
    first = reader.latestOffset()
    assert rows(reader.initialOffset(), first) == list(range(7)) and first["page"] == 2
    now[0] += 3600
    second = reader.latestOffset()
    assert second["since"] == "2024-01-04T23:59:00Z" and rows(first, second) == [4, 5, 6]
    service.allowed, service.reset = 0, str(now[0] + 500)
    assert reader.latestOffset() == second
    asked, service.allowed = len(service.asked), 100
    assert reader.latestOffset() == second and len(service.asked) == asked
    now[0] += 501
    assert reader.latestOffset()["entry"] > second["entry"]


def _rows(tmp_path, name, batches):
    folder = tmp_path / name
    folder.mkdir()
    for i, rows in enumerate(batches):
        (folder / f"{i:03}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(folder / f"{i:03}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    return str(folder)


def _at(minute):
    return f"2024-01-01T{minute // 60:02}:{minute % 60:02}:00"


def test_deliveries_and_runs_are_let_go(spark, tmp_path):
    n = 8
    sent = [[{"id": f"d{i}", "at": _at(10 * i)}, {"id": f"d{max(i - 1, 0)}", "at": _at(10 * i)}] for i in range(n)] + [[{"id": "d0", "at": _at(10 * n)}]]
    stream = spark.readStream.schema("id string, at timestamp").option("maxFilesPerTrigger", 1).json(_rows(tmp_path, "sent", sent)).withWatermark("at", "0 seconds")
    found = _drain(pipelines.deliveries(stream.select(F.col("id").alias("delivery_id"), F.lit("x").alias("digest"), "at"), keep=1500, at="at"), "ck1", tmp_path)
    told = {}
    for r in found:
        told.setdefault(r.delivery_id, []).append(r.result)
    assert told["d0"].count("created") == 2 and told["d0"].index("released") < len(told["d0"]) - 1
    assert told["d3"] == ["created", "unchanged", "released"]
    # of the deliveries, only those of the last minutes are still held
    assert sum(v.count("created") - v.count("released") for v in told.values()) <= 4
    entries = [[{"run": f"r{i}", "n": 0, "kind": "x", "at": _at(10 * i)}] + ([{"run": f"r{i}", "n": 1, "kind": "outcome", "at": _at(10 * i)}] if i % 2 else []) for i in range(n)]
    stream = spark.readStream.schema("run string, n long, kind string, at timestamp").option("maxFilesPerTrigger", 1).json(_rows(tmp_path, "runs", entries)).withWatermark("at", "0 seconds")
    found = _drain(pipelines.run_completeness(stream.select(F.col("run").alias("run_id"), F.col("n").alias("sequence"), "kind", "at"), keep=900, at="at"), "ck2", tmp_path, "update")
    released = {r.run_id: (r.entries, r.complete) for r in found if r.released}
    assert released["r0"] == (1, False) and released["r1"] == (2, True) and len(released) >= n - 4
