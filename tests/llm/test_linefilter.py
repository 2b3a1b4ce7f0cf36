import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import linefilter


def slow(rows, known=None, limit=10):
    """(doc_id, text) rows -> (doc_id, lines, dropped, kept), with counts over ``known``."""
    white = "".join(map(chr, [32, *range(9, 14)]))
    upper = {c: c + 32 for c in range(65, 91)}
    key = lambda line: line.strip(white).translate(upper)
    refs = Counter(k for _, t in known or rows for k in {key(x) for x in (t or "").split("\n")} - {""})
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if refs[key(x)] < limit]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def _rows(rng, n):
    pool = [f"  Common Line {i}\t" for i in range(30)] + ["HOT", " hot\r", "\x1cHOT", "É", "é", "", "  "]
    texts = ["\n".join(rng.choice(pool) if rng.random() < 0.5 else f"own {rng.random()}" for _ in range(rng.randint(0, 9))) for _ in range(n)]
    return [(rng.choice([i, i, None, i // 2]), rng.choice([t, t, t, t, None])) for i, t in enumerate(texts)] + [(5, "hot\nSame row")] * 12 + [(i, "hot") for i in range(200)]


def _told(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_filter_holds_what_is_put_in():
    rng = np.random.default_rng(2)
    hi, lo = rng.integers(0, 2**64, (2, 60_000), np.uint64)
    held = linefilter.Cuckoo.of(hi[:20_000], lo[:20_000])
    assert held.contains(hi[:20_000], lo[:20_000]).all()
    assert held.contains(hi[20_000:], lo[20_000:]).mean() < 0.001
    held.delete(hi[:15_000], lo[:15_000])
    assert held.contains(hi[15_000:20_000], lo[15_000:20_000]).all()
    assert held.contains(hi[:15_000], lo[:15_000]).mean() < 0.001
    assert held.insert(hi[20_000:30_000], lo[20_000:30_000]) and held.contains(hi[15_000:30_000], lo[15_000:30_000]).all()
    again = linefilter.Cuckoo.read(held.slots.tobytes())
    again.delete(hi[15_000:30_000], lo[15_000:30_000])
    assert not again.slots.any()


def test_equal_fingerprints_and_growth():
    hi = np.full(40, 7, np.uint64)
    lo = np.arange(40, dtype=np.uint64) * np.uint64(1 << 3)
    held = linefilter.Cuckoo.of(hi, lo)
    assert held.contains(hi, lo).all() and (held.slots > 0).sum() == 40
    held.delete(hi[:39], lo[:39])
    assert held.contains(hi[39:], lo[39:]).all() and (held.slots > 0).sum() == 1


@pytest.mark.parametrize(("keys", "most", "part"), [(1 << 17, 1 << 26, 1 << 20), (16, 1 << 26, 1 << 20), (16, -1, 20)])
def test_dropped_lines_against_brute_force(spark, monkeypatch, keys, most, part):
    monkeypatch.setattr(linefilter, "KEYS", keys)
    monkeypatch.setattr(linefilter, "PART", part)
    rows = _rows(random.Random(4), 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS shard", "'x' AS kept", "2 AS row").repartition(3)
    index = linefilter.build(docs)
    assert _told(linefilter.without_common_lines(docs, index, most)) == slow(rows)
    assert index.shards == 1 if keys > 16 else index.shards > 8


def test_wrong_hits_of_the_filter_are_listed(monkeypatch):
    # two bits of a fingerprint: most keys hit
    monkeypatch.setattr(linefilter, "places", lambda hi, lo, mask, known=linefilter.places: known(hi & np.uint64(3), lo, mask))
    keys = [linefilter.hashes([b"key %d" % i])[0] for i in range(500)]
    hi, lo = linefilter._halves(keys)
    refs = 1 + np.arange(500) // 20

    def table(was, now):
        return pa.table({"hi": hi.view(np.int64), "lo": lo.view(np.int64), "refs": now, "was": was, "shard": pa.array([0] * 500, pa.int32())})

    empty = pa.table({"shard": pa.array([], pa.int32()), "slots": pa.array([], pa.binary()), "not_common": pa.array([], pa.binary())})
    update = linefilter._updated(10)
    held = empty
    for was, now in ((refs * 0, refs), (refs, refs[::-1].copy()), (refs[::-1].copy(), refs * 0)):
        held = update(table(was, now), held)
        raw = held.column("not_common")[0].as_py()
        filters = linefilter.Filters(1, [(0, held.column("slots")[0].as_py(), raw)])
        assert filters.common(keys) == (now >= 10).tolist()
        assert len(filters.not_common) > 20 or not now.any()


def test_insertions_and_deletions_are_reversible(spark, monkeypatch):
    monkeypatch.setattr(linefilter, "KEYS", 64)
    rng = random.Random(8)
    old, new = _rows(rng, 200), _rows(rng, 150)
    first, more = (spark.createDataFrame(r, "doc_id long, text string") for r in (old, new))
    start = linefilter.build(first)
    grown = linefilter.inserted(start, more)
    assert _told(linefilter.without_common_lines(first, grown)) == slow(old, old + new)
    assert _told(grown.refs) == _told(linefilter.build(first.unionByName(more)).refs)
    back = linefilter.deleted(grown, more)
    assert _told(back.refs) == _told(start.refs)
    assert _told(linefilter.without_common_lines(first, back)) == slow(old) != slow(old, old + new)
    rest = linefilter.deleted(grown, first)
    assert _told(linefilter.without_common_lines(more, rest)) == slow(new)
    with pytest.raises(ValueError, match="never inserted"):
        linefilter.deleted(start, more)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    index = linefilter.build(none)
    assert linefilter.without_common_lines(none, index).count() == 0 and index.refs.count() == 0
    assert linefilter.without_common_lines(none, index, -1).count() == 0
    one = spark.createDataFrame([(1, "a\n\nA")], "doc_id long, text string")
    assert _told(linefilter.without_common_lines(one, linefilter.inserted(index, one))) == [(1, 3, 0, "a\n\nA")]
