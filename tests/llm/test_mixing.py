import re
from collections import defaultdict

import pytest

from quillspark.llm import mixing


def _level(sizes):
    """Targets by resharing the excess step by step."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = {s for s in rest if share[s] > 3 * sizes[s]}
        if not over:
            return {s: share.get(s, 3.0 * sizes[s]) for s in names}
        capped |= over


def test_targets_and_copies(spark, docs_of):
    rows = [(i, "w " * (i % 37), ["a", "b", "c", None, "tiny"][0 if i % 3 == 0 else i % 5 if i % 50 else 4]) for i in range(3000)]
    got = mixing.mixed(docs_of(rows)).collect()
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text))
    want, taken = _level(sizes), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.copies <= 3
        taken[r.source] += r.size * r.copies
    for s in sizes:
        assert taken[s] == pytest.approx(want[s], rel=0.1)


def test_edge_cases(docs_of):
    assert mixing.mixed(docs_of([(1, "x")]).limit(0)).count() == 0
    got = mixing.mixed(docs_of([(1, None), (1, None), (2, "")])).collect()
    assert [(r.size, r.target, r.copies) for r in got] == [(0, 0.0, 0)] * 3
    alone = mixing.mixed(docs_of([(1, "a b"), (2, "c")])).collect()
    assert {(r.doc_id, r.copies, r.target) for r in alone} == {(1, 1, 3.0), (2, 1, 3.0)}
    clash = mixing.mixed(docs_of([(1, "a b")]).selectExpr("*", "1 AS target", "2 AS size", "3 AS rate")).first()
    assert clash["size"] == 2


def test_null_and_repeated_ids_draw_by_text(docs_of):
    rows = [(None, f"w{i} " * 20, "null ids") for i in range(900)] + [(7, f"v{i} " * 20, "one id") for i in range(900)] + [(10_000 + i, "u " * 20, "others") for i in range(600)]
    taken = defaultdict(int)
    target = {}
    for r in mixing.mixed(docs_of(rows)).collect():
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
    for s in target:
        assert 0 < target[s] and taken[s] == pytest.approx(target[s], rel=0.1)
