import hashlib
import random
import zlib

import pytest

from quillspark.llm import manifest


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _value(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _levels(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([_h(*now[i : i + 2]) for i in range(0, len(now), 2)])
    return levels


def _siblings(levels, place):
    out = []
    for level in levels[:-1]:
        other = place ^ 1
        out.append((level[other], other < place) if other < len(level) else (None, False))
        place //= 2
    return out


def slow(rows):
    """(doc_id, source, lang, n_chars, text) rows -> the query's rows, by plain lists."""
    made = [(r, _h(*map(_value, r))) for r in rows]
    groups = {}
    for r, leaf in made:
        groups.setdefault(r[2], []).append((r, leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for own in groups.values():
        own.sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    trees = {g: _levels([leaf for _, leaf in groups[g]]) for g in names}
    top = _levels([trees[g][-1][0] for g in names])
    root = top[-1][0]
    out = []
    for k, g in enumerate(names):
        for i, (r, leaf) in enumerate(groups[g]):
            path = _siblings(trees[g], i) + _siblings(top, k)
            start = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                start = _h(*map(_value, (*r[:3], r[3] + 1, r[4])))
            for sibling, left in path:
                start = _h(sibling or "", start) if left else _h(start, sibling or "")
            out.append((r[0], leaf, trees[g][-1][0], root, _h(*[s for s, _ in path if s]), start, start == root))
    return sorted(out, key=str)


def _rows(rng, n, langs):
    return [(rng.choice([i, i, i, i // 2, None]), rng.choice(["s", None]), rng.choice(langs), rng.choice([None, i]), rng.choice(["é𝄞 text", "", None, "x:1"])) for i in range(n)]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("height", [1, 3, 8])
def test_query_against_plain_lists(spark, stored, monkeypatch, height):
    monkeypatch.setattr(manifest, "HEIGHT", height)
    rng = random.Random(height)
    rows = _rows(rng, 90, ["en"] * 12 + ["de", "é", None, "z"]) + [(7, "s", "en", 3, "same")] * 5
    path = stored(documents=spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS rank", "2 AS grp", "3 AS nodes"))
    got = manifest.op12_merkle_manifest(spark, path)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == slow(rows)


def test_one_leaf_and_none(spark, stored):
    one = spark.createDataFrame([(1, None, None, None, None)], SCHEMA)
    r = manifest.op12_merkle_manifest(spark, stored(documents=one)).first()
    assert r.leaf == r.subroot == r.root == _h("1:1", "-", "-", "-", "-") and r.proof_sha256 == _h("") and r.verified


def test_empty_table(spark, stored):
    none = spark.createDataFrame([], SCHEMA)
    assert manifest.op12_merkle_manifest(spark, stored(documents=none)).count() == 0


def test_nodes_nest(spark, monkeypatch):
    monkeypatch.setattr(manifest, "HEIGHT", 2)
    rows = [(g, i, _h(str(i))) for g, n in (("a", 37), (None, 1), ("b", 16)) for i in range(n)]
    built = manifest.build(spark.createDataFrame(rows, "grp string, ord long, digest string"))
    got = {}
    for r in built.nodes().collect():
        assert (r.grp, r.level, r.lo) not in got
        got[(r.grp, r.level, r.lo)] = (r.hi, r.digest)
    want = {}
    for g, n in (("=a", 37), ("", 1), ("=b", 16)):
        for level, row in enumerate(_levels([_h(str(i)) for i in range(n)])):
            want |= {(g, level, i << level): (min((i + 1) << level, n), d) for i, d in enumerate(row)}
    assert got == want
