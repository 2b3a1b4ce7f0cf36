import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import neardup


def _set(text, k):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(found[i : i + k]) for i in range(len(found) - k + 1)} if len(found) >= k else {tuple(found)} if found else set()


def _expected(rows, k, percent):
    sets = [_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= percent * len(sets[i] | sets[j]):
                    parent[root(i)] = root(j)
    ids = defaultdict(list)
    for i in range(len(rows)):
        ids[root(i)].append(rows[i][0])
    return sorted((rows[i][0], len(sets[i]), min(ids[root(i)])) for i in range(len(rows)))


def _families(rnd, families, copies, vocabulary=3000, most=160):
    rows = []
    shared = [f"p{i}" for i in range(60)]
    for _ in range(families):
        base = [f"w{rnd.randrange(vocabulary)}" for _ in range(rnd.randint(1, most))]
        if rnd.random() < 0.4:
            base[3:3] = shared
        for _ in range(rnd.randint(1, copies)):
            own = list(base)
            for _ in range(rnd.randint(0, max(1, len(own) // 18))):
                own[rnd.randrange(len(own))] = rnd.choice(["x", "Y", f"w{rnd.randrange(vocabulary)}"])
            rows.append(" ".join(own))
    rnd.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("k", "percent", "seed", "cell"), [(4, 85, 1, 1024), (5, 80, 2, 8), (2, 50, 4, 4)])
def test_components_equal_brute_force(docs_of, monkeypatch, k, percent, seed, cell):
    rnd = random.Random(seed)
    rows = _families(rnd, 40, 8) + [(5000, None), (5001, ""), (5002, " \n"), (5003, "One two"), (5004, "one TWO"), (5005, "one"), (5006, "t " * 20000), (5007, "T " * 9)]
    monkeypatch.setattr(neardup, "CELL", cell)
    got = neardup.linked_components(docs_of(rows), k, percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == _expected(rows, k, percent)


def test_large_family_of_near_copies(docs_of):
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(5000)}" for _ in range(220)]
    rows = []
    for i in range(260):
        own = list(base)
        for _ in range(rnd.randint(1, 5)):
            own[rnd.randrange(len(own))] = f"n{rnd.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    got = neardup.linked_components(docs_of(rows), 4, 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == _expected(rows, 4, 85)


def test_odd_rows(docs_of):
    text = "a b c d e f g h i j k l m n o p"
    got = neardup.linked_components(docs_of([(3, text), (3, text), (3, "other words than those above, at all"), (None, text), (7, text + " q"), (None, "alone it stands here now")]).withColumn("node", F.lit(1)), 4, 85).collect()
    assert sorted(((r.doc_id or -1), r.n_shingles, (r.component_id or -1)) for r in got) == sorted([(3, 13, 3), (3, 13, 3), (3, 4, 3), (-1, 13, 3), (7, 14, 3), (-1, 2, -1)])
    assert neardup.linked_components(docs_of([(1, "x")]).limit(0)).count() == 0
    assert [r.component_id for r in neardup.linked_components(docs_of([(1, None), (2, "")])).orderBy("doc_id").collect()] == [1, 2]


def _near_copies(seed, n, edits):
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(5000)}" for _ in range(150)]
    rows = []
    for _ in range(n):
        own = list(base)
        for _ in range(rnd.randint(1, edits)):
            own[rnd.randrange(len(own))] = f"n{rnd.randrange(10**6)}"
        rows.append(" ".join(own))
    return rows


@pytest.mark.parametrize("ids", ["own", "null", "same"])
def test_rows_between_stages_grow_with_the_family_not_with_its_pairs(docs_of, monkeypatch, ids):
    """Near copies of which many pairs are just below the threshold: none of the tables written has more rows than a small multiple of them."""
    most = []
    kept = neardup.written

    def counted(frame, what):
        table = kept(frame, what)
        most[-1] = max(most[-1], table.count())
        return table

    monkeypatch.setattr(neardup, "written", counted)
    for n in (150, 300, 600):
        most.append(0)
        texts = _near_copies(3, n, 12)
        rows = [({"own": i, "null": None, "same": 7}[ids], t) for i, t in enumerate(texts)]
        got = neardup.linked_components(docs_of(rows), 4, 85).collect()
        assert len(got) == n
        if ids == "own" and n == 150:
            assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == _expected(rows, 4, 85)
    assert most[2] <= 2.2 * most[1] and most[1] <= 2.2 * most[0] and most[2] <= 8 * 600


def test_rows_stay_linear_with_a_common_passage_and_no_sketch(docs_of, monkeypatch):
    """What a saturated sketch leads to: it tells nothing apart, and a passage that all documents share comes like any other."""
    monkeypatch.setattr(neardup, "CELL", 64)
    monkeypatch.setattr(neardup, "rarity", lambda docs, k: np.zeros(1 << 20, np.uint8))
    rows, kept = [], neardup.written

    def counted(frame, what):
        table = kept(frame, what)
        rows[-1] = max(rows[-1], table.count()) if what != "rows" else rows[-1]
        return table

    monkeypatch.setattr(neardup, "written", counted)
    passage = " ".join(f"p{i}" for i in range(90))
    for n in (300, 600):
        rnd = random.Random(n)
        rows.append(0)
        texts = [(i, " ".join(f"o{rnd.randrange(10**7)}" for _ in range(200)) + " " + passage) for i in range(n)] + [(9000 + i, " ".join(f"c{j}" for j in range(150 + i))) for i in range(3)]
        got = neardup.linked_components(docs_of(texts), 4, 85).collect()
        assert sorted((r.doc_id, r.component_id) for r in got) == [(i, i) for i in range(n)] + [(9000 + i, 9000) for i in range(3)]
    assert rows[1] <= 2.2 * rows[0] and rows[1] <= 4 * 600


def test_the_sketch_grows_with_the_input(docs_of, monkeypatch):
    docs = docs_of([(i, "some words and more words " * 40) for i in range(50)])
    assert neardup.sketch_bits(docs) == neardup._BITS
    monkeypatch.setattr(neardup, "_BITS", 13)
    monkeypatch.setattr(neardup, "MEAN", 1)
    assert neardup.sketch_bits(docs) == 14 == neardup.rarity(docs, 5).size.bit_length() - 1
    assert neardup.sketch_bits(docs.limit(0)) == 13


def test_blocks_of_a_family_meet(docs_of, monkeypatch):
    monkeypatch.setattr(neardup, "CELL", 16)
    rows = list(enumerate(_near_copies(5, 90, 14)))
    got = neardup.linked_components(docs_of(rows), 4, 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == _expected(rows, 4, 85)


def test_labels_join_like_union_find():
    rnd = np.random.default_rng(1)
    for n in (1, 5, 60):
        labels = np.arange(n)
        for _ in range(4):
            x, y = rnd.integers(0, n, (2, n // 3))
            labels = neardup.joined(labels, x, y)
            assert (labels[x] == labels[y]).all() and (labels <= np.arange(n)).all() and (labels[labels] == labels).all()


def test_trees_find_every_pair_that_may_link():
    rnd = np.random.default_rng(5)
    sets = [np.unique(rnd.choice(2**62, 40).astype(np.uint64)) for _ in range(30)]
    sets += [np.unique(np.concatenate([s[: rnd.integers(30, 41)], rnd.choice(2**62, 3).astype(np.uint64)])) for s in sets for _ in range(6)]
    n = len(sets)
    sizes, bitmaps = np.array([len(s) for s in sets]), neardup.Bitmaps(pa.array([neardup.bitmap(s) for s in sets], pa.binary()))
    group = neardup.Group(np.arange(n), np.arange(n), sizes, bitmaps)
    seen = {tuple(sorted(p)) for a, b in neardup.meetings(group, group, 80) for p in zip(a.tolist(), b.tolist(), strict=True)}
    p, q = np.triu_indices(n, 1)
    may = neardup._may_link(p, q, sizes, bitmaps, 80)
    assert seen == set(zip(p[may].tolist(), q[may].tolist(), strict=True))
    linked = {(i, j) for i in range(n) for j in range(i + 1, n) if 100 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - c)}
    assert linked and linked <= seen and len(seen) < 4 * len(linked)
