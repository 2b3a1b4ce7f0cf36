import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.llm import fingerprints


def _expected(rows):
    """(doc_id, n_chars, sha256 of the edited text) by brute force."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda x: -x[0])
    out = {}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        m = len(t) // 3
        out[i] = (len(t), hashlib.sha256((t[: len(t) - m] + after[:m]).encode()).hexdigest())
    return out


def test_edits_follow_descending_ids(spark, docs_of):
    rnd = random.Random(3)
    rows = [(i * 7 % 501, " ".join(rnd.choice(["añb", "x", "𝄞y", "lorem"]) for _ in range(rnd.randint(0, 90)))) for i in range(300)]
    rows += [(9001, None), (9002, ""), (9003, "word " * 30000)]
    got = {r.doc_id: (r.n_chars, r.edited_sha256) for r in fingerprints.with_edits(docs_of(rows)).collect()}
    assert got == _expected(rows)


def test_edge_cases(spark, docs_of):
    one = fingerprints.with_edits(docs_of([(5, "a b c d e f g h i")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprints.with_edits(docs_of([(1, "x")]).limit(0)).count() == 0
    twins = fingerprints.with_edits(docs_of([(1, "same text here"), (1, "same text here"), (2, None), (3, "  \n")])).collect()
    assert len(twins) == 4
    by = {r.doc_id: r for r in twins}
    assert by[2].fingerprint == by[3].fingerprint != by[1].fingerprint
    assert by[3].near_next == 1.0 and by[2].near_next == 0.0
    nameless = docs_of([(1, "a b c")]).union(docs_of([(2, "d e f")])).withColumn("doc_id", F.when(F.col("doc_id") == 2, F.col("doc_id")))
    assert {r.doc_id for r in fingerprints.with_edits(nameless).collect()} == {None, 2}
    wide = fingerprints.fingerprint(docs_of([(1, "a b c"), (2, None)]).withColumn("fingerprint", F.lit(1)))
    assert wide.columns == ["doc_id", "text", "source", "lang", "fingerprint"] and wide.count() == 2


def test_collisions_equal_generalised_jaccard():
    rnd, errors = random.Random(1), []
    for _ in range(120):
        vocabulary = [f"w{i}" for i in range(rnd.choice([5, 40, 2000]))]
        a = [rnd.choice(vocabulary) for _ in range(rnd.randint(6, 300))]
        b = a[: rnd.randint(0, len(a))] + [rnd.choice(vocabulary) for _ in range(rnd.randint(1, 200))]
        times = rnd.choice([1, 1, 7])
        a, b = a * times, b * times
        x, y = (Counter(tuple(s[i : i + 5]) for i in range(max(len(s) - 4, 1))) for s in (a, b))
        exact = (x & y).total() / (x | y).total()
        made = fingerprints.sketch(pa.array([" ".join(a), " ".join(b)]))
        errors.append(fingerprints.likeness(made[:1], made[1:])[0] - exact)
    assert abs(np.mean(errors)) < 0.02 and np.sqrt(np.mean(np.square(errors))) < 0.08
