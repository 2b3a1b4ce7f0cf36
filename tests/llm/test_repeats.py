import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np

from quillspark.llm import repeats


def slow_runs(words):
    """Every lag by itself; a stretch counts with its smallest period."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if length >= max(6, 4 * q):
                found.setdefault((start, length), q)
            i = j
    return sorted((s, m, q) for (s, m), q in found.items())


def collapsed(words, runs):
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def _random_texts(rng):
    for _ in range(400):
        words = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            unit = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))]
            words += (unit * 7)[: rng.randint(1, 7 * len(unit))] + [rng.choice("abxyz")] * rng.randint(0, 2)
        yield words
    yield ["a"] * 3000
    yield ["a", "b"] * 700 + ["a"] * 50
    yield [str(i % 97) for i in range(1000)]


def test_runs_against_brute_force():
    texts = list(_random_texts(random.Random(5)))
    flat = [w for t in texts for w in t]
    number = {w: i for i, w in enumerate(sorted(set(flat)))}
    first = np.cumsum([0, *map(len, texts)])
    got = [[] for _ in texts]
    for k, s, m, q in zip(*repeats.maximal_runs(np.array([number[w] for w in flat]), first), strict=True):
        got[k].append((s, m, q))
    assert got == [slow_runs(t) for t in texts]
    assert sum(map(len, got)) > 300


def test_a_long_text_of_one_word_is_linear():
    n = 1 << 20
    found = repeats.maximal_runs(np.zeros(n, np.int64), np.array([0, n]))
    assert [x.tolist() for x in found] == [[0], [0], [n], [1]]
    two = np.random.default_rng(3).integers(0, 2, 1 << 18)
    text, start, length, period = repeats.maximal_runs(two, np.array([0, len(two)]))
    assert len(text) > 1000
    for s, m, q in list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True))[::50]:
        part = two[s : s + m]
        assert (part[q:] == part[:-q]).all() and (s == 0 or two[s - 1] != two[s - 1 + q]) and (s + m == len(two) or two[s + m] != two[s + m - q])


def test_operator_on_odd_rows(docs_of):
    odd = "  go\tgo\ngo go\x0bgo go \x1c  x"
    rows = [(1, None), (2, ""), (3, " \n "), (4, odd), (4, odd), (None, "a b " * 9), (5, "w " * 70000)]
    docs = docs_of(rows).selectExpr("*", "1 AS runs", "'x' AS collapsed", "2 AS n_words", "3 AS best")
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in repeats.periodic_runs(docs).collect()), key=str)
    # 0x1C and the no-break space are no white space here
    four = (4, 8, [(0, 6, 1)], "go \x1c  x")
    want = [(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), four, four, (None, 18, [(0, 18, 2)], "a b"), (5, 70000, [(0, 70000, 1)], "w")]
    assert got == sorted(want, key=str)
    assert repeats.periodic_runs(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark, stored):
    rng = random.Random(9)
    rows = [(i, " \t".join(rng.choice(["ab", "c", "d", "e"]) for _ in range(rng.randint(0, 60))) if i % 17 else None) for i in range(400)] + [(None, "q " * 8)]
    path = stored(documents=spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r for r in repeats.op11_periodic_runs(spark, path).collect()}
    assert len(got) == len(rows)
    seen = 0
    for doc_id, text in rows:
        words = (text or "").split()
        n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            seen += 1
        runs = slow_runs(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        r = got[doc_id]
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert seen > 20
