import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import mixing, tables


@pytest.fixture(scope="module")
def corpus():
    rnd, rows, labels = random.Random(21), [], []
    for i in range(400):
        words = ["".join(rnd.choice(["th", "er", "on", "ble", "ing"]) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(30, 120))]
        kind = i % 8
        if kind == 0:
            words = [w + "###" for w in words]
        if kind == 1:
            words[3] = words[9] = "slur"
        if kind == 2:
            words.insert(5, f"me{i}@mail.example.com")
        rows.append((i, " ".join(words), f"src{i % 3}", "en"))
        labels.append((i, int(kind > 0), int(kind == 1)))
    copies = [(1000 + i, rows[i * 8 + 3][1] + " end", "src0", "en") for i in range(20)]
    return rows + copies + [(2000, None, None, None), (2001, "", "src1", "en")], labels


def test_stages(spark, corpus, stored):
    rows, labels = corpus
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("n_chars", F.length("text").cast("long"))
    sf_dir = stored(documents=docs, labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    kept = docs
    results = []
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, sf_dir).cache()
        results.append({r.doc_id for r in kept.select("doc_id").collect()})
        if len(results) < 5:
            assert kept.columns == docs.columns
        if len(results) == 3:
            texts = {r.doc_id: (r.text, r.n_chars) for r in kept.collect()}
        if len(results) == 4:
            taken = Counter(r.doc_id for r in kept.collect())
    clean = {r[0] for r in rows if r[0] < 1000 and r[0] % 8 > 1}
    assert len(clean - results[0]) <= 2 and not results[0] & {r[0] for r in rows if r[0] < 1000 and r[0] % 8 == 0}
    assert results[1] == results[0] - {1000 + i for i in range(20) if i * 8 + 3 in results[0]}
    assert results[2] == results[1]
    assert all("@" not in (t or "") and n == (len(t) if t is not None else None) for t, n in texts.values()) and "[EMAIL]" in texts[2][0]
    assert set(taken) == results[3] <= results[2] and max(taken.values()) <= 3
    pieces = defaultdict(int)
    for r in kept.collect():
        pieces[r.doc_id] += 1
    assert all(pieces[i] >= n for i, n in taken.items()) and results[4] == results[3]


def test_run_and_odd_tables(spark, stored):
    docs = spark.createDataFrame([(1, "a b c d e f", "s", "en", 11, 7)] * 2 + [(None, "x y", None, None, None, 1), (3, None, "s", "en", None, 1), (None, "z", None, None, None, 1)], "doc_id long, text string, source string, lang string, n_chars long, size int")
    sf_dir = stored(documents=docs, labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    got = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "sequence_id", "offset"} <= set(got.columns)
    # of 9 words 3 are the target of "s" (rate 0.5, each document at most once) and 6 that of the null source (twice each)
    taken = Counter((r.doc_id is None) for r in got.collect())
    assert taken[True] == 4 and taken[False] <= 2
    assert corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).count() == 4
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf_dir)
        assert empty.count() == 0


#: Names that the stages use inside, or might.
_CLASHING = """g_row g_key row hash node comp component cluster first again rows w_node n rep pd_text cand_email base_ip any_ip raw_phone
all_card mix_source size source_size rate target copies copy keep tail_probability expected_grade others c0 c1 length piece start
offset sequence_id salt a.b x:y""".split()


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_columns_of_any_name(spark, stored, k):
    rows = [(i, f"w{i % 5} a b c d e f g me{i}@x.example.org", "s" if i % 2 else None, "en") for i in range(12)] + [(3, None, "s", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    sf_dir = stored(labels=spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int"))
    names = _CLASHING + (["n_chars"] if k == 2 else [])
    more = docs.select("*", *[F.concat(F.lit(f"{n}-"), F.col("lang")).alias(n) if n != "n_chars" else F.lit(7).alias(n) for n in names])
    stage = corpus_pipeline.STAGES[k][1]
    got, plain = stage(spark, more, sf_dir), stage(spark, docs, sf_dir)
    assert got.columns == more.columns
    told = got.collect()
    assert Counter((r.doc_id, r.text) for r in told) == Counter((r.doc_id, r.text) for r in plain.collect())
    assert all(r[n] == f"{n}-en" for r in told for n in names if n != "n_chars")


def test_packing_ignores_columns_of_any_name(spark, stored):
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(9)], "doc_id long, text string")
    more = docs.select("*", *[F.lit("x").alias(n) for n in _CLASHING])
    stage = corpus_pipeline.STAGES[4][1]
    told = lambda frame: sorted(tuple(r)[:5] for r in stage(spark, frame, stored()).collect())
    assert told(more) == told(docs)


def test_settings_of_the_session_stay(spark, stored):
    before = {k: spark.conf.get(k, None) for k in tables.BATCH}
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert corpus_pipeline.drop_near_duplicates(spark, docs, stored()).count() == 1
    assert {k: spark.conf.get(k, None) for k in tables.BATCH} == before


def _shingles(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(found[i : i + 5]) for i in range(len(found) - 4)} if len(found) >= 5 else {tuple(found)} if found else set()


def test_near_duplicates_equal_brute_force(spark, stored):
    """One document of each component of links at five words and 0.8, by all pairs; null and repeated ids too."""
    rnd, rows = random.Random(4), []
    for i in range(60):
        base = [f"w{rnd.randrange(400)}" for _ in range(rnd.randint(1, 60))]
        for _ in range(rnd.randint(1, 4)):
            own = list(base)
            for _ in range(rnd.randint(0, 3)):
                own[rnd.randrange(len(own))] = f"n{rnd.randrange(99)}"
            rows.append((rnd.choice([None, rnd.randrange(150), 1000 + len(rows)]), " ".join(own), "s", "en"))
    rows += [(5000, None, "s", "en"), (5001, "", "s", "en"), (None, " ", "s", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, stored()).collect())
    sets, group = [_shingles(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    kept = [got_ for got_ in got.elements()]
    wordless = [(r[0], r[1]) for r, s in zip(rows, sets, strict=True) if not s]
    assert sorted(map(str, (k for k in kept if not _shingles(k[1])))) == sorted(map(str, wordless))
    by_group = defaultdict(list)
    for r, g, s in zip(rows, group, sets, strict=True):
        if s:
            by_group[g].append((r[0], r[1]))
    chosen = [k for k in kept if _shingles(k[1])]
    assert len(chosen) == len(by_group)
    for members in by_group.values():
        own = [k for k in chosen if k in members]
        ids = [m[0] for m in members if m[0] is not None]
        assert any(k[0] == (min(ids) if ids else None) for k in own)


def test_mix_equals_brute_force_and_keeps_null_ids(spark, stored):
    """Copies by the formula, with the draw made anew by hashlib; null ids are taken as others are."""
    rows = [(i, f"w{i} " * (i % 9), ["a", "b", None][i % 3], "en") for i in range(300)] + [(None, f"v{i} x", "c", "en") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = Counter((r.doc_id, r.text, r.source) for r in corpus_pipeline.mix_sources(spark, docs, stored()).collect())
    targets = {(r.source): r.target / r.source_size for r in mixing.mixed(docs).select("source", "target", "source_size").distinct().collect() if r.source_size}
    digest = lambda x: hashlib.md5(x.encode()).hexdigest()
    for doc_id, text, source, _ in rows:
        key = ":".join(["-" if doc_id is None else str(doc_id), "-" if source is None else digest(source), digest(text)])
        rate = targets[source]
        assert got[doc_id, text, source] == int(rate) + (int(digest(key)[:8], 16) / 2**32 < rate - int(rate))
    assert sum(n for (doc_id, *_), n in got.items() if doc_id is None) > 100


def test_redaction_equals_brute_force(spark, stored):
    """Texts with base spans only: what the four patterns find is replaced, leftmost kinds first, and nothing else."""
    rows = [(i, f"mail a{i}@b.example.org, host 10.1.{i}.7 or +1 (555) 010-{1000 + i} / 4111111111111111 end", "s", "en") for i in range(120)] + [(900, None, "s", "en"), (901, "plain", "s", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("n_chars", F.length("text").cast("long"))
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.redact_personal_data(spark, docs, stored()).collect()}
    for i, text, *_ in rows:
        want = text
        for pattern, kind in ((r"[a-z0-9]+@[a-z.]+(?=,)", "EMAIL"), (r"10(\.\d+){3}", "IP"), (r"\+1 \(555\) 010-\d+", "PHONE"), (r"4111111111111111", "CARD")):
            want = want if want is None else re.sub(pattern, f"[{kind}]", want)
        assert got[i] == (want, None if want is None else len(want))
