import random

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import language

_PARTS = {"a": ["the", "ing", "tion", "and", "er"], "b": ["der", "ung", "sch", "keit", "ü"], "c": ["ción", "el", "mente", "ñ", "que"]}


def _rows(n=240):
    rnd, rows = random.Random(8), []
    for i in range(n):
        lang = "abc"[i % 3]
        rows.append((i, " ".join("".join(rnd.choice(_PARTS[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(3, 60))), "s", lang))
    return rows


def test_held_out_accuracy_and_edges(spark, docs_of, stored):
    odd = [(900, None, "s", "a"), (901, "", "s", None), (902, "12 -- !", None, "b"), (None, "the and tion", "s", None), (904, "der ung " * 30000, "s", None), (905, "語", "s", None)]
    docs = docs_of(_rows() + odd + [_rows()[0]])
    got = language.op10_hyperdimensional_language(spark, stored(documents=docs.withColumn("score", F.lit("x")))).collect()
    assert len(got) == 240 + len(odd) + 1
    by = {r.doc_id: r for r in got}
    tried = [(by[i].lang_pred, lang) for i, _, _, lang in _rows() if by[i].held_out]
    assert len(tried) > 40 and np.mean([a == b for a, b in tried]) > 0.97
    assert [by[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and by[900].score == 0.0
    assert by[None].lang_pred == "a" and by[904].lang_pred == "b" and by[905].lang_pred in "abc"
    assert all(0 <= r.score <= 1 for r in got)


def test_held_out_labels_do_not_matter(docs_of):
    docs = docs_of(_rows())
    changed = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    learn = lambda d: language.learn(d.where(~language.held_out(F.col("doc_id"))).select("text", "lang"))
    one, two = learn(docs), learn(changed.repartition(7))
    assert one.keys() == two.keys() == {"a", "b", "c"} and all((one[k] == two[k]).all() for k in one)


def test_nothing_to_learn(docs_of):
    docs = docs_of([(1, "some text")])
    assert language.predict(docs, language.learn(docs.limit(0))).first().lang_pred == "und"
    assert language.predict(docs.limit(0), {}).count() == 0


def test_bundles_are_sums_of_bound_letters():
    letters = language._letters()

    def vector(c):
        number = letters.numbers(np.array([ord(c)], np.uint32))[0]
        return letters.vectors[number].astype(int)

    for text in ("Añb", "x", "one, Two  3 três"):
        codes = [vector(c) for c in f" {text.lower()} "]
        want = sum(np.roll(codes[i - 1], 2) * np.roll(codes[i], 1) * codes[i + 1] for i in range(1, len(codes) - 1) if f" {text.lower()} "[i].isalpha())
        assert (language.bundles([text], np.zeros(1, int), 1)[0] == want).all()


def test_long_texts_in_pieces_equal_whole_ones(monkeypatch):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("abcdeÄ語、 \nΣ") for _ in range(n)) for n in (0, 1, 2, 700, 3000, 40)] + [None]
    of = np.array([0, 1, 2, 3, 3, 0, 1])
    whole = language.bundles(texts, of, 4)
    monkeypatch.setattr(language, "BLOCK", 37)
    monkeypatch.setattr(language, "TRIGRAMS", 5)
    assert (language.bundles(texts, of, 4) == whole).all() and whole[3].any()


def test_learn_and_predict_equal_brute_force(docs_of):
    rows = _rows(90)
    vectors: dict = {}
    letter = lambda c: vectors.setdefault(c, np.random.default_rng([language.SEED, ord(c) if c.isalpha() else 0]).integers(0, 2, language.DIMENSIONS) * 2 - 1)

    def bundled(text):
        t = f" {text.lower()} "
        return sum((np.roll(letter(t[i - 1]), 2) * np.roll(letter(t[i]), 1) * letter(t[i + 1]) for i in range(1, len(t) - 1) if t[i].isalpha()), np.zeros(language.DIMENSIONS))

    sums = {x: sum(bundled(t) for _, t, _, lang in rows if lang == x) for x in "abc"}
    unit = {x: v / np.linalg.norm(v) for x, v in sums.items()}
    shared = sum(unit.values()) / 3
    less = {x: v - (v @ shared) / (shared @ shared) * shared for x, v in unit.items()}
    got = language.predict(docs_of(rows), language.learn(docs_of(rows).select("text", "lang"))).collect()
    for r in got:
        b = bundled(r.text)
        cosines = {x: b @ v / np.linalg.norm(v) / np.linalg.norm(b) for x, v in less.items()}
        best = max(cosines, key=cosines.get)
        assert r.lang_pred == best and abs(r.score - (1 + cosines[best]) / 2) < 1e-5
