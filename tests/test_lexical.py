import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import lexical

SCHEMA = "uri string, title string, path string, type string, aliases array<string>, tags array<string>, description string, body string"
QUESTIONS = ["alpha beta", "alpha", "lph", "a", "al", "x y z", "the of", "rare17", "alpha rare3 gamma", "notes page 7", "e no", "Tag One", "nothing here", "", "beta beta beta", "zeta/eta"]


def _pages(spark, n, seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "zeta/eta", "the", "x", "y-z", "été"]
    rows = []
    for i in range(n):
        body = " ".join(rng.choices(words, weights=[40, 20, 10, 5, 3, 30, 2, 1, 1], k=rng.randint(0, 60))) + (f" rare{i % 19}" if i % 3 == 0 else "")
        rows.append((f"kb://v/{i:04}", rng.choice(["Alpha Notes", "Beta the Gamma", f"Page {i}", None]), f"notes/page-{i}.md", rng.choice(["Note", "Idea", None]), rng.choice([["alpha beta"], [], None, ["a", "al"]]), rng.choice([["tag one"], ["beta", "x"], None]), rng.choice(["some alpha", "", None]), rng.choice([body, body, body, None])))
    return spark.createDataFrame(rows, SCHEMA)


def _told(frame):
    return [tuple(r) for r in frame.orderBy(F.desc("class"), F.desc("score"), "uri").collect()]


@pytest.mark.parametrize(("segment", "first", "named"), [(1024, 64, 1000), (8, 2, 1000), (8, 1, 2)])
def test_index_answers_as_the_pages_do(spark, monkeypatch, segment, first, named):
    monkeypatch.setattr(lexical, "SEGMENT", segment)
    monkeypatch.setattr(lexical, "FIRST", first)
    monkeypatch.setattr(lexical, "NAMED", named)
    monkeypatch.setattr(lexical, "BUCKETS", 5)
    pages = _pages(spark, 230, segment)
    index = lexical.build(pages)
    own = pages.persist()
    for question in QUESTIONS[:: 3 if segment == 8 else 2]:
        limit = 3 if len(question) % 2 else 40
        assert _told(lexical.best(index, question, limit)) == _told(lexical.top(lexical.ranked(own, question), limit)), question
    want = own.transform(lambda p: lexical.scores(p, "alpha rare3")).orderBy(F.desc("score"), "uri").limit(7)
    assert [(r.uri, r.score) for r in lexical.best(index, "alpha rare3", 7, by_class=False).collect()] == [(r.uri, r.score) for r in want.collect()]


def test_a_question_reads_its_buckets_and_segments_only(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SEGMENT", 8)
    monkeypatch.setattr(lexical, "FIRST", 2)
    pages = _pages(spark, 230, 1)
    index = lexical.build(pages)
    plan = lexical.best(index, "rare3 alpha", 3, by_class=False)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "In(term, [" in plan and "In(segment, [" in plan
    named = plan.split("In(segment, [")[1].split("]")[0].split(",")
    assert 0 < len(named) < index.segments / 2


def test_scopes_are_corpora_of_their_own(spark):
    pages = _pages(spark, 120, 2).withColumn("own", F.when(F.substring("uri", -1, 1) < "3", "few").otherwise("many"))
    index = lexical.build(pages.drop("own"), F.when(F.substring("uri", -1, 1) < "3", "few").otherwise("many"))
    for scope in ("few", "many", "none"):
        want = lexical.top(lexical.ranked(pages.where(F.col("own") == scope), "alpha gamma"), 5)
        assert _told(lexical.best(index, "alpha gamma", 5, scope)) == _told(want)


def test_an_empty_corpus_answers_nothing(spark):
    index = lexical.build(_pages(spark, 1, 0).limit(0))
    assert lexical.best(index, "alpha", 5).collect() == [] and lexical.search(index, "", 5).collect() == []
