import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.llm import personal

_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _right(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        values = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(v - 9 * (v > 9) for v in values) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def _base(text):
    return [(k, m.start(), m.end()) for k, p in _PATTERNS.items() for m in re.finditer(p, text) if _right(k, m[0])]


_PARTS = ["a.b@c.de", "x@y", "@", "q_w@a-b.c.d_e@f.gh", "1.2.3.4", "256.1.1.1", "00255.0.0.1", "1.2.3.4.5.6.7.8", "4111111111111111", "4111-1111 1111 1111", "4111111111111112", "+1 (743) 555-3824", "+12", "+1.", "555-3824", "(743) 555-3824", "é𝄞", " ", "\n", ",", "me (at) host dot com", "%", "- ", "5500 0000 0000 0004", "9", "+49 30 1234567 4111111111111111"]


def test_base_spans_equal_brute_force(docs_of):
    rnd = random.Random(3)
    rows = [(i, "".join(rnd.choice(_PARTS) + rnd.choice(["", " ", " "]) for _ in range(rnd.randint(0, 14)))) for i in range(700)]
    rows += [(1000, None), (1001, ""), (1002, "1" * 60000), (1003, "a." * 30000 + "@"), (1004, "+1 " * 20000), (1005, "a@b.c " * 1500)]
    docs = docs_of(rows).withColumn("base_ip", F.lit("mine"))
    got = {r.doc_id: r for r in personal.find(docs, personal.learn(docs)).collect()}
    for i, text in rows:
        want = _base(text or "")
        assert [(k, x.start, x.end) for k in personal.KINDS for x in got[i][f"base_{k}"]] == want, text
        both = {(k, x.start, x.end) for k in personal.KINDS for x in got[i][f"all_{k}"]}
        assert set(want) <= both


def test_digest_columns_and_added_spans(spark, docs_of, stored):
    rnd = random.Random(5)
    rows = [(i, f"word {rnd.choice('abc')}{i}@mail.example.com then +1 (5{i % 90 + 10}) 555-3824 and 4111111111111111 from 10.0.{i % 200}.1 on") for i in range(300)]
    rows += [(900, "+1 (269) 555-3296 4111111111111111 and"), (901, "nothing here 12 34")]
    got = {r.doc_id: r for r in personal.op6_candidate_boosting(spark, stored(documents=docs_of(rows))).collect()}
    for i, text in rows:
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in _base(text))
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(got[i].spans.split(","))
    # the card beside a phone number: no base span of its kind, but it looks like the others
    assert got[900].n_card == 0 and "card:18:34" in got[900].spans
    assert got[901].spans == "" and got[901].n_email == 0


def test_forms_that_no_base_rule_matches(docs_of):
    rnd = random.Random(7)
    plain = lambda n: n + _right("card", str(n))  # noqa: E731  no card
    rows = [(i, f"w {rnd.choice('abc')}{i}@mail.example.com or +1 (5{i % 90 + 10}) 555-3824, id {plain(10**15 + i * 7919)}, {10**9 + i} of 2024-01-{i % 28 + 1:02} 10.20.{i % 200}.130 at {i}.com") for i in range(300)]
    added = ["(555) 123-4567", "0049 30 1234567", "me (at) host dot com", "jo[at]host.org", "joe at host dot com", "555-123-4567"]
    rows += [(1000 + i, f"so {x}, then") for i, x in enumerate(added)]
    rows += [(2000, "please call 5551234567 now"), (2001, "look at polka dot dresses"), (2002, "vol. 12 (2019) 345-678"), (2003, "meet me at host.com"), (2004, "call 2024-01-15 10")]
    docs = docs_of(rows)
    got = {r.doc_id: r.text for r in personal.redact(docs, personal.learn(docs)).collect()}
    assert [got[1000 + i] for i in range(6)] == [f"so [{k}], then" for k in ("PHONE", "PHONE", "EMAIL", "EMAIL", "EMAIL", "PHONE")]
    assert got[2000] == "please call [PHONE] now"
    assert [got[i] for i, _ in rows[-4:]] == [t for _, t in rows[-4:]]
    for i, text in rows[:300]:
        assert got[i].endswith(text[text.index(", id") :].replace(f"10.20.{i % 200}.130", "[IP]")), text


def test_redaction(docs_of):
    docs = docs_of([(1, "é a@b.cd, 1.2.3.4 x"), (2, None), (3, "clean"), (3, "clean"), (4, "+1 (743) 555-3824")])
    got = [(r.doc_id, r.text) for r in personal.redact(docs, personal.learn(docs)).orderBy("doc_id").collect()]
    assert got == [(1, "é [EMAIL], [IP] x"), (2, None), (3, "clean"), (3, "clean"), (4, "[PHONE]")]
    assert personal.redact(docs.limit(0), personal.learn(docs.limit(0))).count() == 0


@pytest.mark.parametrize("kind", personal.KINDS)
def test_patterns_end_on_long_runs(docs_of, kind):
    found = personal.find(docs_of([(1, {"email": "a" * 100000, "ip": "1." * 50000, "card": "1 " * 50000, "phone": "+" * 100000}[kind])]), personal.Model({}, dict.fromkeys(personal.KINDS, float("inf"))))
    assert found.count() == 1
