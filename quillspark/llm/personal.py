"""Personal data by gradient boosting over candidate spans, with DataFrame functions only.

Four kinds: email, ip, card, phone. The base rules of each kind (a pattern, leftmost and without overlaps, and a check of
what it matched) always stand. Beside them generators with high recall propose spans, which may overlap each other and
the base's: written-out addresses, numbers without a plus sign, cards beside other digits. A candidate has a few small
format and context features. Its label is whether it is a base span or, for a form that the base rules cannot match (a
number without a plus sign, a written-out address), whether evidence of its own speaks for it: an announcing word close
before it, or a way of writing that little else has (see ``_evident``). Spark counts, over all documents, how often each
combination of features occurs and how often with a positive label; boosted trees of two splits are fitted to that table
(its size is bounded by the features' ranges, not by the data) with weights that let rare forms count, and each kind's
threshold is where the monotone calibration of the score on the counts reaches ``CHANCE``. Trees and thresholds become
column expressions. A candidate inside a base span adds nothing. Without a plus sign, an announcement or a usual grouping
a number stays, and so does "me at host.com", which is mostly prose.

Defined results: a null text is an empty one; positions are code points, the end excluded; equal rows get equal spans;
a span that several candidates of a kind propose counts once a candidate, and redaction makes overlapping spans one; very
long texts are searched whole, in time in proportion to their length; nothing is shuffled but the counts; an empty table
gives an empty result; other columns stay."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.tables import held, released, table

KINDS, CHANCE, ROUNDS, RATE = ("email", "ip", "card", "phone"), 0.5, 40, 0.3
_LOCAL, _NAME = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
# Possessive forms of the base patterns, which match the same: a run that fails from its start fails from every later
# character too, unless an earlier match ended there (\G).
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_NAME}++(?:\.{_NAME}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"(?:@|\x20?[(\[{]\x20?at\x20?[)\]}]\x20?|\x20at\x20)", r"(?:\.|\x20?[(\[{]\x20?dot\x20?[)\]}]\x20?|\x20dot\x20)"
PROPOSED = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++{_AT}{_NAME}++(?:{_DOT}{_NAME}++)++",
    "ip": r"(?<![0-9])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20.-][0-9]{4}){3}|[0-9]{4}[\x20.-][0-9]{6}[\x20.-][0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+|00)?(?:\([0-9]{2,4}\)|[0-9]{1,4})(?:[\x20./-]{0,2}(?:\([0-9]{2,4}\)|[0-9]{2,5})){2,5}(?![0-9])",
}
#: What a text must have for a pattern to match at all.
_NEEDS = {"email": r"@|[(\[{\x20]\x20?at[)\]}\x20]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20.-]?[0-9]){12}", "phone": r"\+[0-9]|[0-9](?:[\x20().+/-]{0,4}[0-9]){6}"}
#: Words that announce a kind.
_ANNOUNCE = {"email": r"e-?mail|contact|write|correo|courriel", "ip": r"\bip\b|host|server|address|adresse", "card": r"card|visa|karte|carte|tarjeta|amex", "phone": r"phone|tel|call|fax|mobile|telef|anruf"}
#: Stricter announcements, right before what they announce.
_CLOSE = {"email": r"(?:e-?mail|contact|write|correo|courriel)[^\n.]{0,8}$", "phone": r"(?:phone|\btel\b|\bcall\b|\bfax\b|mobile|telef|anruf)[^0-9]{0,12}$"}
_DATE = r"(?:19|20)[0-9]{2}[-./](?:0[1-9]|1[0-2])[-./]|(?<![0-9])[0-3]?[0-9][-./][01]?[0-9][-./](?:19|20)[0-9]{2}(?![0-9])"
#: Ways to write a number without a plus sign: an area code in parentheses, 00 and a country code, three groups of 3, 3, 4.
_GROUPED = r"^(?:1[\x20.-]?)?\((?:[2-9][0-9]{2}|0[0-9]{1,3})\)[\x20./-]{0,2}[0-9]|^00[1-9][0-9]{0,2}[\x20./(-]|^(?:1[.-])?[2-9][0-9]{2}([.-])[0-9]{3}\1[0-9]{4}$"
_BRACKETED = r"[(\[{]\x20?at\x20?[)\]}].*[A-Za-z]{2}$|@.*[(\[{]\x20?dot\x20?[)\]}]\x20?[A-Za-z]{2,}$"
_ENDING = r"(?:@|\x20at\x20).*(?:\x20dot\x20|[(\[{]\x20?dot\x20?[)\]}]\x20?)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|at|ch|it|nl|us)$"
_PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{0,2})"
FEATURES = ("digits", "separators", "valid", "plus", "before", "after", "announced", "written_out", "usual")
_SPAN = "array<struct<start:int,end:int,m:string>>"


def _matches(text: Column, pattern: str, if_any: Column) -> Column:
    """Spans of all matches: what lies between matches gives their places."""
    matched = F.when(if_any, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    between = F.when(if_any, F.split(text, pattern, -1)).otherwise(F.array(F.lit("")))
    pairs = F.arrays_zip(matched.alias("m"), between.alias("g"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["g"])
        end = begin + F.length(x["m"])
        # the last text between has no match after it
        return F.when(x["m"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["m"].alias("m")))).alias("out")))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit is right; for at most 19 digits."""
    back = F.reverse(digits)
    doubled = lambda i: F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + doubled(i) - F.when(doubled(i) > 9, 9).otherwise(0)) % 10 == 0


def _checks(kind: str, m: Column) -> Column:
    digits = _digits(m)
    if kind == "ip":
        return m.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _right(kind: str):  # noqa: ANN202  functions of columns are told apart by their parameters, so kinds are bound outside
    return lambda x: _checks(kind, x["m"])


def _bare(x: Column) -> Column:
    return F.struct(x["start"], x["end"])


def _with_spans(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with base_<kind> and cand_<kind>, arrays of (start, end, m)."""
    out = docs.withColumn("pd_text", text)
    out = out.withColumns({f"any_{k}": F.col("pd_text").rlike(_NEEDS[k]) for k in KINDS})
    out = out.withColumns({f"raw_{k}": _matches(F.col("pd_text"), BASE[k], F.col(f"any_{k}")) for k in KINDS} | {f"cand_{k}": _matches(F.col("pd_text"), PROPOSED[k], F.col(f"any_{k}")) for k in KINDS})
    return out.withColumns({f"base_{k}": F.filter(f"raw_{k}", _right(k)) for k in KINDS}).drop(*[f"any_{k}" for k in KINDS], *[f"raw_{k}" for k in KINDS])


def _char_class(c: Column) -> Column:
    return F.when(F.length(c) == 0, 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"\p{L}"), 2).when(c.rlike("[0-9]"), 3).otherwise(4)


def _usual(kind: str, m: Column) -> Column:
    """Whether a candidate that no base rule can match is written as little else is."""
    if kind == "email":
        return ~m.rlike(r"^[A-Za-z0-9@._%+-]++$") & m.rlike(f"{_BRACKETED}|{_ENDING}")
    if kind == "phone":
        return ~m.startswith("+") & _checks(kind, m) & m.rlike(_GROUPED) & ~m.rlike(_DATE)
    return F.lit(False)


def _evident(kind: str, text: Column, x: Column) -> Column:
    """Whether something else than the base rule speaks for a candidate that the base rule can never match."""
    m, seen = x["m"], F.lower(F.substring(text, F.greatest(x["start"] - 24, F.lit(0)) + 1, F.least(x["start"], F.lit(24))))
    if kind == "email":
        return _usual(kind, m) | ~m.rlike(r"^[A-Za-z0-9@._%+-]++$") & m.rlike(r"\x20dot\x20[A-Za-z]{2,}$") & seen.rlike(_CLOSE[kind])
    if kind == "phone":
        return _usual(kind, m) | ~m.startswith("+") & _checks(kind, m) & seen.rlike(_CLOSE[kind]) & ~m.rlike(_DATE) & ~_checks("ip", m)
    return F.lit(False)


def _features(kind: str, text: Column, x: Column) -> dict[str, Column]:
    """Small whole numbers about a candidate."""
    m, digits = x["m"], _digits(x["m"])
    seen = F.substring(text, F.greatest(x["start"] - 24, F.lit(0)) + 1, F.least(x["start"], F.lit(24)))
    return {
        "digits": F.least(F.length(digits), F.lit(20)) if kind != "email" else F.lit(0),
        "separators": F.least(F.length(F.regexp_replace(m, r"[^\x20().\[\]{}/-]", "")), F.lit(6)),
        "valid": (_checks(kind, m) if kind != "email" else ~m.rlike(r"[^A-Za-z0-9@._%+-]")).cast("int"),
        "plus": m.startswith("+").cast("int"),
        "before": _char_class(F.substring(text, x["start"], F.least(x["start"], F.lit(1)))),
        "after": _char_class(F.substring(text, x["end"] + 1, F.lit(1))),
        "announced": F.lower(seen).rlike(_ANNOUNCE[kind]).cast("int"),
        "written_out": (m.rlike(r"\b(?:at|dot)\b") & ~m.contains("@")).cast("int"),
        "usual": _usual(kind, m).cast("int"),
    }


@dataclass
class Model:
    """Trees by kind, each (feature, split, feature under it, split, four leaves), and the score from which to redact."""

    trees: dict[str, list[tuple]] = field(default_factory=dict)
    thresholds: dict[str, float] = field(default_factory=dict)

    def score(self, kind: str, f: dict[str, Column] | Column) -> Column:
        total = F.lit(0.0)
        for a, s, b, t, leaves in self.trees[kind]:
            total = total + F.when(f[a] <= s, F.when(f[b] <= t, leaves[0]).otherwise(leaves[1])).otherwise(F.when(f[b] <= t, leaves[2]).otherwise(leaves[3]))
        return total


def _boost(x: np.ndarray, n: np.ndarray, positive: np.ndarray) -> tuple[list[tuple], np.ndarray]:
    """Trees of two splits by second-order gradient boosting on counted rows; the rows' scores. A row weighs as the
    logarithm of its count, so that a rare form is fitted too however large the table."""
    n, positive = np.log1p(n), positive / n * np.log1p(n)
    scores, trees = np.zeros(len(x)), []
    splits = [(j, v) for j in range(x.shape[1]) for v in np.unique(x[:, j])[:-1].tolist()] or [(0, int(x[0, 0]))]
    sides = np.array([x[:, j] <= v for j, v in splits])
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-scores))
        g, h = positive - n * p, n * p * (1 - p) + 1e-9
        best = (-1.0, None)
        for i, first in enumerate(sides):
            parts = [(first & s, first & ~s, ~first & s, ~first & ~s) for s in sides]
            gains = [sum((g[q].sum()) ** 2 / (h[q].sum() + 1.0) for q in own) for own in parts]
            k = int(np.argmax(gains))
            if gains[k] > best[0] + 1e-9:
                best = (gains[k], (i, k, parts[k]))
        i, k, own = best[1]
        leaves = [float(RATE * g[q].sum() / (h[q].sum() + 1.0)) for q in own]
        for q, v in zip(own, leaves, strict=True):
            scores[q] += v
        trees.append((FEATURES[splits[i][0]], splits[i][1], FEATURES[splits[k][0]], splits[k][1], leaves))
    return trees, scores


def _calibrated(scores: np.ndarray, n: np.ndarray, positive: np.ndarray) -> float:
    """The least score at which the monotone fit of the chance reaches CHANCE."""
    blocks: list[list[float]] = []  # [positives, rows, least score], merged until the chance rises with the score
    for i in np.argsort(scores, kind="stable"):
        blocks.append([float(positive[i]), float(n[i]), float(scores[i])])
        while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][2] == blocks[-1][2]):
            p, m, _ = blocks.pop()
            blocks[-1][0] += p
            blocks[-1][1] += m
    return next((s for p, m, s in blocks if p / m >= CHANCE), float("inf"))


def _row(kind: str):  # noqa: ANN202
    def row(x: Column) -> Column:
        counted = [c.cast("int").alias(n) for n, c in _features(kind, F.col("pd_text"), x).items()]
        is_base = F.exists(f"base_{kind}", lambda b: (b["start"] == x["start"]) & (b["end"] == x["end"]))
        return F.struct(F.lit(kind).alias("kind"), *counted, (is_base | _evident(kind, F.col("pd_text"), x)).cast("int").alias("is_positive"))

    return row


def learn(docs: DataFrame) -> Model:
    """A model from all documents: counts of candidates by features, and of those with a positive label."""
    spans = _with_spans(docs.select("text"), F.coalesce(F.col("text"), F.lit("")))
    rows = []
    for k in KINDS:
        rows.append(F.transform(f"cand_{k}", _row(k)))
    counted = spans.select(F.inline(F.concat(*rows))).groupBy("kind", *FEATURES).agg(F.count("*").alias("n"), F.sum("is_positive").alias("positive")).collect()
    model = Model()
    for kind in KINDS:
        own = sorted((tuple(r[f] for f in FEATURES), r["n"], r["positive"]) for r in counted if r["kind"] == kind)
        model.trees[kind], model.thresholds[kind] = [], float("inf")
        if own:
            x, n, positive = np.array([r[0] for r in own]), np.array([r[1] for r in own], float), np.array([r[2] for r in own], float)
            model.trees[kind], scores = _boost(x, n, positive)
            model.thresholds[kind] = _calibrated(scores, n, positive) - 1e-9
    return model


def _wanted(kind: str, model: Model):  # noqa: ANN202
    def wanted(x: Column) -> Column:
        inside = F.exists(f"base_{kind}", lambda b: (b["start"] <= x["start"]) & (x["end"] <= b["end"]))
        # as an array of one, so that features are made once and not for each tree
        features = F.array(F.struct(*[c.alias(n) for n, c in _features(kind, F.col("pd_text"), x).items()]))
        return ~inside & F.exists(features, lambda f: model.score(kind, f) >= model.thresholds[kind])

    return wanted


def find(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with base_<kind> and all_<kind>, arrays of (start, end): what the base finds, and that with what the model adds.

    Columns of these names, or of those in between (raw_, any_, cand_<kind>, pd_text), are replaced; ``held`` keeps them."""
    found = _with_spans(docs.drop("pd_text", *[f"{p}_{k}" for p in ("base", "all", "any", "raw", "cand") for k in KINDS]), F.coalesce(F.col("text"), F.lit("")))
    columns = {}
    for k in KINDS:
        base = F.col(f"base_{k}")
        added = F.array().cast(_SPAN)
        if model.thresholds[k] < float("inf"):
            added = F.filter(f"cand_{k}", _wanted(k, model))
        columns[f"all_{k}"] = F.array_sort(F.transform(F.concat(base, added), _bare))
    return found.withColumns(columns).withColumns({f"base_{k}": F.transform(f"base_{k}", _bare) for k in KINDS}).drop("pd_text", *[f"cand_{k}" for k in KINDS])


def _listed(prefix: str) -> Column:
    named = lambda k: lambda x: F.concat_ws(":", F.lit(k), x["start"].cast("string"), x["end"].cast("string"))
    return F.concat_ws(",", *[F.transform(f"{prefix}_{k}", named(k)) for k in KINDS])


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """``docs``, with all their columns, with each span in ``text`` replaced by its kind in brackets; overlapping spans become one, of the first's kind."""
    found = find(held(docs, "text"), model)
    named = lambda k: lambda x: F.struct(x["start"].alias("s"), x["end"].alias("e"), F.lit(k).alias("k"))
    spans = F.array_sort(F.concat(*[F.transform(f"all_{k}", named(k)) for k in KINDS]))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        before = F.substring(F.col("text"), acc["at"] + 1, x["s"] - acc["at"])
        new = F.concat(acc["out"], F.array(before, F.concat(F.lit("["), F.upper(x["k"]), F.lit("]"))))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] >= acc["at"], new).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate(spans, start, step, lambda acc: F.array_join(F.concat(acc["out"], F.array(F.substring(F.col("text"), acc["at"] + 1, F.length("text")))), ""))
    changed = F.when(F.size(spans) > 0, whole).otherwise(F.col("text"))
    return released(found.withColumn("text", changed), docs, "text")


def op6_candidate_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, learn(docs))
    counts = [F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("all").alias("spans"))
