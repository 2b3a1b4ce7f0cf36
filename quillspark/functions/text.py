"""Text functions for lexical ranking, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that ranking leaves out.
STOP_WORDS = (
    "a", "about", "all", "an", "and", "are", "as", "at", "be", "by", "do", "does", "every", "find", "for", "from",
    "give", "how", "i", "in", "is", "it", "list", "me", "of", "on", "or", "pages", "show", "that", "the", "this", "to",
    "was", "what", "when", "where", "which", "who", "why", "with",
)


def _stop() -> Column:
    return F.array(*[F.lit(w) for w in STOP_WORDS])


def keep_words(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS))


def tokens(value: Column, drop_stop_words: bool = True) -> Column:
    """Lower-cased runs of letters, numbers and ``-_/.``, trimmed of these four; compounds are followed by their parts."""
    runs = F.split(F.lower(F.coalesce(value, F.lit(""))), r"[^\p{L}\p{N}_/.\-]+")
    whole = F.filter(F.transform(runs, lambda t: F.btrim(t, F.lit("-_/."))), lambda t: t != "")
    parts = lambda t: F.filter(F.split(t, "[-_/.]"), lambda p: p != "")
    made = F.flatten(F.transform(whole, lambda t: F.when(F.translate(t, "-_/.", "") != t, F.concat(F.array(t), parts(t))).otherwise(F.array(t))))
    return keep_words(made) if drop_stop_words else made


def token_counts(value: Column, wanted: list[str]) -> Column:
    """(len, tf): how many ``tokens`` a value has, and how often each wanted one is among them, without making them.

    Tokens are the runs of letters and numbers that are no stop words, and the compounds that such runs make up."""
    lower = F.lower(F.coalesce(value, F.lit("")))
    words = F.filter(F.split(lower, r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.isin(*STOP_WORDS))
    compounds = F.regexp_extract_all(lower, F.lit(r"[\p{L}\p{N}]+(?:[-_/.]+[\p{L}\p{N}]+)+"), F.lit(0))

    def met(found: Column) -> Column:
        return F.filter(found, lambda t: t.isin(*wanted)) if wanted else F.array().cast("array<string>")

    def times(found: Column, q: str) -> Column:
        return F.size(F.filter(found, lambda t: t == q))

    def told(both: Column) -> Column:
        hits = F.concat(met(both["words"]), met(both["compounds"]))
        tf = F.transform(F.array(hits), lambda h: F.array(*[times(h, q) for q in wanted]).cast("array<int>"))
        return F.struct((F.size(both["words"]) + F.size(both["compounds"])).alias("len"), F.element_at(tf, 1).alias("tf"))

    # the lambdas bind what is found, so that each is made once
    return F.element_at(F.transform(F.array(F.struct(words.alias("words"), compounds.alias("compounds"))), told), 1)


def query_tokens(value: Column) -> Column:
    """Distinct tokens of a query, in order; where all are stop words, they count after all."""
    kept = F.array_distinct(tokens(value))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array_distinct(tokens(value, drop_stop_words=False)))


def canonical(value: Column) -> Column:
    """Lower-cased words without stop words (unless all are), joined by one blank."""
    words = F.filter(F.split(F.lower(F.coalesce(value, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    kept = keep_words(words)
    return F.array_join(F.when(F.size(kept) > 0, kept).otherwise(words), " ")


def identity(value: Column) -> Column:
    """Lower case, with one blank for each run of anything but letters and digits."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"[^\p{L}\p{Nd}]+", " "))


def cut(value: Column, limit: int) -> Column:
    """White space made single, at most ``limit`` code points; a cut ends in an ellipsis."""
    flat = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.trim(F.substring(flat, 1, limit - 1)), F.lit("…")) if limit > 1 else F.lit("…"))


def rounded(score: Column) -> Column:
    """Two decimals, halves away from zero, of the product with 100 as it is in binary."""
    return F.round(score * 100, 0) / 100


def match_class(query: Column, title: Column, aliases: Column, path: Column, tags: Column) -> Column:
    """3 exact (title, alias, or path in three forms), 2 phrase inside one of these, 1 exact tag, 0 none."""
    q = canonical(query)
    no_ext = F.regexp_replace(path, r"\.[^./]*$", "")
    names = F.concat(F.array(title), F.coalesce(aliases, F.array().cast("array<string>")))
    exact = F.concat(names, F.array(path, no_ext, F.substring_index(no_ext, "/", -1)))
    same = lambda v: (canonical(v) == q)
    return (
        F.when(q == "", 0)
        .when(F.exists(exact, same), 3)
        .when(F.exists(F.concat(names, F.array(path)), lambda v: F.contains(canonical(v), q)), 2)
        .when(F.exists(F.coalesce(tags, F.array().cast("array<string>")), same), 1)
        .otherwise(0)
    )


# The forms of questions after paths, and the markers of gap and list questions.
_PATH_FORMS = (
    (r"^\s*how (?:is|are) (.+?) (?:connected|related|linked) to (.+?)\??\s*$"),
    (r"^\s*how does (.+?) relate to (.+?)\??\s*$"),
    (r"^\s*trace (?:the )?(?:chain|path) from (.+?) to (.+?)\??\s*$"),
    (r"^\s*what connects (.+?) (?:to|and) (.+?)\??\s*$"),
)
_GAPS = ("what don't i know", "what do i not know", "what is missing", "what's missing", "what gaps", "open questions")
_LISTS = ("list all", "show all", "find all", "give me all", "pages about")


def question_class(question: str) -> tuple[str, tuple[str, ...]]:
    """path (with both ends), gap, list or direct. A question is one constant, so this runs on the driver."""
    for form in _PATH_FORMS:
        if m := re.match(form, question, re.I):
            return "path", tuple(x.strip() for x in m.groups())
    lower = question.lower()
    if any(m in lower for m in _GAPS):
        return "gap", ()
    return ("list" if lower.strip().startswith(_LISTS) else "direct"), ()


def question_terms(question: str) -> list[str]:
    """Distinct words of three characters or more, trimmed of anything but letters and numbers."""
    words = (re.sub(r"^[\W_]+|[\W_]+$", "", w) for w in question.lower().split())
    return list(dict.fromkeys(w for w in words if len(w) >= 3))


def occurrences(value: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a term."""
    return F.when(F.length(term) > 0, F.floor((F.length(value) - F.length(F.replace(value, term, F.lit("")))) / F.length(term))).otherwise(0)


def lifecycle(before_status: Column, after_status: Column, before_next: Column, after_next: Column) -> Column:
    """archived where the status has become archived or retired, superseded by a new successor, else updated."""
    changed = ~before_status.eqNullSafe(after_status)
    return F.when(changed & after_status.isin("archived", "retired"), "archived").when(after_next.isNotNull() & ~before_next.eqNullSafe(after_next), "superseded").otherwise("updated")
