"""Pages of results with cursors that are bound to what they were taken from, and guards on sizes.

A cursor is base64url JSON. It carries the kind of listing, a digest of the snapshot and of the request, and a position.
A cursor of another kind, snapshot or request is refused, so that a client never mixes pages of two states. Sorting is
global and distributed; only one page and one count come to the driver."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.ranks import Listing


class InvalidCursor(ValueError):
    """The cursor cannot be read, or belongs to another listing, snapshot or request."""


def encode(value: dict) -> str:
    return base64.urlsafe_b64encode(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).decode().rstrip("=")


def decode(cursor: str, fields: set[str]) -> dict:
    """The cursor's content; it has exactly these fields, and nothing after it."""
    try:
        found = json.loads(base64.b64decode(cursor + "=" * (-len(cursor) % 4), altchars=b"-_", validate=True))
    except (binascii.Error, ValueError) as e:
        raise InvalidCursor(cursor) from e
    if not isinstance(found, dict) or set(found) != fields:
        raise InvalidCursor(cursor)
    return found


def request_digest(request: dict) -> str:
    return f"sha256:{hashlib.sha256(json.dumps(request, sort_keys=True).encode()).hexdigest()}"


def by_offset(rows: DataFrame | Listing, order: list[str | Column], kind: str, snapshot: str, request: dict, limit: int, cursor: str | None = None) -> tuple[DataFrame, str | None]:
    """A page of ``rows`` in order, and the next page's cursor, null at the end.

    A ``Listing`` has its order already: where several pages are taken, store the rows once and a page reads its own ranges only."""
    asked, offset = request_digest(request), 0
    if cursor is not None:
        at = decode(cursor, {"version", "kind", "snapshot", "request", "offset"})
        if (at["version"], at["kind"], at["snapshot"], at["request"]) != (1, kind, snapshot, asked) or not isinstance(at["offset"], int):
            raise InvalidCursor(cursor)
        offset = at["offset"]
    stored = isinstance(rows, Listing)
    total = rows.total if stored else rows.count()
    if not 0 <= offset <= total:
        raise InvalidCursor(str(cursor))
    page = rows.page(offset, limit) if stored else rows.orderBy(*order).offset(offset).limit(limit)
    last = offset + limit
    return page, encode({"version": 1, "kind": kind, "snapshot": snapshot, "request": asked, "offset": last}) if last < total else None


def by_key(rows: DataFrame, key: str, limit: int, cursor: str | None = None, descending: bool = False) -> tuple[DataFrame, str | None]:
    """A page of ``rows`` by a unique key after the cursor's, which must still be there, and the next page's cursor."""
    if cursor is not None:
        after = decode(cursor, {"after"})["after"]
        if rows.where(F.col(key) == F.lit(after)).isEmpty():
            raise InvalidCursor(cursor)
        rows = rows.where(F.col(key) < F.lit(after) if descending else F.col(key) > F.lit(after))
    ordered = rows.orderBy(F.col(key).desc() if descending else F.col(key).asc())
    keys = [r[0] for r in ordered.select(key).limit(limit + 1).collect()]
    return ordered.limit(limit), encode({"after": keys[limit - 1]}) if len(keys) > limit else None


def guarded(rows: DataFrame, limit: int, most: int = 10_000) -> DataFrame:
    """``rows``, or an error if there are more than ``limit``; nothing is cut."""
    if not 1 <= limit <= most:
        raise ValueError(f"the limit must be between 1 and {most}")
    n = rows.count()
    if n > limit:
        raise ValueError(f"{n} pages match; the limit is {limit}: narrow the filters, or raise it to at most {most}")
    return rows


def fields(frame: DataFrame, wanted: str, defaults: tuple[str, ...], allowed: tuple[str, ...]) -> DataFrame:
    """The columns named in a comma-separated list, in its order; the defaults for an empty one. An unknown, repeated or
    empty name is an error."""
    names = [n.strip() for n in wanted.split(",")] if wanted.strip() else list(defaults)
    for i, name in enumerate(names):
        if not name or name not in allowed:
            raise ValueError(f"unknown field {name!r}; fields are {', '.join(allowed)}")
        if name in names[:i]:
            raise ValueError(f"repeated field {name!r}")
    return frame.select(*names)


def lookup(pages: DataFrame, selector: str) -> DataFrame:
    """The page of a uri; with the authority ``_`` that of the path, from the source that comes first."""
    scheme, _, rest = selector.partition("://")
    authority, _, path = rest.partition("/")
    if authority != "_":
        return pages.where(F.col("uri") == selector)
    return pages.where(F.col("path") == path).orderBy("precedence", "uri").limit(1)


def of_type(pages: DataFrame, name: str) -> DataFrame:
    """All columns of the pages of exactly this type, by uri."""
    return pages.where(F.col("type") == name).orderBy("uri")


def refs_of_type(pages: DataFrame, name: str) -> DataFrame:
    """(uri, title, type) of the pages of exactly this type, by title and uri."""
    return pages.where(F.col("type") == name).select("uri", "title", "type").orderBy("title", "uri")


def merged_fields(current: Column, candidate: Column, known: tuple[str, ...]) -> Column:
    """The candidate's map with those keys of the current one that it lacks and that are not among the known ones."""
    kept = F.map_filter(F.coalesce(current, F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(candidate, k) & ~k.isin(*known) if known else ~F.map_contains_key(candidate, k))
    return F.map_concat(candidate, kept)


def external_collisions(written: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows of ``written`` (root, path) whose path a page of another root has."""
    roots = pages.groupBy("path").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).withColumnRenamed("path", "c_path")
    return written.join(roots, (F.col("path") == F.col("c_path")) & ((F.col("lo") != F.col("root")) | (F.col("hi") != F.col("root"))), "left_semi")
