"""Records of upstream services kept as raw JSON: fields, events, and paged listings as a data source."""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def first_of(payload: Column, *names: str) -> Column:
    """The first of these fields that is there and not empty."""
    return F.coalesce(*[F.nullif(F.get_json_object(payload, f"$.{n}"), F.lit("")) for n in names])


def normalised(records: DataFrame) -> DataFrame:
    """Records (kind, raw_payload) with source_id and updated_at, from whichever fields the kind has; invalid ones are flagged."""
    raw = F.col("raw_payload")
    return records.withColumns(
        {
            "source_id": first_of(raw, "node_id", "sha", "id"),
            "updated_at": first_of(raw, "updated_at", "submitted_at", "created_at", "commit.committer.date", "commit.author.date"),
            "valid": F.try_parse_json(raw).isNotNull(),
        }
    )


def signature_ok(secret: bytes, body: bytes, header: str) -> bool:
    """Whether a delivery's ``sha256=<hex>`` header signs its body."""
    name, _, given = header.partition("=")
    return name == "sha256" and hmac.compare_digest(hmac.new(secret, body, hashlib.sha256).hexdigest(), given.lower())


def exploded(deliveries: DataFrame, arrays: tuple[str, ...]) -> DataFrame:
    """One record for each object in the named arrays of a delivery's payload (delivery_id, raw_payload)."""
    parts = [F.from_json(F.get_json_object("raw_payload", f"$.{name}"), "array<string>") for name in arrays]
    kinds = F.array(*[F.struct(F.lit(n).alias("kind"), F.coalesce(p, F.array().cast("array<string>")).alias("objects")) for n, p in zip(arrays, parts, strict=True)])
    return deliveries.select("delivery_id", F.inline(kinds)).select("delivery_id", "kind", F.explode("objects").alias("raw_payload"))


class _Page(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class PagedReader(DataSourceReader):
    """Pages of a listing kept as files, each an array of JSON objects; a page is a partition."""

    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[_Page]:
        from pyarrow import fs

        path = self.options["path"]
        system, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        pages = sorted(i.path for i in system.get_file_info(fs.FileSelector(root)) if i.is_file and i.base_name.endswith(".json"))
        first, most = int(self.options.get("firstpage", 1)), self.options.get("maxpages")
        return [_Page(p) for p in pages[first - 1 :][: int(most) if most else None]]

    def read(self, partition: _Page) -> Iterator[tuple]:
        from pyarrow import fs

        path = self.options["path"]
        system = fs.FileSystem.from_uri(path)[0] if "://" in path else fs.LocalFileSystem()
        with system.open_input_stream(partition.path) as f:
            for item in json.loads(f.read()):
                yield (self.options.get("kind", "issue"), json.dumps(item))


class PagedListing(DataSource):
    """``format("paged_listing")``: options path (a folder of pages), kind, firstPage (to resume at,
    from 1) and maxPages (all pages unless given; read on from firstPage + maxPages)."""

    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return "kind string, raw_payload string"

    def reader(self, schema) -> PagedReader:  # noqa: ANN001
        return PagedReader({k.lower(): v for k, v in self.options.items()})
