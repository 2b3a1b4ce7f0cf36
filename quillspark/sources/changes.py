"""Stream readers whose offsets are numbered entries of a log in a shared folder (option ``state``).

An entry is written once, before the offset that names it is handed out, so a batch that is planned again reads the same
entries: rows and offset are committed together, by the query's own checkpoint. Entries before a committed offset go.

``file_changes``: an entry is the listing of a folder (path, modification time, size); a batch has the paths that are new,
changed or gone between two listings. ``rest_listing``: an entry is one page of a listing service, as it was received."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


def _system(path: str):  # noqa: ANN202  a file system and the path in it
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Log:
    """Numbered JSON entries in a folder, the first one 1. Whoever appends is the one reader of a query."""

    def __init__(self, folder: str) -> None:
        self.fs, self.folder = _system(folder.rstrip("/"))
        self.fs.create_dir(self.folder, recursive=True)

    def numbers(self) -> list[int]:
        from pyarrow import fs

        names = [i.base_name for i in self.fs.get_file_info(fs.FileSelector(self.folder)) if i.base_name.endswith(".json")]
        return sorted(int(n.removesuffix(".json")) for n in names)

    def path(self, number: int) -> str:
        return f"{self.folder}/{number:012}.json"

    def read(self, number: int) -> dict:
        with self.fs.open_input_stream(self.path(number)) as f:
            return json.loads(f.read())

    def write(self, number: int, entry: dict) -> None:
        part = f"{self.path(number)}.part"
        with self.fs.open_output_stream(part) as f:
            f.write(json.dumps(entry).encode())
        self.fs.move(part, self.path(number))

    def forget(self, before: int) -> None:
        for number in self.numbers():
            if number < before:
                self.fs.delete_file(self.path(number))


class _Rows(InputPartition):
    def __init__(self, rows: list[tuple]) -> None:
        self.rows = rows


class FileChangesReader(DataSourceStreamReader):
    """A listing is compared with the last one when the stream asks for its latest offset; without a difference the offset
    stays. The log's last entry is the state, also after a restart."""

    #: Changes of one partition.
    ROWS = 10_000

    def __init__(self, options: dict) -> None:
        self.fs, self.root = _system(options["path"].rstrip("/"))
        self.log = Log(options["state"])

    def _listing(self) -> dict[str, list[int]]:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(self.root, recursive=True, allow_not_found=True))
        return {i.path[len(self.root) :].lstrip("/"): [i.mtime_ns or 0, i.size] for i in found if i.is_file}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"listing": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        last = (self.log.numbers() or [0])[-1]
        now = self._listing()
        if now != (self.log.read(last) if last else {}):
            last += 1
            self.log.write(last, now)
        return {"listing": last}

    def partitions(self, start: dict, end: dict) -> list[_Rows]:
        before, now = (self.log.read(o["listing"]) if o["listing"] else {} for o in (start, end))
        rows = [(p, "new" if p not in before else "changed", m, s) for p, (m, s) in now.items() if before.get(p) != [m, s]]
        rows += [(p, "gone", m, s) for p, (m, s) in before.items() if p not in now]
        rows.sort()
        return [_Rows(rows[i : i + self.ROWS]) for i in range(0, len(rows), self.ROWS)]

    def read(self, partition: _Rows) -> Iterator[tuple]:
        for path, change, modified, size in partition.rows:
            yield path, change, modified // 1000, size

    def commit(self, end: dict) -> None:
        self.log.forget(end["listing"])


class FileChanges(DataSource):
    """``format("file_changes")``: options path (a folder) and state (a folder of the stream's own). Rows: path under the
    folder, change (new, changed, gone), modification time in microseconds, size. A file that is changed back between two
    batches is told of if its time changed; one that keeps time and size is not: look at everything at a tick."""

    @classmethod
    def name(cls) -> str:
        return "file_changes"

    def schema(self) -> str:
        return "path string, change string, modified_us long, size long"

    def streamReader(self, schema) -> FileChangesReader:  # noqa: ANN001, N802
        return FileChangesReader({k.lower(): v for k, v in self.options.items()})


class _Entry(InputPartition):
    def __init__(self, number: int) -> None:
        self.number = number


class RestListingReader(DataSourceStreamReader):
    """Pages of the listings of a service, one listing after the other, then again for what was updated since.

    The offset names the log's last page, with the listing it is of, its page number and the time since which records count.
    A service that says 403 or 429 stops the reader: the offset stays where it is, until the time that the answer names.
    A round ends with a short page of the last listing; the next counts from a minute before this one began."""

    def __init__(self, options: dict, clock=time.time) -> None:  # noqa: ANN001
        self.url, self.token = options["url"].rstrip("/"), options.get("token")
        self.kinds = [tuple(x.split("=", 1)) for x in options["listings"].split(",")]
        self.per_page, self.most, self.batch = int(options.get("perpage", 100)), int(options.get("maxpages", 0)), int(options.get("pagesperbatch", 20))
        self.bytes, self.every = int(options.get("maxbytes", 2 << 20)), float(options.get("every", 0))
        self.since = options.get("since")
        self.log, self.clock, self.resume_at = Log(options["state"]), clock, 0.0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"entry": 0, "kind": "", "page": 0, "since": self.since}

    def _next(self, last: dict | None) -> dict | None:
        """What is to be read after an entry; null where a round has ended and the next is not due."""
        now = self.clock()
        if last is None:
            return {"listing": 0, "page": 1, "since": self.since, "began": now}
        own = {k: last[k] for k in ("listing", "page", "since", "began")}
        if not last["short"] and not (self.most and last["page"] >= self.most):
            return own | {"page": last["page"] + 1}
        if last["listing"] + 1 < len(self.kinds):
            return own | {"listing": last["listing"] + 1, "page": 1}
        if now < last["began"] + self.every:
            return None
        since = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(last["began"] - 60))
        return {"listing": 0, "page": 1, "since": since, "began": now}

    def _fetch(self, at: dict) -> list | None:
        """A page's records, or null where the service asks to wait."""
        path = self.kinds[at["listing"]][1]
        request = urllib.request.Request(f"{self.url}{path}{'&' if '?' in path else '?'}per_page={self.per_page}&page={at['page']}")  # noqa: S310
        if self.token:
            request.add_header("Authorization", f"Bearer {self.token}")
        try:
            with urllib.request.urlopen(request, timeout=30) as answer:  # noqa: S310
                body = answer.read(self.bytes + 1)
        except urllib.error.HTTPError as e:
            if e.code not in (403, 429):
                raise
            self.resume_at = float(e.headers.get("X-RateLimit-Reset") or self.clock() + 60)
            return None
        if len(body) > self.bytes:
            raise ValueError(f"a page of more than {self.bytes} bytes")
        found = json.loads(body)
        if not isinstance(found, list):
            raise ValueError("a page is not a list")
        return found

    def latestOffset(self) -> dict:  # noqa: N802
        number = (self.log.numbers() or [0])[-1]
        last = self.log.read(number) if number else None
        began_round = False
        for _ in range(self.batch):
            at = self._next(last) if self.clock() >= self.resume_at else None
            # a round that has just ended is a batch of its own
            if at is None or began_round and at["listing"] == 0 and at["page"] == 1:
                break
            items = self._fetch(at)
            if items is None:
                break
            number, last, began_round = number + 1, at | {"short": len(items) < self.per_page, "items": items}, True
            self.log.write(number, last)
        if last is None:
            return self.initialOffset()
        return {"entry": number, "kind": self.kinds[last["listing"]][0], "page": last["page"], "since": last["since"]}

    def partitions(self, start: dict, end: dict) -> list[_Entry]:
        return [_Entry(n) for n in range(start["entry"] + 1, end["entry"] + 1)]

    def read(self, partition: _Entry) -> Iterator[tuple]:
        entry = self.log.read(partition.number)
        for item in entry["items"]:
            updated = next((v for k in ("updated_at", "submitted_at", "created_at") if (v := item.get(k))), None) if isinstance(item, dict) else None
            if entry["since"] is None or updated is None or updated >= entry["since"]:
                yield self.kinds[entry["listing"]][0], entry["page"], json.dumps(item)

    def commit(self, end: dict) -> None:
        self.log.forget(end["entry"])


class RestListing(DataSource):
    """``format("rest_listing")``: options url, listings (kind=path, separated by commas), state (a folder of the stream's own),
    and token, since (UTC, ISO 8601), perPage, maxPages (a listing), pagesPerBatch, every (seconds between rounds). A page is
    fetched once, by the driver, one at a time (at most maxBytes), and kept in the log until its batch is committed; the
    tasks read it there. Rows: kind, page, raw_payload."""

    @classmethod
    def name(cls) -> str:
        return "rest_listing"

    def schema(self) -> str:
        return "kind string, page int, raw_payload string"

    def streamReader(self, schema) -> RestListingReader:  # noqa: ANN001, N802
        return RestListingReader({k.lower(): v for k, v in self.options.items()})
