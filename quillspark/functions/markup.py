"""Small parsers for one Markdown page: frontmatter, links, sections, claims, procedures, line diffs.

They are per-row helpers; ``quillspark.sources.vault`` runs them inside tasks over the scanned files."""

from __future__ import annotations

import datetime as dt
import json
import math
import re
from collections.abc import Iterator
from typing import Any
from urllib.parse import quote, unquote, urlsplit

import numpy as np

from quillspark.functions import markdown

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
_HEADING = re.compile(r"^(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$")
MAINTENANCE = ("stale", "incorrect", "duplicate")


def _loader() -> type:
    """YAML with the core schema's scalars (no yes/no booleans, no sexagesimal numbers) and timestamps."""
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    Loader.yaml_implicit_resolvers = {}
    scalars = [
        ("tag:yaml.org,2002:bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF"),
        ("tag:yaml.org,2002:int", r"^(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)$", "-+0123456789"),
        ("tag:yaml.org,2002:float", r"^(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$", "-+0123456789."),
        ("tag:yaml.org,2002:null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
        ("tag:yaml.org,2002:timestamp", r"^\d{4}-\d{2}-\d{2}(?:[Tt ]\d{2}:\d{2}:\d{2}(?:\.\d+)?[ \t]*(?:Z|[-+]\d{2}:\d{2})?)?$", "0123456789"),
        ("tag:yaml.org,2002:merge", r"^(?:<<)$", "<"),
    ]
    for tag, pattern, first in scalars:
        Loader.add_implicit_resolver(tag, re.compile(pattern), list(first))
    return Loader


def split_page(text: str) -> tuple[str, str] | None:
    """(frontmatter, body), or null where a page has none. Lines end in LF."""
    if not text.startswith("---\n"):
        return None
    end = text.find("\n---\n", 3)
    if end < 0:
        return None
    return text[4:end] if end > 3 else "", text[end + 5 :]


def when(value: Any) -> str:
    """An authored time as a string: a date alone, or a full time in UTC."""
    if isinstance(value, dt.datetime):
        utc = value.astimezone(dt.UTC) if value.tzinfo else value
        if utc.time() == dt.time(0):
            return utc.date().isoformat()
        return utc.replace(tzinfo=None).isoformat().rstrip("0").rstrip(".") + "Z" if utc.microsecond else utc.replace(tzinfo=None).isoformat() + "Z"
    return value.isoformat() if isinstance(value, dt.date) else str(value).strip()


def _strings(fields: dict, name: str, problems: list[str]) -> list[str]:
    value = fields.get(name)
    items = [value] if isinstance(value, str) else value
    if items is None:
        return []
    if not isinstance(items, list):
        problems.append(f"{name}: not a list of strings")
        return []
    if any(x is not None and not isinstance(x, str) for x in items):
        problems.append(f"{name}: holds something that is not a string")
    return [x.strip() for x in items if isinstance(x, str) and x.strip()]


def _string(fields: dict, name: str, problems: list[str]) -> str:
    value = fields.get(name)
    if value is None:
        return ""
    if not isinstance(value, str):
        problems.append(f"{name}: not a string")
        return ""
    return value.strip()


def humanised(stem: str) -> str:
    return " ".join(w[:1].upper() + w[1:] for w in re.split(r"[-_]+", stem) if w)


def unfenced(body: str) -> list[tuple[int, int, str]]:
    """(line number from 1, offset, line) of the lines outside code fences."""
    out, fence, at = [], None, 0
    for number, line in enumerate(body.split("\n"), 1):
        m = _FENCE.match(line)
        if fence is None and m:
            fence = m[1]
        elif fence is not None:
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not line.strip().strip(fence[0]):
                fence = None
        else:
            out.append((number, at, line))
        at += len(line) + 1
    return out


def _without_code(line: str) -> str:
    """The line with code spans blanked out, so that places stay."""
    out, i = list(line), 0
    while i < len(line):
        if line[i] == "`":
            n = len(line[i:]) - len(line[i:].lstrip("`"))
            j = i + n
            while (j := line.find("`" * n, j)) >= 0 and (line[j + n : j + n + 1] == "`" or line[j - 1] == "`"):
                j += 1
            if j >= 0:
                out[i : j + n] = " " * (j + n - i)
                i = j + n
                continue
            i += n
        else:
            i += 1 + (line[i] == "\\")
    return "".join(out)


def link_spans(body: str) -> list[tuple[int, int, str]]:
    """(start, end, destination) of inline links and images, autolinks, and definitions that are referred to, by place."""
    return sorted({(x.start, x.end, x.dest) for x in markdown.links(body)})


_BAD_ESCAPE = re.compile(r"%(?![0-9A-Fa-f]{2})")


def destination(raw: str, scheme: str = "kb") -> tuple[str, str] | None:
    """(kind, target) of a link inside the corpus: kind uri for canonical ones, else absolute or relative path; invalid, with the
    destination, for a uri of the scheme that is not canonical and for broken escapes. Null for links to elsewhere."""
    raw = raw.strip()
    if not raw or raw.startswith("#"):
        return None
    try:
        parts = urlsplit(raw)
    except ValueError:
        return "invalid", raw
    if parts.scheme == scheme:
        found = canonical_uri(raw, True, scheme)
        return ("uri", found) if found else ("invalid", raw)
    if parts.scheme or parts.netloc or raw.startswith("//") or not parts.path:
        return None
    if _BAD_ESCAPE.search(parts.path):
        return "invalid", raw
    path = unquote(parts.path)
    return ("absolute", path.lstrip("/")) if path.startswith("/") else ("relative", path)


def uri_of(vault: str, path: str, scheme: str = "kb") -> str:
    """The one identity of a page: its path with all but letters, digits and ``-_.~/$&+,:;=@`` escaped."""
    return f"{scheme}://{quote(vault.strip() or 'default')}/{quote(path, safe='/$&+,:;=@')}"


def canonical_uri(raw: str, suffix: bool = False, scheme: str = "kb") -> str | None:
    """The page's uri where ``raw`` is exactly one, with ``suffix`` also one that a query or fragment follows; else null."""
    if not raw or raw != raw.strip():
        return None
    parts = urlsplit(raw)
    if parts.scheme != scheme or not parts.netloc or "@" in parts.netloc or _BAD_ESCAPE.search(parts.path) or not suffix and ("?" in raw or "#" in raw):
        return None
    path = unquote(parts.path.removeprefix("/"))
    if not path or "\\" in path or path.startswith("/") or clean(path) != path:
        return None
    found = uri_of(unquote(parts.netloc), path, scheme)
    return found if with_suffix(found, raw) == raw else None


def with_suffix(uri: str, raw: str) -> str:
    """A uri with the query and fragment that an authored destination has."""
    at = min((i for i in (raw.find("?"), raw.find("#")) if i >= 0), default=len(raw))
    return uri + raw[at:]


def clean(path: str) -> str | None:
    """A path without dots; null where it leaves the root."""
    out: list[str] = []
    for part in path.split("/"):
        if part in ("", "."):
            continue
        if part == "..":
            if not out:
                return None
            out.pop()
        else:
            out.append(part)
    return "/".join(out)


def candidates(path: str, kind: str, target: str) -> list[str]:
    """Paths that a link from the page at ``path`` may mean, the likeliest first."""
    base = target if kind == "absolute" else f"{path.rpartition('/')[0]}/{target}"
    found = clean(base)
    return [] if not found else [found] if found.endswith(".md") else [found, f"{found}.md"]


def rewrite_links(body: str, new: dict[str, str]) -> str:
    """The body with each destination that is a key of ``new`` replaced; all other bytes stay."""
    for start, end, dest in reversed(markdown.spans(body)):
        plain, mark, suffix = dest.partition("#")
        target = new.get(dest) or (f"{new[plain]}{mark}{suffix}" if plain in new else None)
        if target:
            body = body[:start] + target + body[end:]
    return body


def sections(body: str, level: int | None = None) -> list[dict[str, str]]:
    """Sections at headings: of any level without regard to fences, or of one level outside fences."""
    if level is None:
        cuts, at = [], 0
        for line in body.split("\n"):
            if m := _HEADING.match(line):
                cuts.append((at, m[2]))
            at += len(line) + 1
    else:
        cuts = [(at, m[2]) for _, at, line in unfenced(body) if (m := _HEADING.match(line)) and len(m[1]) == level]
    ends = [a for a, _ in cuts[1:]] + [len(body)] * bool(cuts)
    return [{"section": name, "content": body[a:b].strip()} for (a, name), b in zip(cuts, ends, strict=True)]


def claims(body: str) -> list[dict[str, Any]]:
    """Marks ``^[inferred]`` and ``^[ambiguous]`` outside code, with line and column from 1."""
    return [{"kind": m[1], "line": n, "column": m.start() + 1} for n, _, line in unfenced(body) for m in re.finditer(r"\^\[(inferred|ambiguous)\]", _without_code(line))]


_STEP = re.compile(r"^STEP (\d+)\s*[-–—:]\s*(.+)$", re.I)


def procedure(body: str) -> tuple[list[dict[str, str]], list[str]]:
    """Steps (name, inputs, process, completion) of a procedure, one or several, and what is missing."""
    problems: list[str] = []

    def step(name: str, text: str, level: int) -> dict[str, str]:
        parts = {s["section"].lower(): s["content"].partition("\n")[2].strip() for s in sections(text, level)}
        for part in ("inputs", "process", "completion"):
            if not parts.get(part):
                problems.append(f"{name or 'procedure'}: no {part}")
        return {"name": name, **{p: parts.get(p, "") for p in ("inputs", "process", "completion")}}

    numbered = [(int(m[1]), m[2], s["content"]) for s in sections(body, 2) if (m := _STEP.match(s["section"]))]
    if not numbered:
        return [step("", body, 2)], problems
    if [n for n, *_ in numbered] != list(range(1, len(numbered) + 1)):
        problems.append("steps are not numbered from 1 in order")
    return [step(name, text.partition("\n")[2], 3) for _, name, text in numbered], problems


# How a diff begins.
DIFF_HEAD = ("--- current", "+++ candidate")


def _suffixes(a: np.ndarray, b: np.ndarray, below: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of the lengths of longest common subsequences of ``a[i:]`` and ``b[j:]``, from the last i down, under ``below``."""
    for x in a[::-1]:
        met = below.copy()
        same = np.flatnonzero(b == x)
        met[same] = below[same + 1] + 1
        below = np.maximum.accumulate(met[::-1])[::-1]
        yield below


def line_diff(before: str, after: str) -> str:
    """A line diff along a longest common subsequence: a common line is kept; else the old line goes where no longer
    subsequence needs it; else the new one comes. An empty text has no lines.

    Of the table's rows, as many as the root of their number are held; those between are made again as the walk gets there.
    So memory is the lines times that root, not the product of both texts' lines."""
    old, new = (t.split("\n") if t else [] for t in (before, after))
    number: dict[str, int] = {}
    a, b = (np.array([number.setdefault(line, len(number)) for line in lines], np.int64) for lines in (old, new))
    step = max(math.isqrt(len(a)), 1)
    below = np.zeros(len(b) + 1, np.int32)
    held = {len(a): below}
    for k, row in enumerate(_suffixes(a, b, below), 1):
        if (len(a) - k) % step == 0:
            held[len(a) - k] = row
    out, i, j = list(DIFF_HEAD), 0, 0
    while i < len(a):
        last = min((i // step + 1) * step, len(a))
        rows = [*_suffixes(a[i:last], b, held[last])][::-1] + [held[last]]
        first = i
        while i < last:
            if j < len(b) and a[i] == b[j]:
                out.append(f" {old[i]}")
                i, j = i + 1, j + 1
            elif j == len(b) or rows[i + 1 - first][j] >= rows[i - first][j + 1]:
                out.append(f"-{old[i]}")
                i += 1
            else:
                out.append(f"+{new[j]}")
                j += 1
    return "\n".join(out + [f"+{line}" for line in new[j:]]) + "\n"


def parse_page(path: str, data: bytes) -> dict[str, Any]:
    """Everything that is read off one page; ``problem`` where its frontmatter cannot be read."""
    import yaml

    text = data.decode("utf-8", "replace")
    empty = {"title": "", "description": "", "type": "", "aliases": [], "tags": [], "body": text, "metadata": "{}", "relationships": [], "links": [], "maintenance": [], "claims": [], "sections": [], "problem": None, "problems": []}
    parts = split_page(text)
    if parts is None:
        return empty | {"problem": "no frontmatter"}
    try:
        fields = yaml.load(parts[0], _loader()) or {}  # noqa: S506  a safe loader's subclass
    except yaml.YAMLError as e:
        return empty | {"problem": f"yaml: {str(e).splitlines()[0]}"}
    if not isinstance(fields, dict):
        return empty | {"problem": "frontmatter is not a map"}
    problems: list[str] = []
    body = parts[1]
    heading = next((line[2:].strip() for line in body.split("\n") if line.startswith("# ")), "")
    title = _string(fields, "title", problems) or heading or humanised(path.rpartition("/")[2].removesuffix(".md"))
    kind = _string(fields, "type", problems)
    if not kind:
        problems.append("type: missing")
    relationships = []
    for item in fields.get("relationships") or []:
        if isinstance(item, dict) and all(isinstance(item.get(k), str) and item[k].strip() for k in ("type", "target")):
            relationships.append({"type": item["type"].strip(), "target": item["target"].strip()})
        else:
            problems.append("relationships: an item lacks type or target")
    maintenance = []
    for item in fields.get("maintenance") or []:
        known = isinstance(item, dict) and set(item) <= {"kind", "reason", "observed_at", "author", "target"}
        if known and item.get("kind") in MAINTENANCE and item.get("reason") and item.get("observed_at") and bool(item.get("target")) == (item["kind"] == "duplicate"):
            maintenance.append({"kind": item["kind"], "reason": str(item["reason"]), "observed_at": when(item["observed_at"]), "author": item.get("author"), "target": item.get("target")})
        else:
            problems.append("maintenance: an item is not valid")
    plain = {k: when(v) if isinstance(v, dt.date) else v for k, v in fields.items()}
    return {
        "title": title,
        "description": _string(fields, "description", problems) or _string(fields, "summary", problems),
        "type": kind,
        "aliases": _strings(fields, "aliases", problems),
        "tags": _strings(fields, "tags", problems),
        "body": body,
        "metadata": json.dumps(plain, default=str, sort_keys=True),
        "relationships": relationships,
        "links": [x.dest for x in markdown.links(body)],
        "maintenance": maintenance,
        "claims": claims(body),
        "sections": sections(body),
        "problem": None,
        "problems": problems,
    }
