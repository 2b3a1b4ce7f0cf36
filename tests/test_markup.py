import random

import pytest

from quillspark.functions import markup


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("see [a](x.md) and ![i](pic.png 'title')", ["x.md", "pic.png"]),
        ("[b](<sp ace.md>) [c](a(b).md)", ["sp ace.md", "a(b).md"]),
        ("[r][Ref] and [Ref]\n\n[ref]: target.md", ["target.md"]),
        ("`[no](code.md)` ``x ` [no](y.md)``", []),
        ("```\n[no](fenced.md)\n```\n[yes](z.md)", ["z.md"]),
        ("<https://a.example/b> [q](\\(x\\).md)", ["https://a.example/b", "(x).md"]),
    ],
)
def test_links(body, want):
    assert sorted(d for _, _, d in markup.link_spans(body)) == sorted(want)


def test_destinations_and_candidates():
    assert markup.destination("#x") is None and markup.destination("https://x.y/z") is None
    assert markup.destination("kb://v/a%20b.md") == ("uri", "kb://v/a%20b.md")
    assert markup.destination("/a/b.md?q#f") == ("absolute", "a/b.md")
    assert markup.candidates("d/e.md", "relative", "../f") == ["f", "f.md"]
    assert markup.candidates("e.md", "relative", "../f") == []


def test_uris_are_canonical_or_nothing():
    uri = "kb://Test/notes/a%20note.md"
    assert markup.uri_of("Test", "notes/a note.md") == uri == markup.canonical_uri(uri) == markup.canonical_uri(f"{uri}?view=full#part", suffix=True)
    assert markup.canonical_uri(f"{uri}#section%2Fchild", suffix=True) == uri and markup.destination(f"{uri}#part") == ("uri", uri)
    for raw in ("kb://Test/notes/../a.md", "kb://Test//notes/a.md", "kb://user@Test/notes/a.md", "kb://Test/notes%2Fa.md", "KB://Test/notes/a.md", f"{uri}#part", f" {uri}", "kb://Test/", "kb://Test/a\\b.md", "kb://Test/a b.md", "kb:///a.md", "kb://Test/%zz.md"):
        assert markup.canonical_uri(raw) is None, raw
        if raw.lower().startswith("kb") and "#" not in raw:
            assert markup.destination(raw)[0] == "invalid", raw
    assert markup.destination("bad%ZZ.md") == ("invalid", "bad%ZZ.md") and markup.destination("//cdn.example.com/x") is None
    assert markup.with_suffix("kb://v/p.md", "p.md?q=1#s") == "kb://v/p.md?q=1#s" and markup.uri_of(" ", "a&b.md") == "kb://default/a&b.md"


def test_rewrite_keeps_other_bytes():
    body = "a [x](p.md#s) `[x](p.md)` <b> [y](<p.md>)"
    assert markup.rewrite_links(body, {"p.md": "kb://v/p.md"}) == "a [x](kb://v/p.md#s) `[x](p.md)` <b> [y](<kb://v/p.md>)"


def test_page():
    data = b"---\ntype: Note\nsummary: short\ntags: one\naliases: [a, ' ', b]\nvalid_from: 2024-01-02\nobserved_at: 2024-01-02T03:04:05Z\nflag: yes\nn: 1:20\nrelationships:\n- {type: uses, target: x.md}\n- {type: uses}\nmaintenance:\n- {kind: duplicate, reason: r, observed_at: 2024-01-01T00:00:00Z, target: y.md}\n- {kind: odd}\n---\n# Title here\ntext ^[ambiguous]\n`^[inferred]`\n## One\nx\n"
    page = markup.parse_page("some-dir/my_page.md", data)
    assert (page["title"], page["type"], page["description"], page["tags"], page["aliases"]) == ("Title here", "Note", "short", ["one"], ["a", "b"])
    assert page["relationships"] == [{"type": "uses", "target": "x.md"}] and len(page["problems"]) == 2
    assert page["claims"] == [{"kind": "ambiguous", "line": 2, "column": 6}]
    assert '"flag": "yes"' in page["metadata"] and '"valid_from": "2024-01-02"' in page["metadata"] and '"observed_at": "2024-01-02T03:04:05Z"' in page["metadata"]
    assert markup.parse_page("a.md", b"no matter")["problem"] == "no frontmatter"
    assert markup.parse_page("a.md", b"---\n[1\n---\n")["problem"].startswith("yaml")
    assert markup.parse_page("x/my_page-two.md", b"---\ntype: T\n---\n")["title"] == "My Page Two"


def test_sections_differ_on_fences():
    body = "# A\n```\n## in fence\n```\n## B\nb"
    assert [s["section"] for s in markup.sections(body)] == ["A", "in fence", "B"]
    assert [s["section"] for s in markup.sections(body, 2)] == ["B"]


def test_procedures():
    one = "## Inputs\ni\n## Process\np\n## Completion\nc\n"
    assert markup.procedure(one) == ([{"name": "", "inputs": "i", "process": "p", "completion": "c"}], [])
    many = "## STEP 1 - First\n### Inputs\ni\n### Process\np\n### Completion\nc\n## STEP 3 - Last\n### Inputs\ni\n"
    steps, problems = markup.procedure(many)
    assert [s["name"] for s in steps] == ["First", "Last"] and len(problems) == 3


def _plain_diff(a, b):
    """The whole table of common lengths, and the walk along it."""
    n, m = len(a), len(b)
    common = [[0] * (m + 1) for _ in range(n + 1)]
    for i in reversed(range(n)):
        for j in reversed(range(m)):
            common[i][j] = common[i + 1][j + 1] + 1 if a[i] == b[j] else max(common[i + 1][j], common[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            out, i, j = [*out, f" {a[i]}"], i + 1, j + 1
        elif i < n and (j == m or common[i + 1][j] >= common[i][j + 1]):
            out, i = [*out, f"-{a[i]}"], i + 1
        else:
            out, j = [*out, f"+{b[j]}"], j + 1
    return out


def test_line_diff_is_the_canonical_one():
    rnd = random.Random(2)
    for k in range(2500):
        most = 8 if k < 2000 else 40
        a, b = ([rnd.choice("wxyz"[: rnd.randint(1, 4)]) for _ in range(rnd.randint(1, most))] for _ in range(2))
        assert markup.line_diff("\n".join(a), "\n".join(b)).split("\n") == ["--- current", "+++ candidate", *_plain_diff(a, b), ""]
    assert markup.line_diff("c\nd", "c\nc\nd\nd").split("\n")[2:-1] == [" c", "+c", " d", "+d"]
    assert markup.line_diff("", "") == "--- current\n+++ candidate\n" and markup.line_diff("", "x\ny") == "--- current\n+++ candidate\n+x\n+y\n"
    assert markup.line_diff("x\n", "") == "--- current\n+++ candidate\n-x\n-\n"


def test_line_diff_of_long_texts():
    long = [str(i) for i in range(8_000)]
    assert markup.line_diff("\n".join(long), "\n".join(long[:3_000] + ["new"] + long[3_001:])).count("\n+") == 2
