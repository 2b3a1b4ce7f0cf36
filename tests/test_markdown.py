import random

import pytest

from quillspark.functions import markdown, markup

CASES = [
    # blocks
    ("    [x](a.md)", []),
    ("text\n    [x](a.md)", ["a.md"]),
    ("\t[x](a.md)", []),
    ("- item\n\n      [x](a.md)\n\n  [y](b.md)", ["b.md"]),
    ("- item\n\n  [y](b.md)", ["b.md"]),
    ("1.  item\n\n        [x](a.md)\n\n    [y](b.md)", ["b.md"]),
    ("> quote [x](a.md)\nlazy [y](b.md)", ["a.md", "b.md"]),
    ("> ```\n> [x](a.md)\n[y](b.md)", ["b.md"]),
    (">     [x](a.md)\n> [y](b.md)", ["b.md"]),
    ("```\n[x](a.md)\n~~~\n[x](a.md)\n````\n[y](b.md)", ["b.md"]),
    ("``` a`b\n[x](a.md)", ["a.md"]),
    ("~~~ a`b\n[x](a.md)\n~~~ c\n[x](a.md)\n~~~\n[y](b.md)", ["b.md"]),
    ("<div>\n[x](a.md)\n\n[y](b.md)\n</div>", ["b.md"]),
    ("<!-- [x](a.md)\n\n[x](a.md) -->\n[y](b.md)", ["b.md"]),
    ("<pre>\n\n[x](a.md)\n</pre>\n[y](b.md)", ["b.md"]),
    ("<b>\n[x](a.md)", []),
    ("text\n<b>\n[x](a.md)", ["a.md"]),
    ("<b>[x](a.md)</b>", ["a.md"]),
    ("# [x](a.md) #\n[y](b.md)\n===\n[z](c.md)", ["a.md", "b.md", "c.md"]),
    ("#[x](a.md)", ["a.md"]),
    ("* * *\n- - [x](a.md)\n+ > [y](b.md)", ["a.md", "b.md"]),
    ("text\n2. [x](a.md)\n- [y](b.md)", ["a.md", "b.md"]),
    ("-\n\n  [x](a.md)", ["a.md"]),
    ("-\n      [x](a.md)", []),
    ("a\r\n[x](a.md)\r\n", ["a.md"]),
    # inline
    ("\\[x](a.md) \\\\[y](b.md)", ["b.md"]),
    ("[two\nlines](a.md)", ["a.md"]),
    ("[x](\n  a.md\n  'title'\n)", ["a.md"]),
    ("[x](a.md 'no end)", []),
    ("[x](a.md\"t\") [y](b.md (t)) [z](<c d.md> \"t\")", ["a.md\"t\"", "b.md", "c d.md"]),
    ("[x](a b.md) [y](<a\nb>) [z]()", [""]),
    ("[x](a(b(c)).md) [y](a\\(b.md) [z](a(b.md)", ["a(b(c)).md", "a(b.md"]),
    ("[x](a&amp;b.md) [y](a&nosuch;b.md) [z](&#35;)", ["a&b.md", "a&nosuch;b.md", "#"]),
    ("[![i](i.png)](a.md)", ["a.md", "i.png"]),
    ("![a [b](c.md) d](e.md)", ["e.md", "c.md"]),
    ("[a [b](c.md) d](e.md)", ["c.md"]),
    ("[a [b [c](d.md)](e.md)](f.md)", ["d.md"]),
    ("[a ![b [c](d.md)](e.md)](f.md)", ["e.md", "d.md"]),
    ("[a] [b](c.md) ] [d](e.md)", ["c.md", "e.md"]),
    ("`[x](a.md)` ``[x](a.md)`` ` [y](b.md)", ["b.md"]),
    ("[x`](a.md)`", []),
    ("[x<b title=\"](a.md)\">", []),
    ("<https://a.example/?b> <me@host.example> <not a link> <a:>", ["https://a.example/?b"]),
    ("[x<https://a.example/](b.md)>", ["https://a.example/](b.md)"]),
    ("<!-- c --> a <!-- [x](a.md) --> [y](b.md)", []),
    ("a <!-- [x](a.md) --> <?[x](a.md)?> <![CDATA[[x](a.md)]]> [y](b.md)", ["b.md"]),
    # definitions
    ("[r]:\n b.md\n\n[r] [R][] [text][ r ]", ["b.md"] * 3),
    ("[r]: b.md\n'a\ntitle'\n[r]", ["b.md"]),
    ("[r]: b.md 'title' more\n\n[r]", []),
    ("[r]: b.md\n'title' more\n\n[r]", ["b.md"]),
    ("text\n[r]: b.md\n\n[r]", []),
    ("# h\n[r]: b.md\n===\n[r]", ["b.md"]),
    ("[r]: <>\n\n[r]", [""]),
    ("[r]:\n\n[r]", []),
    ("[r]: a.md\n[R]: b.md\n\n[r]", ["a.md"]),
    ("> [r]: a.md\n\n[r]", ["a.md"]),
    ("[r [x]]: a.md\n\n[r [x]]", []),
    ("[ẞ]: a.md\n\n[SS]", ["a.md"]),
    ("[r]: a.md\n\n[no][r] [r][no] ![r]", ["a.md"] * 2),
    ("[r]: a.md\n\n[r](b.md) [r](b c)", ["b.md", "a.md"]),
    ("[r]\n\n    [r]: a.md", []),
    ("```\n[r]: a.md\n```\n[r]", []),
]


@pytest.mark.parametrize(("source", "want"), CASES)
def test_links_of_the_grammar(source, want):
    assert [x.dest for x in markdown.links(source)] == want


def test_places_are_those_of_the_raw_destinations():
    for source, _ in CASES:
        for a, b, dest in markdown.spans(source):
            assert markdown.unescaped(source[a:b]) == dest


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("[B](n/a_(d).md \"T\")\n[R][t]\n\n[t]: <n/r f.md?v=1#s> 'T'\n", "[B](K:n/a_(d).md \"T\")\n[R][t]\n\n[t]: <K:n/r f.md?v=1#s> 'T'\n"),
        ("[U][u]\n\n[u]: n/u.md\n[v]: n/v.md\n", "[U][u]\n\n[u]: K:n/u.md\n[v]: n/v.md\n"),
        ("[f]: n/1.md\n[F]: n/2.md\n\n[F][f]\n", "[f]: K:n/1.md\n[F]: n/2.md\n\n[F][f]\n"),
        ("[f]: <>\n[F]: n/2.md\n\n[F][f]\n", "[f]: <>\n[F]: n/2.md\n\n[F][f]\n"),
        ("> [t]:\n> n/t.md\n>\n> [R][t]\n\n[<span title=\"]\">l</span>](n/t.md)\n", "> [t]:\n> K:n/t.md\n>\n> [R][t]\n\n[<span title=\"]\">l</span>](K:n/t.md)\n"),
        ("[![P](i/p.png)](n/t.md)\n<kb://v/x.md>\n    [c](d.md)\n", "[![P](K:i/p.png)](K:n/t.md)\n<kb://v/x.md>\n    [c](K:d.md)\n"),
        ("- a\n\n\t[x](y.md)\n> > [q](\n> > z.md)\n", "- a\n\n\t[x](K:y.md)\n> > [q](\n> > K:z.md)\n"),
    ],
)
def test_rewriting_keeps_all_other_bytes(source, want):
    new = {d: f"K:{d}" for _, _, d in markdown.spans(source)}
    assert markup.rewrite_links(source, new) == want
    assert markup.rewrite_links(source, {}) == source


def test_any_text_is_read():
    rng = random.Random(1)
    parts = ["[", "]", "(", ")", "<", ">", "!", "`", "```", "\n", "\n\n", "    ", "\t", "- ", "1. ", "> ", "#", "a", "a.md", "[r]", ": ", "\\", "&amp;", "'", '"', "<div>", "<!--", "-->", "==="]
    for _ in range(3000):
        source = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        for a, b, dest in markdown.spans(source):
            assert markdown.unescaped(source[a:b]) == dest
    assert markdown.links("[" * 20_000 + "](a.md)" * 3)[0].dest == "a.md"
