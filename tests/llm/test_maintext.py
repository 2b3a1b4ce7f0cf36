import math
import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from quillspark.llm import maintext

_LONG = "This sentence has quite a number of plain words, so that it is dense. " * 3
_P = " ".join(_LONG.split())


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", ""),
        (None, ""),
        ("<html><head><title>x</title></head><body></body></html>", ""),
        ("plain   text\n only", "plain text only"),
        (f"<body><nav><a href=/>Home</a></nav><article><h1>Head &amp; line</h1><p>{_LONG}<p>a&nbsp;<b>b</b>c<br>d<script>var t='</p>'</script></article><footer>f</footer>", f"Head & line\n\n{_P}\n\na bc d"),
        (f"<body><header><h1>Site</h1></header><main><header><h1>Title</h1></header><div class='post-body'><p>{_LONG}</p><p>{_LONG}</p></div><div class='comments'><p>{_LONG}</p></div></main>", f"Title\n\n{_P}\n\n{_P}"),
        (f"<body><div id=menu><ul><li><a href=1>one</a><li><a href=2>two</a></ul></div><div id=wrap><div class=text><p>{_LONG}</p><p>{_LONG}</p><p>{_LONG}</div><div class='side-bar'><a href=x>more links here</a> <a href=y>even more links</a></div></div><div class='cookie-notice'>{_LONG}</div>", f"{_P}\n\n{_P}\n\n{_P}"),
        (f"<article><p>{_LONG}</p><form><p>{_LONG}</p></form><aside>{_LONG}</aside><!-- {_LONG} --><div class=advert>{_LONG}</div><ul><li>x<li>y</ul></article>", f"{_P}\n\nx\n\ny"),
        (f"<article><p>{_LONG}<div style='display: none'>{_LONG}</div><p hidden>{_LONG}</p><p>&lt;b&gt; &#233;</p></article><!-- never closed <p>x", f"{_P}\n\n<b> é"),
        (f"<article><p title='a > b'>{_LONG}</p><table><tr><td>1<td>2</table></article>", f"{_P}\n\n1\n\n2"),
    ],
)
def test_pages(html, want):
    assert maintext.main_text(html) == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f"<main><article><h2>One</h2><p>{_LONG}</p><p>{_LONG}</p><p>{_LONG}</p></article><article><h2>Two</h2><p>{_LONG}</p><p>{_LONG}</p></article></main>", ["One", _P, _P, _P, "Two", _P, _P]),
        (f"<body><article><p>{_LONG}</p><p>{_LONG}</p></article><div><p>{_LONG}</p><p>{_LONG}</p></div><p><a href=x>more</a></p></body>", [_P, _P, _P, _P]),
        (f"<body><article><h1>All</h1><article><p>{_LONG}</p><p>{_LONG}</p></article><article><p>{_LONG}</p><p>short</p></article></article></body>", ["All", _P, _P, _P, "short"]),
    ],
)
def test_articles_do_not_end_the_choice(html, want):
    assert maintext.main_text(html).split("\n\n") == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f"<body><div class='layout has-sidebar'><p>{_LONG}</p><p>{_LONG}</p></div></body>", [_P, _P]),
        (f"<body><form id=aspnetForm><input name=x><h1>Head</h1><p>{_LONG}</p><p>{_LONG}</p><label>mail</label></form></body>", ["Head", _P, _P]),
        (f"<body><form><fieldset><article><h1>Head</h1><p>{_LONG}</p></article><div class=sidebar>{_LONG}</div></fieldset></form></body>", ["Head", _P]),
        (f"<article><p>{_LONG}</p><section id='discussion'><h2 id='related-work'>Related</h2><p>{_LONG}</p></section><div class='post category-social'><p>{_LONG}</p></div></article>", [_P, "Related", _P, _P]),
        (f"<article><p>{_LONG}</p><p>{_LONG}</p><h2 class=notice>Notice</h2><div class='section' id=comments><p>{_LONG}</p></div></article>", [_P, _P, "Notice", _P]),
        (f"<body><div class=sidebar><p>{_LONG}</p><p>{_LONG}</p></div><div class=main>x</div></body>", [_P, _P]),
        (f"<body><div class=widget><p>{_LONG}</p></div><div class=widget><p>{_LONG}</p></div></body>", [_P, _P]),
        (f"<main><article class='post comment-open'><p>{_LONG}</p></article><article class='comment-body'><p>{_LONG}</p></article></main>", [_P]),
        (f"<article><p>a <span class=ad>buy</span>b {_LONG}</p><p>{_LONG}</p><div class='sidebarBox'>{_LONG}</div></article>", [f"a b {_P}", _P]),
    ],
)
def test_marks_do_not_take_the_text(html, want):
    assert maintext.main_text(html).split("\n\n") == want


def test_link_lists_inside_an_article_must_pass_by_density():
    links = "".join(f"<a href={i}>some link {i}</a> " for i in range(50))
    for page in (f"<article><h1>Head</h1><p>{_LONG}</p><div>{links}</div><p>{_LONG}</p><p>see <a href=x>this</a></p></article>", f"<main><h1>Head</h1><p>{_LONG}</p><p>{_LONG}</p><ul><li>{links}</ul><p>see <a href=x>this</a></p></main>"):
        assert maintext.main_text(page).split("\n\n") == ["Head", _P, _P, "see this"]
    few = f"<article><p>{_LONG}</p><ul><li><a href=1>first source</a><li><a href=2>second source</a></ul></article>"
    assert maintext.main_text(few).split("\n\n") == [_P, "first source", "second source"]


@pytest.mark.parametrize("name", ["reader-thoughts", "reader-comments", "userComments", "visitor_reactions"])
def test_comments_by_other_names(name):
    assert maintext.main_text(f"<body><div><h1>Head</h1><p>{_LONG}</p><p>{_LONG}</p></div><div class='{name}'><p>{_P}</p></div></body>").split("\n\n") == ["Head", _P, _P]


def test_bad_pages_end():
    for html in ("<" * 50000, "<div>" * 30000 + "x", "<p " + "a='b" * 20000, "<b>" * 20000 + "<p>" * 20000, "<!--" * 20000, "</div>" * 20000, "<script>" + "x" * 10000):
        assert isinstance(maintext.main_text(html), str)


def test_columns(spark, docs_of):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>", 7), (1, "u", "<p>a</p>", 7), (2, None, None, 8)], "page_id long, url string, html string, n_chars int")
    got = maintext.extract(pages).collect()
    assert [(r.page_id, r.text, r.n_chars) for r in got] == [(1, "a", 1), (1, "a", 1), (2, "", 0)]
    assert maintext.extract(pages.limit(0).withColumn("text", F.lit(1))).count() == 0


class _Tree(HTMLParser):
    """An independent tree of well-formed pages: nodes [tag, parent, own characters, own link characters, children]."""

    def __init__(self, html):
        super().__init__()
        self.nodes, self.open, self.texts = [["#root", None, 0, 0, []]], [0], []
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        self.nodes.append([tag, self.open[-1], 0, 0, []])
        self.nodes[self.open[-1]][4].append(len(self.nodes) - 1)
        self.open.append(len(self.nodes) - 1)

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        n = len(data.replace(" ", ""))
        self.nodes[self.open[-1]][2] += n
        if any(self.nodes[i][0] == "a" for i in self.open):
            self.nodes[self.open[-1]][3] += n
        self.texts.append((self.open[-1], data))

    def below(self, i):
        return [i] + [k for c in self.nodes[i][4] for k in self.below(c)]

    def density(self, i):
        under = self.below(i)
        body = self.below(next(k for k, n in enumerate(self.nodes) if n[0] == "body"))
        total = lambda part, at: sum(self.nodes[k][at] for k in part)
        chars, links = total(under, 2), total(under, 3)
        tags, link_tags = len(under) - 1, sum(self.nodes[k][0] == "a" for k in under[1:])
        if not chars:
            return 0.0
        inner = chars / (chars - links or 1) * links + total(body, 3) / (total(body, 2) or 1) * chars + math.e
        value = chars / (links or 1) * (tags or 1) / (link_tags or 1)
        if value <= 1 or inner <= math.e:
            return 0.0 if links else chars / (tags or 1)  # no logarithm to that base
        return chars / (tags or 1) * max(0.0, math.log(value, math.log(inner)))


def _random_page(rnd):
    def part(depth):
        kind = rnd.random()
        words = " ".join(rnd.choice(["word", "longer", "a", "density"]) for _ in range(rnd.randint(1, 30)))
        if depth > 4 or kind < 0.35:
            return f"<p>{words}</p>"
        if kind < 0.5:
            return f"<div><a>{words[:25]}</a> <a>{words[:9]}</a></div>"
        if kind < 0.6:
            return f"<p>{words} <a>{words[:12]}</a> <span>{words[:30]}</span></p>"
        return "<div>" + "".join(part(depth + 1) for _ in range(rnd.randint(1, 4))) + "</div>"

    return f"<html><body>{''.join(part(0) for _ in range(rnd.randint(1, 6)))}</body></html>"


def test_densities_sums_and_threshold_equal_an_independent_version():
    rnd = random.Random(17)
    for _ in range(120):
        html = _random_page(rnd)
        tree, page = _Tree(html), maintext._Page(html)
        want = [tree.density(i) for i in range(len(tree.nodes))]
        assert page.tags == [n[0] for n in tree.nodes] and page.densities() == pytest.approx(want)
        sums = [sum(want[c] for c in n[4]) if n[4] else want[i] for i, n in enumerate(tree.nodes)]
        best = max(range(len(sums)), key=lambda i: (sums[i], -i))
        path, i = [], best
        while i is not None and tree.nodes[i][0] != "#root":
            path.append(i)
            i = tree.nodes[i][1]
        least = min(want[i] for i in path) if path else want[best]
        taken = set()
        for i, n in enumerate(want):
            if n >= least and n > 0:
                taken |= set(tree.below(max(tree.below(i), key=lambda k: (sums[k], -k))))
        inline = lambda i: i if tree.nodes[i][0] not in ("a", "span") else inline(tree.nodes[i][1])
        lines = {}
        for node, text in tree.texts:
            lines.setdefault(inline(node), []).append((node, text))
        expected = [" ".join("".join(t for _, t in parts).split()) for _, parts in sorted(lines.items()) if parts[0][0] in taken]
        assert maintext.main_text(html).split("\n\n") == [e for e in expected if e]
