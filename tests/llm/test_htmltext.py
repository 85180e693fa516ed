import random
import time

import numpy as np
import pytest

from plumbline.llm import htmltext
from plumbline.llm.htmltext import content_lines, extract, main_text, smoothed

P = "A paragraph of the article that is long enough to be seen as text, " * 3


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}<style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (page(f"{NAV}<div class='ad'>Buy now</div><article><h1>Title</h1><p>{P}</p><p>x.</p></article><footer>&copy; me</footer>"), f"Title\n{P.strip()}\nx."),
        (page(f"{NAV}<article><h1>T&amp;T</h1><p><b>Open {P}<br><p>Next&nbsp;&eacute; &#x41;</p></article><footer>f"), f"T&T\nOpen {P.strip()}\nNext é A"),
        (page(f"<header>Site</header><main><p>{P}</p><aside>Side</aside><form><p>Mail: {P}</p></form><p>End</p></main><div id='comments'><p>{P}</p></div>"), f"{P.strip()}\nEnd"),
        (page(f"<div id='cookie-notice'>{P}</div><div class='content'><p>{P}</p><p>Short.</p></div><div class='sidebar'>{P}</div>"), f"{P.strip()}\nShort."),
        (page(f"<article>a  b\n\tc<br>d<p>{P}</p>tail</article>"), f"a b c d\n{P.strip()}\ntail"),
        (page(f"<article><p>{P}</p><table><tr><td>c1<td>c2</tr></table><ul><li>i1<li>i2</ul></article>"), f"{P.strip()}\nc1\nc2\ni1\ni2"),
        (page(f"<article><p>{P}</p><section class='comments'><article><p>{P}</p></article></section></article>"), P.strip()),
        (f"<article><p>{P} cut off &am", f"{P.strip()} cut off &am"),
        ("", ""),
        ("no markup at all", "no markup at all"),
        (page(NAV), ""),
        ("<<<>>> &&& <p", "<<<>>> &&&"),
    ],
)
def test_articles(html, text):
    assert extract(html) == text


def test_no_paragraph_is_dropped_for_being_short():
    body = "".join(f"<p>{'w ' * n}</p>" for n in (1, 400, 1, 1, 1, 1, 1, 1, 1, 300, 2))
    assert extract(page(f"<article>{body}</article>")).count("\n") == 10


@pytest.mark.parametrize("closing", ["<div>{}</div>", "<section><div>{}</div></section>", "<table><tr><td>{}</td></tr></table>"])
def test_content_outside_the_largest_block_is_kept(closing):
    first, last = [f"{i} {P}".strip() for i in range(10)], [f"end {i} {P}".strip() for i in range(2)]
    body = f"{NAV}<div>{''.join(f'<p>{t}</p>' for t in first)}</div>" + closing.format("".join(f"<p>{t}</p>" for t in last)) + "<footer>f</footer>"
    assert extract(page(body)) == "\n".join(first + last)


def test_smoothing_keeps_the_sum_inside():
    x = np.zeros(21)
    x[10] = 1
    assert smoothed(x).sum() == pytest.approx(1) and smoothed(x).argmax() == 10
    assert smoothed(np.ones(5)) == pytest.approx(np.ones(5))
    assert content_lines([("a" * 200, 1, None), ("b", 4, None), ("c", 4, None), ("d", 4, None), ("e", 4, None)]).tolist()[0]


def test_very_deep_and_long_pages():
    assert extract("<div>" * 3000 + "<p>" + P + "</p>") == P.strip()
    assert extract("<article>" + "<p>word</p>" * 20_000 + "</article>").count("word") == 20_000


@pytest.mark.parametrize(
    "html",
    [
        f"<div class='page no-sidebar'><article><p>{P}</p></article></div>",
        f"<article class='ad-free post'><p>{P}</p></article>",
        f"<article class='post comment-enabled'><p>{P}</p></article>",
        f"<div id='search-content'><p>{P}</p></div>",
        f"<div class='widget'><p>{P}</p></div>",
        f"<b><div><p>{P}</b></p></div>",
    ],
)
def test_no_word_takes_out_the_article(html):
    assert extract(page(html)) == P.strip()


def test_comments_of_any_size_go():
    comments = "".join(f"<article class='comment'><p>{P}</p></article>" for _ in range(9))
    assert extract(page(f"<article><p>{P}</p></article><div class='comment-list'>{comments}</div>")) == P.strip()
    assert extract(page(f"<div class='story'><p>{P}</p></div><div class='comments'>{comments.replace('article', 'div')}</div>")) == P.strip()


MENU = "<div>" + "".join(f"<div><a href='/{i}'><b>Go {i}</b></a></div>" for i in range(12)) + "</div>"


def test_ratios_decide(monkeypatch):
    """On a page without article, main or telling names, what is kept is where the text-to-tag ratio is high."""
    html = page(f"{MENU}<div><h1>Title</h1><p>{P}</p><p>Short.</p><p>{P}</p><p>End</p></div>{MENU}")
    assert extract(html) == f"Title\n{P.strip()}\nShort.\n{P.strip()}\nEnd"
    monkeypatch.setattr(htmltext, "content_lines", lambda lines: ~content_lines(lines))
    turned = extract(html)
    assert "Go 3" in turned and P.strip() not in turned
    monkeypatch.setattr(htmltext, "content_lines", lambda lines: np.ones(len(lines), bool))
    assert "Go 3" in extract(html) and P.strip() in extract(html)


def ancestors(e):
    out = []
    while e is not None:
        out.append(e)
        e = e.parent
    return out


def brute_extract(html):
    """The rules of the docstrings, each by looking at all lines and all ancestors again."""
    parsed = htmltext.Lines()
    parsed.feed(html)
    parsed.close()
    parsed.flush()
    lines = [(t, n, ancestors(e)) for t, n, e in parsed.lines]
    if not lines:
        return ""
    ratio = [len(t) / max(1, n) for t, n, _ in lines]
    mean = sum(ratio) / len(ratio)
    weight = lambda d: np.exp(-0.5 * d * d) if abs(d) <= 3 else 0
    smooth = [sum(weight(i - j) * r for j, r in enumerate(ratio)) / sum(weight(i - j) for j in range(len(ratio))) for i in range(len(ratio))]
    limit = min((sum((r - mean) ** 2 for r in ratio) / len(ratio)) ** 0.5, max(smooth))
    good = [s >= limit - 1e-9 for s in smooth]
    holds = lambda e: sum(len(t) for (t, _, up), g in zip(lines, good, strict=True) if g and e in up and not up[0].out)
    tops = [e for e in parsed.elements if e.tag in ("article", "main") and not any(x.tag in ("article", "main") for x in ancestors(e)[1:]) and holds(e)]
    own = [e for e in tops if not any(x.whole & htmltext.READERS for x in ancestors(e))]
    best = max(own or tops, key=holds, default=None)
    ways = ancestors(best)
    total = holds(parsed.elements[0])

    def taken(e):
        if not e.names or e in ways:
            return False
        if e.names & htmltext.READERS and e.tag not in ("article", "main"):
            return bool(ways) or holds(e) < total
        if e.whole:
            return bool(ways) or 2 * holds(e) <= total
        return 2 * holds(e) <= total and not (e.tag in ("article", "main") and holds(e))

    def home(up):
        tops = [e for e in up if e.tag in ("article", "main")]
        if tops:
            return tops[-1]
        several = lambda e: e.tag in ("td", "th") and sum(e in x[2] and not any(c.tag in ("td", "th") for c in x[2][: x[2].index(e)]) for x in lines) > 1
        return next(e for e in up if e.parent is None or e.tag in htmltext.CONTAINERS or several(e))

    kept = [not up[0].out and not any(taken(e) for e in up) for _, _, up in lines]
    chosen = [home(up) for (_, _, up), g, k in zip(lines, good, kept, strict=True) if g and k]
    return "\n".join(t for (t, _, up), k in zip(lines, kept, strict=True) if k and home(up) in chosen)


def made_up(g, depth=0):
    tags = ["div", "p", "section", "article", "main", "ul", "li", "table", "tr", "td", "nav", "aside", "footer", "header", "span", "b", "h1", "form"]
    names = ["", "", "", " class='ad'", " class='page no-sidebar'", " id='comments'", " class='comment-list'", " class='story'", " role='search'", " hidden"]
    out = []
    for _ in range(g.randint(1, 4)):
        if depth > 4 or g.random() < 0.4:
            out.append(" ".join(["word"] * g.choice([1, 2, 5, 30, 80])) + g.choice(["", "<br>", "<img>", "<a>x</a>"]))
        else:
            tag = g.choice(tags)
            out.append(f"<{tag}{g.choice(names)}>{made_up(g, depth + 1)}" + (f"</{tag}>" if g.random() < 0.85 else g.choice(["", "</i>", "</div>"])))
    return "".join(out)


def test_like_brute_force():
    g = random.Random(6)
    some = 0
    for _ in range(1500):
        html = made_up(g)
        got = extract(html)
        assert got == brute_extract(html), html
        some += bool(got)
    assert some > 700


@pytest.mark.parametrize("unit", ["<span>x</i>", "<div>", "<div>x</i>", "<p><b>x", "<table><tr><td>x", "<li>x", "<ul><li>x</b>", "&", "<", "<!--", "<a class='x y'"])
def test_time_is_linear(unit):
    n = 120_000 // len(unit)
    extract(unit * 100)
    began = time.process_time()
    extract(unit * n)
    extract(unit * n + "<p>x</p>")
    assert time.process_time() - began < 5


def test_table(spark):
    rows = [(1, "u", page(f"<article><p>{P}</p></article>")), (2, None, None), (None, "u3", ""), (1, "u", "<p>x</p>")]
    got = main_text(spark.createDataFrame(rows, "page_id int, url string, html string"), keep=("url",)).collect()
    assert sorted((str(r["page_id"]), str(r["url"]), r["text"]) for r in got) == sorted([("1", "u", P.strip()), ("2", "None", ""), ("None", "u3", ""), ("1", "u", "x")])
    assert main_text(spark.createDataFrame([], "page_id int, html string")).count() == 0
    assert main_text(spark.createDataFrame([(1, "<p>a</p>", "t")], "page_id int, html string, text string"), keep=("text", "page_id")).columns == ["page_id", "text_in", "page_id_in", "text"]
