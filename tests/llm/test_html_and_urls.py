import re
import time

import pytest

from strandline.llm import html_text as H
from strandline.llm import url_filter as U
from strandline.llm.queries import ORACLES, QUERIES
from tests.conftest import SF, oracle, rows

ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies on this site to serve you.</div>
<article><header><h1>Head &amp; tail</h1></header><p><b>First   long paragraph
of text.<br><p>Short.</p><ul><li>item one<li>item two</ul><table><tr><td>c1<td>c2</table><form><p>Sign up</p><input></form>
<div class="ad">Buy now</div><div class="cookiebar">Cookies</div><section class="comments"><article><p>nice post, I think</p></article></section></article>
<aside>Side bar text</aside><div id="sidebar">More</div><footer>&copy; me</footer></body></html>"""


def test_article():
    assert H.main_text(ARTICLE) == "Head & tail\nFirst long paragraph of text.\nShort.\nitem one\nitem two\nc1\nc2"


def test_without_article():
    page = '<body><div id=header>Site <a href=/>home</a></div><div class="x"><p>Hello there, a long paragraph of text.</p><p>Hi.</p></div><div><a>1</a><a>2</a></div><div class="comments"><p>nice post, really long and so on</p></div>'
    assert H.main_text(page) == "Hello there, a long paragraph of text.\nHi."


def test_elements_weigh_and_ratios_decide():
    text = [f"Paragraph {i} of the page's text, which is long enough to be what the page is about." for i in range(6)]
    paragraphs = "".join(f"<p>{t}</p>" for t in text)
    teaser = "<article><h3><a href=/x>Other news</a></h3></article>"
    assert set(text) <= set(H.main_text(f"<body><div>{paragraphs}</div><div><span><a>1</a></span><a>2</a></div>{teaser}</body>").split("\n"))
    share = "<div>" + "".join(f"<span><b><a href=/{i}><i>Share {i}</i></a></b></span><br>" for i in range(12)).replace("<br>", "</div><div>") + "</div>"
    links = "<div><ul>" + "".join(f"<li><span><a href=/{i}>To {i}</a></span></li>" for i in range(8)) + "</ul></div>"
    page = f"<body><div>Short line</div><article><div><h1>The title</h1></div>{paragraphs}{links}{share}</article></body>"
    got = H.main_text(page).split("\n")
    assert got[:7] == ["The title", *text] and "To 7" not in got and "Share 9" not in got and "Short line" not in got


@pytest.mark.parametrize(("page", "want"), [(None, ""), ("", ""), ("<p>", ""), ("a &lt; b&nbsp; c", "a < b c"), ("<article><p>cut", "cut"), ("<article>x<script>never closed", "x"), ("<p>" * 3000 + "deep", "deep")])
def test_odd_pages(page, want):
    assert H.main_text(page) == want


def test_smoothing_decides_inside_an_article(monkeypatch):
    """A short line between paragraphs is text, the same line among links is not: without smoothing both are judged alike."""
    text = [f"Paragraph {i} of the page's text, which is long enough to be what the page is about." for i in range(6)]
    line = "<section><p><b><i><u>By A. B.</u></i></b></p></section>"
    links = "".join(f"<section><p><b><a href=/{i}><i>Go {i}</i></a></b></p></section>" for i in range(9))
    page = "<article>" + "".join(f"<section><p>{t}</p></section>" for t in text[:3]) + line + "".join(f"<section><p>{t}</p></section>" for t in text[3:]) + links + "</article>"
    smoothed = H.main_text(page).split("\n")
    assert "By A. B." in smoothed and "Go 7" not in smoothed and set(text) <= set(smoothed)
    monkeypatch.setattr(H, "smooth", lambda values, sigma=0: values)
    assert "By A. B." not in H.main_text(page).split("\n")


PROSE = [f"Paragraph {i} of the page's text, which is long enough to be what the page is about, and says so." for i in range(6)]
ALL = "".join(f"<p>{t}</p>" for t in PROSE)
NAMED = {
    "whole page named": (f'<body class="sidebar-left"><nav><a>x</a></nav><main class="with-sidebar"><article>{ALL}</article></main><footer>f</footer>', PROSE),
    "page builder": (f'<body><div class="header">Site</div><div class="elementor-widget"><div class="elementor-widget-container">{ALL}</div></div></body>', PROSE),
    "discussion": (f'<article>{ALL}<section id="discussion"><p>{PROSE[0]}</p><p>{PROSE[1]}</p></section></article>', PROSE + PROSE[:2]),
    "related work": (f'<article>{ALL}<section id="related-work"><h2>Related work</h2><p>{PROSE[0]}</p></section></article>', [*PROSE, "Related work", PROSE[0]]),
    "ad-free": (f'<article><p class="ad-free">{PROSE[0]}</p>{ALL}</article>', PROSE[:1] + PROSE),
    "teaser": (f'<article><p class="teaser">A short intro to it.</p>{ALL}</article>', ["A short intro to it.", *PROSE]),
    "only comments": (f'<div class="comments">{ALL}</div>', PROSE),
    "comments below": (f'<article>{ALL}</article><div class="comments"><p>{PROSE[0]}</p><p>I like it, thanks for all of this text.</p></div><div id="sidebar">More of the same from us</div>', PROSE),
    "comments and advert inside": (f'<article>{ALL}<div class="comment-list"><p>{PROSE[0]}</p><p>I like it</p></div><p class="ad">Buy this now, it is cheap</p></article>', PROSE),
    "notice": (f'<div class="notice">We use cookies to make this site better for you and all.</div><article>{ALL}</article>', PROSE),
    "role": (f'<div role="banner">Welcome to the site of us all, it is nice</div><article>{ALL}</article>', PROSE),
    "hidden": (f'<article>{ALL}<p style="display:none">{PROSE[0]}</p></article>', PROSE + PROSE[:1]),
    "label and math": ("<article><p>Set <label>the label</label> <math><mi>x</mi></math> here, it is a long enough line of text.</p></article>", ["Set the label x here, it is a long enough line of text."]),
}


@pytest.mark.parametrize("name", NAMED)
def test_names_weigh_and_ratios_decide(name):
    page, want = NAMED[name]
    assert H.main_text(page).split("\n") == want


def test_ratios_decide_on_the_tables_pages(spark, monkeypatch):
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect()]
    texts = [H.main_text(p) for p in pages]
    monkeypatch.setattr(H, "smooth", lambda values, sigma=0: [0.0] * len(values))
    assert sum(a != H.main_text(p) for a, p in zip(texts, pages, strict=True)) > 0.9 * len(pages)  # all that makes lines is text then


def test_names_alone_drop_nothing(monkeypatch):
    """With all ratios alike the advert and the comments stay: it is the ratio that a name divides which leaves them out."""
    page, want = NAMED["comments and advert inside"]
    monkeypatch.setattr(H, "MARKS", (1.0, 1.0, 1.0))
    assert H.main_text(page).split("\n") != want
    monkeypatch.setattr(H, "WEIGHT", 1.0)
    form = f'<body><nav><ul><li><a href="/x">x</a></li></ul></nav><div class="ad">{PROSE[0]}</div><article><h1>Title</h1>{ALL}</article><footer>f</footer>'
    assert PROSE[0] == H.main_text(form).split("\n")[0]  # the form of the tables' pages, with a wordy advert
    monkeypatch.undo()
    assert H.main_text(form).split("\n") == ["Title", *PROSE]


@pytest.mark.parametrize("page", ["<span>" * 100_000 + "</b>" * 100_000, "<!--" * 100_000, "<a " * 100_000, '<a b="' * 100_000, "<ul>" + "<li>a<b><i>" * 50_000, "</" * 100_000])
def test_hostile_pages_take_linear_time(page):
    start = time.perf_counter()
    H.main_text(page)
    assert time.perf_counter() - start < 10


def test_implied_ends_at_any_depth():
    for depth in (2, 9, 300):
        assert H.main_text('<article><ul><li class="ad">buy' + "<i>" * depth + "<li>real item</ul></article>") == "real item"


def test_odd_rows_of_pages(spark):
    rows = [(1, "u", "<p>one text", 7, "x"), (1, "u", "<p>one text", 7, "x"), (None, None, None, 8, "y"), (3, "v", "", 9, "z"), (2**60 + 1, "w", "<p>" + "long " * 50_000, 1, "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string")
    got = H.extract(pages)
    assert got.columns == ["id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.select("id", "n_chars").collect()), key=str) == sorted([(1, 8), (1, 8), (None, 0), (3, 0), (2**60 + 1, 249_999)], key=str)
    assert H.extract(pages.where("false")).count() == 0


def test_real_pages(spark):
    for r in QUERIES["op5_html_main_text"](spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = r.html[r.html.index("<article>") :].split("</article>")[0]
        import html

        blocks = [html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))) for b in re.split("</?(?:p|h1|article)>", inner)]
        want = "\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)
        assert (r.text, r.n_chars) == (want, len(want))


def test_smoothing_keeps_constants():
    assert H.smooth([2.0] * 5) == pytest.approx([2.0] * 5) and H.smooth([]) == []


def test_rules(spark):
    urls = ["https://a.example.net/en/1", "http://x.net/y", "http://net", "http://net/", "HTTP://B.EXAMPLE.com/de/x?q", "http://example.comx/de/", "http://a.org/fr/", "no url", None, "x://spam.io/", "http://a.io/cheap-loans", "http://a.io/spammer", "http://a.io/free"]
    pages = spark.createDataFrame([(i, u, 1, "h") for i, u in enumerate(urls)], "page_id int, url string, id int, host string")
    got = [(r.rule, r.verdict) for r in U.url_verdicts(pages).orderBy("id").collect()]
    assert got == [("example.net/en/", "allow"), ("net/", "block"), (None, "allow"), ("net/", "block"), ("example.com/de/", "block"), (None, "allow"), ("org/fr/", "allow"), (None, "allow"), (None, "allow"), (None, "block"), (None, "block"), (None, "allow"), (None, "allow")]
    assert U.url_verdicts(pages.where("false")).count() == 0
    assert U.url_verdicts(pages, rules=[], strict=[], soft=[]).where("verdict = 'block'").count() == 0


def test_url_query_matches_sql(spark):
    assert rows(QUERIES["op8_url_filter"](spark, SF)) == oracle("op8_url_filter", ORACLES["op8_url_filter"], SF)


@pytest.mark.parametrize("name", ["op1_mix_to_target_weights", "op10_exact_dedup"])
def test_other_oracles(spark, name):
    assert rows(QUERIES[name](spark, SF)) == oracle(name, ORACLES[name], SF)
