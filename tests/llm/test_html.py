"""Main text of pages: the driver's pages against a plain extractor, and wrappers, comments and lists that a name must not decide."""

import html
import re
import time

import pandas as pd
import pytest

from controlspark.llm.html_extract import extract, extract_pages

PROSE = "<p>" + "Some prose, with commas, and enough words to count as a paragraph of text. " * 4 + "</p>"
TEXT = " ".join(PROSE[3:-4].split())


def article_only(page):
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1].replace("<br>", " ")
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:h1|p)>", inside))
    return "\n\n".join(b for b in blocks if b)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_equals_a_plain_extractor(sf):
    for page in pd.read_parquet(f"/root/testdata/{sf}/pages.parquet").html:
        assert extract(page) == article_only(page)


@pytest.mark.parametrize(
    "wrapper",
    ['<div class="layout has-sidebar">', '<div id="page" class="site no-header">', '<div class="wrap search-results-page">', '<div class="content-with-sidebar">', "<form>", "<header>", '<div class="sidebar">', "<div>"],
)
def test_a_name_does_not_erase_most_of_the_prose(wrapper):
    end = f"</{wrapper[1:].split()[0].rstrip('>')}>"
    page = f"<body><nav><a href=a>Menu</a></nav>{wrapper}{PROSE * 3}{end}<footer>c</footer></body>"
    assert extract(page) == "\n\n".join([TEXT] * 3)
    page = f"<body>{wrapper}<article><h1>Short</h1><p>Be.</p></article>{end}<div class=ad>An advert that is longer than the article, by far.</div></body>"
    assert extract(page) == "Short\n\nBe."


@pytest.mark.parametrize(
    ("inside", "after"),
    [
        ('<article class="comment"><p>Nice text, my friend, indeed yes, so good, it is.</p></article>', ""),
        ("", '<div id="comments">' + '<div class="comment-body"><p>I like, as others, what is said here, and more, much more.</p></div>' * 40 + "</div>"),
        ("", '<div class="related"><article class="teaser"><p>Read this, too, please, now, ok.</p></article></div>'),
        ('<aside><div class="content"><p>Aside content, here, and more.</p></div></aside>', ""),
        ('<div class="adSlot">Buy this.</div><form><label>Mail</label><input></form>', '<div class="cookie-banner"><p>We use cookies, all, of, them.</p></div>'),
        ('<p hidden>Not seen, at, all.</p><div style="display: none">Nor this.</div>', "<script>var a = '<p>no</p>';</script><noscript><p>no</p></noscript>"),
    ],
)
def test_furniture_goes(inside, after):
    assert extract(f"<body><article><h1>T</h1>{PROSE}{inside}{PROSE}</article>{after}</body>") == "\n\n".join(["T", TEXT, TEXT])


def test_article_content_stays():
    rest = '<div class="note"><p>Keep it.</p></div><h2>Sources</h2><ul><li><a href=x>One</a></li><li><a href=y>Two</a></li><li><a href=z>Three</a></li></ul><table><tr><th>a<td><a href=q>link</a><tr><td>b<td><a href=r>more</a></table>'
    want = [TEXT, "Keep it.", "Sources", "One", "Two", "Three", "a", "link", "b", "more"]
    for tag in ("article", "div"):
        assert extract(f"<body><{tag}>{PROSE}{rest}</{tag}></body>").split("\n\n") == want


def test_menu_without_names_goes():
    menu = "<ul>" + "<li><a href=x>Home</a></li>" * 5 + "</ul>"
    assert extract(f"<body><div>{menu}{PROSE}{PROSE}</div></body>") == f"{TEXT}\n\n{TEXT}"


def test_parts_of_an_article_stay_together():
    section = f"<section><h2>S</h2>{PROSE}</section>"
    assert extract(f"<body><article>{section * 3}<section><p>Last.</p></section></article></body>") == "\n\n".join(["S", TEXT] * 3 + ["Last."])


def test_characters_and_white_space():
    assert extract("<article><p>a&nbsp;&lt;b&gt;\n\t c &eacute;&#8364; x&#x41;</p><p> </p><p>d<br>e<i>f</i></p></article>") == "a <b> c é€ xA\n\nd ef"
    assert [extract(x) for x in (None, "", " ", "<", "<p", "<script>x", "</p></div>", "<!-- x")] == ["", "", "", "<", "", "", "", ""]


def test_time_is_linear():
    pages = {n: ["<div>" + "<b>" * n + "x" * 50 + "<p>y" * 1000, "<b><i>" * n + "text</i>" * n, "<div>" * n + "text</div>" * n, "<a \"'" * n, "<li>x" * n, "<td>" * n] for n in (12_500, 100_000)}
    for short, long in zip(pages[12_500], pages[100_000], strict=True):
        took = []
        for page in (short, long):
            began = time.perf_counter()
            extract(page)
            took.append(time.perf_counter() - began)
        assert took[1] < 30 * took[0] + 1  # a square would be 64


def test_rows(spark):
    rows = [(1, "u", f"<article>{PROSE}</article>", 5), (1, "u", None, None), (None, None, "", 1), (2, "v", "<p>" + "long word, " * 300_000, 1)]
    got = extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string, n_chars int")).collect()
    assert [(r.page_id, r.url, r.n_chars) for r in got] == [(1, "u", len(TEXT)), (1, "u", 0), (None, None, 0), (2, "v", 3_299_999)]
    assert got[0].text == TEXT
