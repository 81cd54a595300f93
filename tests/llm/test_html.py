import re
import time
from html import unescape

import numpy as np
import pytest

from linkweave.llm import html
from linkweave.llm.html import main_text

LONG = "A sentence that is long enough to stand for the body of an article, with some words more."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("<nav><ul><li><a href=x>menu</a></ul></nav>", ""),
        (f"<p>{LONG}</p>", LONG),
        (f"<p>{LONG}<p>Short.<p>{LONG}", f"{LONG}\n\nShort.\n\n{LONG}"),
        ("<article><h1>T &amp;  t</h1><p>a<b>b</b>\n c</article><footer>f</footer>", "T & t\n\nab c"),
        ("<article>one</article><div>between</div><article>two</article>", "one\n\ntwo"),
        ("<main><p>x</p><aside>side</aside><form>f</form><div class='comments'><p>reader</p></div><p>y</p></main>", "x\n\ny"),
        (f"<div class='cookie-notice'>{LONG}</div><div class=sidebar>{LONG}</div><div id=main><p>{LONG}</p></div><div class=AdSlot>{LONG}</div>", LONG),
        (f"<div class='layout has-sidebar'><p>{LONG}</p></div>", LONG),
        (f"<script>if (a < b) document.write('<p>{LONG}</p>')</script><style>p {{}}</style><p>{LONG}</p>", LONG),
        ("<article><p>never closed &lt;b&gt; &#228; &eacute &#x1F600;", "never closed <b> ä é 😀"),
        ("<article><p>a <!-- hidden > --> b <3 c</article>", "a b <3 c"),
        ("<article><p>t<script>never closed <p>x", "t"),
        ("<article><p title='a>b' data-x=\"</article>\">t</p></article>", "t"),
        ("<ARTICLE><P>one<BR>two<br/>three</P></ARTICLE>", "one\n\ntwo\n\nthree"),
    ],
)
def test_cases(page, text):
    assert main_text(page) == text


def test_surge_and_dive():
    keep = html.between(np.array([5, 0, 0, 100, 3, 80, 0, 0, 0, 0, 4]), 3, 40)
    assert keep.tolist() == [False] * 3 + [True] * 3 + [False] * 5
    assert html.between(np.array([], np.int64)).tolist() == []


def test_links_are_no_text():
    menu = "".join(f"<li><a href=/{i}>an entry of a long menu {i}</a></li>" for i in range(30))
    assert main_text(f"<ul>{menu}</ul><div><p>{LONG}</p><p>{LONG}</p></div><ul>{menu}</ul>") == f"{LONG}\n\n{LONG}"


def test_query_equals_brute_force_on_generated_pages(spark):
    """The generated pages mark their article, so a regular expression can cut it out."""
    path = "/root/testdata/sf0.001"
    pages = {r.page_id: r for r in spark.read.parquet(f"{path}/pages.parquet").collect()}
    rows = html.query(spark, path).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:h1|p|br)>", article)]
        assert r.text == "\n\n".join(filter(None, blocks)) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_nulls_repeated_rows_empty_table_clashing_names(spark):
    df = spark.createDataFrame([(1, None, "old"), (1, f"<p>{LONG}", None), (1, f"<p>{LONG}", None)], "page_id long, html string, text string")
    assert sorted(r.text for r in html.extract(df).collect()) == ["", LONG, LONG]
    assert html.extract(df.limit(0)).collect() == []
    assert main_text("<p>" + "x " * 500_000).count("x") == 500_000
    assert main_text("<" * 20_000) in ("", "<" * 20_000)


def test_marked_teasers_do_not_hide_an_unmarked_main_text():
    teasers = "".join(f"<article><h2><a href=/{i}>Teaser {i}</a></h2><p>More soon.</p></article>" for i in range(12))
    body = "\n\n".join([LONG, "Short.", LONG])
    assert main_text(f"{teasers}<div><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div>") == body
    assert main_text(f"<div><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div>{teasers}").startswith(body)
    # a marked article with more text than any unmarked surge is the main text, its short lines and links with it
    article = f"<article><h1>T</h1><p>{LONG}<p>x<p>{LONG}<p>{LONG}<p><a href=y>y</a></article>"
    assert main_text(f"<div><p>{LONG}</p></div>{article}<div><p>{LONG}</p></div>") == "\n\n".join(["T", LONG, "x", LONG, LONG, "y"])


ITEMS = [f"item no {k:02d}" for k in range(12)]
CELLS = "".join(f"<tr><td>{k}<td>{k * k}" for k in range(9))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # a list between two paragraphs, in the body and with a container for each part
        (f"<p>{LONG}<ul>{''.join(f'<li>{x}' for x in ITEMS)}</ul><p>{LONG}", [LONG, *ITEMS, LONG]),
        (f"<div><p>{LONG}</div><div>{'<br>'.join(ITEMS)}</div><div><p>{LONG}</div>", [LONG, *ITEMS, LONG]),
        # at the text's ends, in the container of a surge
        (f"<p>other</p><div><h1>T</h1><ul>{''.join(f'<li>{x}' for x in ITEMS)}</ul><p>{LONG}<table>{CELLS}</table></div><p>other</p>", ["T", *ITEMS, LONG, *(str(x) for k in range(9) for x in (k, k * k))]),
        # no window reaches the threshold: the densest block with its container
        ("<p>A note.</p>", ["A note."]),
        (f"<p>x</p><div>{'<br>'.join(ITEMS)}</div><p>y</p>", ITEMS),
        (f"<div>{''.join(f'<div>{x}</div>' for x in ITEMS)}</div><p>y</p>", ITEMS),
        ("<ul><li><a href=x>only a link</a></ul>", []),
        (f"<ul>{''.join(f'<li><a href=x>{x}</a>' for x in ITEMS)}</ul><div>Short.</div>", ["Short."]),
    ],
)
def test_short_lines_of_unmarked_pages(page, text):
    assert main_text(page) == "\n\n".join(text)


SHORT = ["Rain.", "Then sun.", "Wind came.", "It fell.", "Night."]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # a title in the header of the article; the site's header and a header's other lines are left out
        (f"<header><h1>Site</h1></header><article><header><h1>T</h1><p>by me</header><p>{LONG}</article>", ["T", LONG]),
        # names that would delete the whole text
        (f"<form id=aspnetForm><header><h1>Site</h1></header><nav><a href=x>menu</a></nav><div><p>{LONG}<p>{LONG}</div><footer>{LONG}</footer></form>", [LONG, LONG]),
        (f"<div id=top>Site name</div>{'<div><a href=x>menu</a></div>' * 3}<div class='content-sidebar-wrap'><p>{LONG}<p>{LONG}</div><div class=sidebar><p>{LONG}</div>", [LONG, LONG]),
        (f"<div class='content-sidebar-wrap'><div class=content><p>{LONG}<p>{LONG}</div><div class=sidebar>{LONG}</div></div>", [LONG, LONG]),
        (f"<article class='post related-category'><p>{LONG}</article>", [LONG]),
        (f"<article class='skip-lazy'><p>{LONG}</article><p>{LONG[:50]}", [LONG]),
        (f"<h1>Site</h1><nav><ul>{'<li><a href=x>menu</a>' * 3}</ul><article><h1>T</h1><p>{LONG}<p>{LONG}</article>", ["T", LONG, LONG]),
        (f"<div class=page-header-wrap><main><p>{LONG}<p>{LONG}</main></div><p>{LONG[:60]}", [LONG, LONG]),
        # what stays out even if it is the longest, or the only, text
        (f"<p>A note.</p><footer><p>{LONG}<p>{LONG}</footer>", ["A note."]),
        (f"<article><p>A note.</article><section id=comments><article><p>{LONG}</article><article><p>{LONG}</article></section>", ["A note."]),
        (f"<div class=cookie-notice>{LONG}</div>", []),
        (f"<footer>{LONG}</footer>", []),
        (f"<header><h1>Site</h1></header><nav>{LONG}</nav>", []),
        # readers' comments and teasers in articles of their own
        (f"<article><p>{LONG}<p>{LONG}<p>{LONG}<article><p>{LONG[:60]}</article><article><p>Me too.</article></article>", [LONG, LONG, LONG]),
        (f"<main><article><h1>T</h1><p>{LONG}<p>{LONG}</article><article><h2><a href=x>Another text</a></h2><p>{LONG}</article></main>", ["T", LONG, LONG]),
        (f"<main><h1>Title</h1><article><p>{LONG}<p>{LONG}</article></main>", ["Title", LONG, LONG]),
        (f"<article><p>{LONG}<p>{LONG}</article><article><p>{LONG}</article>", [LONG, LONG, LONG]),
        # short articles and short ends without a mark
        (f"<div>{''.join(f'<p>{x}' for x in SHORT)}</div><footer>© all rights reserved</footer>", SHORT),
        (f"<div><p>{LONG}{''.join(f'<p>{x}' for x in SHORT)}</div><div class=share>Share it</div>", [LONG, *SHORT]),
    ],
)
def test_names_and_marks_are_evidence_only(page, text):
    assert main_text(page) == "\n\n".join(text)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # a bad name around the only article
        (f"<div id=notice><article><h1>T</h1><p>{LONG}</article></div>", ["T", LONG]),
        (f"<div class='consent-essay'><article><p>{LONG}<p>{LONG}</article></div><div class=cookie-notice>{LONG}</div>", [LONG, LONG]),
        # words on blocks of text, labels
        (f"<article><p>{LONG}<p class=reply>He said so.<p class=share-price>9 euros<p><label>A label</label> in it</article>", [LONG, "He said so.", "9 euros", "A label in it"]),
        (f"<article><p>{LONG}<p class=advert>Buy now.<form><label>Name</label></form></article>", [LONG]),
        # a title right before the mark, but no site's name before a titled one
        (f"<h1>Title</h1><article><p>{LONG}</article>", ["Title", LONG]),
        (f"<h1>Site</h1><article><h1>T</h1><p>{LONG}</article>", ["T", LONG]),
        # readers' comments and the line of rights
        (f"<article><p>{LONG}<div id=reactions><p>{LONG}</div></article>", [LONG]),
        (f"<div><p>{LONG}<p>{LONG}</div><div>© 2024 All of us, and all rights reserved here</div>", [LONG, LONG]),
    ],
)
def test_names_around_and_inside_the_article(page, text):
    assert main_text(page) == "\n\n".join(text)


@pytest.mark.parametrize("page", ["<div class=promo>" * 3000 + f"<p>{LONG}", f"<div class=promo><p>x" * 3000 + f"<p>{LONG}", f"<div class=promo>x</div>" * 3000, f"<div class=comments><article>x" * 1500])
def test_thousands_of_named_elements_end_in_time(page):
    start = time.time()
    main_text(page)
    assert time.time() - start < 2


def test_many_unclosed_elements_end_in_time():
    assert main_text("<div class=sidebar>" * 300 + f"<p>{LONG}") == LONG
    assert main_text("<nav><article>" * 200 + "x") == "x"


def test_unmarked_pages_equal_brute_force():
    """Pages of random blocks between menus and footers, without a mark: all blocks of the text's container and nothing else."""
    import random

    r = random.Random(8)
    for _ in range(200):
        blocks = [LONG] + [" ".join(r.choices(LONG.split(), k=r.choice((1, 3, 12, 40)))) for _ in range(r.randint(0, 12))]
        r.shuffle(blocks)
        kinds = [r.choice(("p", "li", "h2", "td", "blockquote")) for _ in blocks]
        body = "".join(f"<{k}>{x}</{k}>" for k, x in zip(kinds, blocks, strict=True))
        menu = "<ul>" + "".join(f"<li><a href=/{i}>{' '.join(r.choices(LONG.split(), k=3))}</a>" for i in range(r.randint(1, 20))) + "</ul>"
        outer = r.choice(("<nav>{}</nav>", "<div class='main-menu'>{}</div>", "<div>{}</div>"))
        page = f"<html><body>{outer.format(menu)}<div id=c7>{body}</div><footer><p>{LONG}</p></footer></body></html>"
        assert main_text(page) == "\n\n".join(blocks), page
