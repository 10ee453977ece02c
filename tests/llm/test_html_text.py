"""Main text of small pages written out by hand, and of the given pages."""

import html
import re

import pytest

from boardlake.llm import html_text

TREE = html_text.train()
LONG = "A sentence of plain words that goes on for a while so that a block has more than twenty words in it, as paragraphs do."


@pytest.mark.parametrize("depth", [10, 390, 410, 5_000])
def test_deep_nesting_keeps_its_elements(depth):
    """The end tag of each element closes that element, however many are open."""
    deep = f"<div class='sidebar'>{'<div>' * depth}<p>Aside {LONG}</p>{'</div>' * depth}</div>"
    page = f"<body><article><p>{LONG}</p></article>{deep}<div class='content'><p>After. {LONG}</p></div></body>"
    assert html_text.main_text(page, TREE) == html_text.main_text(page.replace(deep, ""), TREE)
    inside = f"<article>{'<div>' * depth}<p>{LONG}</p><div class='comments'><p>{LONG}</p></div><p>{LONG}</p>{'</div>' * depth}</article>"
    assert html_text.main_text(inside + f"<footer><p>{LONG}</p></footer>", TREE) == f"{LONG} {LONG}"
    unclosed = f"<article>{'<ul><li>' * depth}<p>{LONG}</article><footer>x</footer>"
    assert html_text.main_text(unclosed, TREE) == LONG


def test_tree_knows_its_examples():
    assert all(html_text.judge(TREE, row[:-1]) == bool(row[-1]) for row in html_text.EXAMPLES)


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("<p></p>", ""), ("<article><p>One.</p></article>", "One."),
    ("<nav><a href='/a'>Home</a></nav><article><h1>Title</h1><p>Of&amp;&lt;x&gt; a&nbsp;b\n c</p></article><footer>&copy; me</footer>",
     "Title Of&<x> a b c"),
    ("<main><p>Text<!-- <p>gone</p> --> goes on</p><script>var a='<p>no</p>';</script><style>p{}</style></main>",
     "Text goes on"),
    ("<article><p>Body.</p><div class='comments'><article><p>" + LONG + "</p></article></div></article>", "Body."),
    ("<article><header><h1>Head</h1></header><p>Body</p><aside>" + LONG + "</aside><form><p>Name</p></form></article>",
     "Head Body"),
    ("<div class='sidebar'><p>" + LONG + "</p></div><article>Text <b>bold</b>er</article>", "Text bolder"),
    ("<div class=cookie-notice>" + LONG + "</div><main>Kept</main>", "Kept"),
    (f"<body><ul><li><a href=/>Home</a><li><a href=/x>More</a></ul><p>{LONG}<p>{LONG}</body>", f"{LONG} {LONG}"),
    ("<article><p title='a > b'>Quoted</p><p title=\"open>Broken</p></article>", "Quoted Broken"),
    ("<article><p>5 < 6 and <b>cut off<i", "5 < 6 and cut off"),
    ("<article>Ends<!-- never closed <p>hidden</p>", "Ends"),
    ("<article><p hidden>No</p><div style='display: none'>no</div><p>Yes</p></article>", "Yes"),
    ("<article class='post headline'><p>Adds and address are words.</p></article>", "Adds and address are words."),
])
def test_pages(page, want):
    assert html_text.main_text(page, TREE) == want


def test_given_pages(spark, sf):
    rows = html_text.extract(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in rows:
        body = re.search("<article>(.*)</article>", pages[r.page_id], re.S).group(1)
        want = " ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", body))).split())
        assert (r.text, r.n_chars) == (want, len(want))
    assert len(rows) == len(pages)


def test_edges(spark):
    df = spark.createDataFrame([(1, None, None, "t"), (None, "u", "<p>x", "t"), (2, "u", "<article>a</article>", "t"),
                                (2, "u", "<article>a</article>", "t")], "page_id long, url string, html string, text string")
    got = sorted(map(tuple, html_text.extract(df).collect()), key=repr)
    assert got == sorted([(1, None, "", 0), (None, "u", "", 0), (2, "u", "a", 1), (2, "u", "a", 1)], key=repr)
    assert html_text.extract(df.limit(0)).count() == 0


def test_many_open_quotes_and_tags_stay_linear():
    page = "<article>" + "<p title=\"a" * 20000 + "<div>" * 5000 + "end"
    assert isinstance(html_text.main_text(page, TREE), str)
