"""Main text (operator 9) against a direct reading of the marked element."""

import html
import re

from tidewell.llm import extraction

SF = "/root/testdata/sf0.1"


def marked(source):
    inner = re.search(r"<article>(.*?)</article>", source, re.DOTALL)[1]
    inner = re.sub(r"</?b>", "", inner).replace("<br>", " ")
    blocks = (" ".join(html.unescape(b).split()) for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(b for b in blocks if b)


def test_whole_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = extraction.main_text(pages).join(pages.select("page_id", "html"), "page_id").collect()
    assert len(found) == pages.count()
    for r in found:
        assert r.text == marked(r.html) and r.n_chars == len(r.text)


def text(source, weights=None):
    return extraction.Page(source).text(weights or {})


LONG = "Here is a sentence with quite a number of words in it that reads like an article."


def test_pages_without_mark():
    page = f"<div id=menu><a href=/a>One</a> <a href=/b>Two</a></div><div class='content'><h1>Title</h1><p>{LONG}<p>{LONG}</div>"
    assert text(page) == f"Title\n{LONG}\n{LONG}"
    page += "<div class='user comments'><p>I like what you say there, thanks a lot.</p></div><footer>All rights</footer>"
    assert text(page) == f"Title\n{LONG}\n{LONG}"


def test_containers_inside_are_left_out():
    page = f"<article><p>{LONG}</p><aside><p>{LONG}</p></aside><form><input>Name</form><p>{LONG} &amp; more&nbsp; text&#33;</p></article>"
    assert text(page) == f"{LONG}\n{LONG} & more text!"


def test_wrappers_with_hints_keep_the_article():
    article = f"<h1>Title</h1><p>{LONG}</p><p>{LONG}</p>"
    expected = f"Title\n{LONG}\n{LONG}"
    side = "<div class='sidebar'><p>Some words beside it</p></div>"
    for wrap in ("class='content-sidebar-wrap'", "id=page class=has-sidebar", 'class="header-fixed"', "class='comments-open'"):
        for inner in (f"<main>{article}</main>", f"<article>{article}</article>", f"<div>{article}</div>"):
            assert text(f"<body><div {wrap}>{inner}{side}</div></body>") == expected
    assert text(f"<form id=aspnetForm><div>{article}</div>{side}</form>") == expected
    # Learned weights of a true sidebar do not fall on what such a wrapper holds.
    assert text(f"<div class='content-sidebar-wrap'><main>{article}</main></div>", {"word div.sidebar": -6.0}) == expected
    assert text(f"<div class='sidebar'><main>{article}</main></div>") == expected
    # True containers stay out, also with an article inside.
    teaser = "<div class='related'><article><p>Read this as well</p></article></div><div class='site-footer'>All rights</div>"
    assert text(f"<div>{article}</div>{teaser}{side}") == expected
    assert text(f"<p>{LONG} so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>") == f"{LONG} so x=2 holds"


def test_markup_details():
    assert text(f"<p>{LONG} a<b>b</b>c<br>d</p>") == f"{LONG} abc d"
    assert text(f"<!-- <p>no</p> --><style>p{{}}</style><script>var a = '<p>no</p>';</script><p>{LONG}") == LONG
    assert text(f"<p title='a > b'>{LONG}</p> <p class=\"x>{LONG}") != ""
    assert text("1 < 2 and 3 > 2 in some plain words") == "1 < 2 and 3 > 2 in some plain words"
    assert text(f"<ul><li>one thing<li>another thing</ul><p>{LONG}") .endswith(f"one thing\nanother thing\n{LONG}")


def test_foreign_and_longer_names():
    assert text(f"<p>{LONG}</p><svg viewBox='0 0 1 1' class=x/><p>{LONG}</p>") == f"{LONG}\n{LONG}"
    assert text(f"<p>{LONG}</p><svg><text>no</text></svg><p>{LONG}</p>") == f"{LONG}\n{LONG}"
    for name in ("select-box", "object-view", "title-bar", "style-guide"):
        assert text(f"<{name}><p>{LONG}</p></{name}><p>{LONG}</p>") == f"{LONG}\n{LONG}"
    assert text(f"<p>{LONG}</p><script/>var a = 1;</script><p>{LONG}</p>") == f"{LONG}\n{LONG}"
    assert text(f"<p>{LONG}<![CDATA[ a > b ]]> end</p>") == f"{LONG} end"


def test_comparisons_are_no_tags():
    assert text("when a<b then c>d in the end of it") == "when a<b then c>d in the end of it"
    assert text(f"<p>{LONG}a<b hidden>x</b></p>") == f"{LONG}ax"
    assert text(f"<p>{LONG} a<i class=x>b</i></p>") == f"{LONG} ab"


def test_links_and_notices_of_the_article_stay():
    learned = {"word  a": -6.0, "word a": -6.0, "word p.warning": -6.0, "word ": 2.0}
    for weights in ({}, learned):
        for name in ("article", "main"):
            body = f"<p><a href=/x>Start here</a></p><p>{LONG}</p><p class=\"warning\">Take care of it.</p><p><a href=/y>Read the next part</a></p>"
            page = f"<nav><a href=/>Home</a></nav><{name}>{body}</{name}><div class=related><a href=/z>More</a></div>"
            assert text(page, weights) == f"Start here\n{LONG}\nTake care of it.\nRead the next part", (name, weights)
    # A container inside it stays out.
    inner = f"<article><p>{LONG}</p><div class='newsletter'><p>Sign up</p></div><p><a href=/y>Next</a></p></article>"
    assert text(inner) == f"{LONG}\nNext"


def test_region_is_the_best_run():
    page = extraction.Page("<p>a b</p><p>c</p><p>d e f</p>")
    weights = {"word ": 1.0, "tag p": -1.5, "tag /p": -0.1}
    a, b = page.region(weights)
    sums = {(i, j): sum(page.weight(weights)[i:j]) for i in range(len(page.kinds)) for j in range(i, len(page.kinds) + 1)}
    assert sums[a, b] == max(sums.values())


def test_awkward_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<p>"), (4, "u", f"<p>{LONG} " * 3000), (4, "u", "</p></div>x"), (None, "u", LONG)]
    pages = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, kind string, text int")
    found = extraction.main_text(pages).collect()
    assert len(found) == 6
    by_id = {(r.page_id, r.n_chars > 100): r for r in found}
    assert by_id[1, False].text == "" and by_id[2, False].text == "" and by_id[3, False].text == ""
    assert by_id[4, True].text.count("\n") == 2999 and by_id[4, False].text == "x" and by_id[None, False].text == LONG
    assert extraction.main_text(pages.limit(0)).count() == 0
