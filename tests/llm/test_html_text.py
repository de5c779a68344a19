"""Main text of pages: whole pages against their articles, rules one by one, and defined cases."""

import html
import re

import pytest

from tidefolio.llm.html_text import extract, main_text

PARAGRAPH = "The house by the lake was built in a year that no one in the village could name, and it is still there."
OTHER = "It was said that the man who built it had come from the north with a boat, two dogs and a box of books."


def test_whole_table_equals_its_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in extract(pages, ["page_id", "url"]).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split("</?(?:p|h1)>", article)]
        assert got[r.page_id].text == "\n".join(b for b in blocks if b)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url
    assert len(got) == pages.count()


@pytest.mark.parametrize(
    "boiler",
    [
        "<nav><p>{}</p></nav>",
        "<header><h2>{}</h2></header>",
        "<footer><div>{}</div></footer>",
        "<aside>{}</aside>",
        "<form><label>{}</label><textarea>{}</textarea></form>",
        "<script>var a = '<p>{}</p>';</script>",
        "<style>p {{ content: '{}' }}</style>",
        "<!-- <p>{}</p> -->",
        "<div class='cookie-notice'><p>{}</p></div>",
        "<div id=sidebar><section><p>{}</p></section></div>",
        "<section class='Comments list'><article><p>{}</p></article></section>",
        "<div role=navigation>{}</div>",
        "<div style='display: none'><p>{}</p></div>",
        "<div class=ad>{}</div>",
        "<noscript>{}</noscript>",
        "<ul class='mainMenu'><li><a href=x>{}</a></li></ul>",
    ],
)
def test_boilerplate_goes_inside_and_outside_an_article(boiler):
    noise = boiler.replace("{}", OTHER).replace("{{", "{").replace("}}", "}")
    assert main_text(f"<body>{noise}<article><h1>On houses</h1><p>{PARAGRAPH}</p></article>{noise}") == f"On houses\n{PARAGRAPH}"
    if "<header" not in noise:
        assert main_text(f"<article><p>{PARAGRAPH}</p>{noise}<p>Short end</p></article>") == f"{PARAGRAPH}\nShort end"


def test_article_text_stays_whatever_it_is():
    parts = ["Title", "%%% 1234 ***", "<a href=x>One link</a>", "x" * 500, "zwölf", PARAGRAPH, "k=v; 17"]
    page = "<main><article class='has-sidebar'>" + "".join(f"<p>{p}</p>" for p in parts) + "</article><p>outside</p></main>"
    assert main_text(page).split("\n") == [re.sub("<[^>]*>", "", p) for p in parts]
    assert main_text("<article><p>Word</p></article><p>" + PARAGRAPH) == "Word"


def test_rules_without_an_article():
    links = "".join(f"<li><a href=/{k}>Link number {k}</a></li>" for k in range(8))
    junk = "<div>" + "lorem ipsum dolor " * 10 + "</div>"
    page = f"<div><ul>{links}</ul><h1>A title</h1><p>{PARAGRAPH}</p><p>Short</p><p>{OTHER}</p></div>{junk}<p>tiny</p>"
    assert main_text(page) == f"A title\n{PARAGRAPH}\nShort\n{OTHER}"
    assert main_text("<p>Only this</p>") == "Only this"


def test_white_space_references_and_inline_markup():
    page = "<article><p> a&nbsp;&amp;\n\tb<b>c</b>&lt;d&gt;&eacute;&#x4e16;&copy &am &unknown; <br>e<br><br>f<br/>g </p>h<i>i</i></article>"
    assert main_text(page) == "a & bc<d>é世© &am &unknown; e\nf g\nhi"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("   \n ", ""),
        ("plain words", "plain words"),
        ("<article><p>a<b>b<p>c</article>", "ab\nc"),
        ("<article><ul><li>a<li>b</ul>c", "a\nb\nc"),
        ("<article>a</div></span></p>b", "ab"),
        ("<article>a < b <3 </ x>c", "a < b <3 c"),
        ("<article>a<p title='x>y' hidden>b</p><p title=\"it's\">c</p>", "a\nc"),
        ("<article>a<p title='open>b</p>", "a\nb"),
        ("<article>a<!-- cut", "a"),
        ("<article>a<script>cut", "a"),
        ("<article>a<p cla", "a"),
        ("<article>a<SCRIPT>x</p></Script >b</ARTICLE>c", "ab"),
        ("<article>a<table><tr><td>b<td>c<tr><td>d</table>e", "a\nb\nc\nd\ne"),
    ],
)
def test_broken_markup(page, text):
    assert main_text(page) == text


def test_long_page_repeats_and_other_columns(spark):
    long = "<article>" + f"<p>{PARAGRAPH}</p>" * 20000
    rows = [(1, None, None, "u"), (1, "x", "", "u"), (2, "y", long, "u"), (2, "y", long, "u"), (None, "z", "<article>a", "u")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = extract(pages, ["page_id", "url"]).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 1] + [20000 * (len(PARAGRAPH) + 1) - 1] * 2
    assert extract(pages.limit(0), ["page_id", "url"]).collect() == []


def test_open_quotes_take_linear_time():
    import time

    start = time.perf_counter()
    main_text("<article>" + "<a x='\">b" * 20000)
    main_text("<" * 200000 + "a>")
    assert time.perf_counter() - start < 20
