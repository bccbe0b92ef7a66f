from __future__ import annotations

import html as plain
import re

from plumbline.llm.html import extract, main_text

BODY = "<p>First text, with commas, and more. It goes on, and on, for a while.</p><p>Second text, that is long enough. It ends here, at last.</p>"
TEXT = "First text, with commas, and more. It goes on, and on, for a while. Second text, that is long enough. It ends here, at last."


def test_what_surrounds_the_article_goes():
    around = [
        "<nav><ul><li><a href='/x'>Menu, menu, menu.</a></li></ul></nav>", "<header>Big header, with words. And more words, here.</header>", "<footer>&copy; 2020, all. Rights, reserved.</footer>",
        "<aside>Some side, of it. A lot, of text, here.</aside>", "<div class='ad top'>Buy this, now. And that, too, now.</div>", "<form><label>Name, please.</label><input></form>",
        "<div id='comments'><p>Nice one, thanks. I agree, with all, of it.</p></div>", "<div class=\"cookie-notice\">We use cookies, a lot. Accept, now.</div>", "<script>var a = '<p>No, never. Not this, no.</p>';</script>",
        "<style>p{x:y}</style>", "<!-- <p>Hidden, text. Not, seen.</p> -->", "<section class='sidebar-right'><p>Other, things. And, so on.</p></section>", "<div style='display:none'>Secret, text. Very, secret.</div>",
    ]
    for a in around:
        assert extract(f"<html><head><title>T, t. T.</title></head><body>{a}<article>{BODY}</article>{a}</body></html>") == TEXT, a
        assert extract(f"<html><body>{a}<div class='post'>{BODY}</div>{a}</body></html>") == TEXT, a
        assert extract(f"<article>{BODY}{a}</article>") == TEXT, a


def test_references_white_space_and_open_tags():
    assert extract("<article><p>a &amp; b &lt;c&gt; &#233;\n\t x<br>y <b>bold</b>er</p></article>") == "a & b <c> é x y bolder"
    assert extract("<article><h1>T</h1><p><b>open<br><p>next, one.</p></article><footer>no</footer>") == "T open next, one."
    assert extract("<article><p>cut off &amp; he") == "cut off & he"
    assert extract("<article><p>cut off</p><p cla") == "cut off"
    assert extract("<article><p>1 < 2 and 3 > 2</p></article>") == "1 < 2 and 3 > 2"
    assert [extract(x) for x in ("", "<p></p>", "<nav>x</nav>", "<script>x", "plain")] == ["", "", "", "", "plain"]
    assert extract('<article title="a > b"><p>x</p></article>') == "x"


LONG = "A paragraph, with a comma, goes on for some time. Then it ends, as all do. " * 4


def test_every_selected_block_stays():
    n = lambda page, text: extract(page).count(text.split(".")[0])
    assert extract("<body><div><p>" + "Very long, this one. " * 250 + "</p><p>" + "Other, words. " * 20 + "</p><p>" + "Third, words. " * 20 + "</p></div></body>").split().count("Third,") == 20
    assert n(f"<body><article><p>{LONG}</p></article><article><p>{LONG}</p></article><article><p>{LONG}</p></article></body>", LONG) == 12
    page = extract(f"<body><h1>The title</h1><p>Lead, in a few words. {LONG}</p><div class='body'><p>{LONG * 5}</p><p>Short.</p></div></body>")
    assert page.startswith("The title Lead, in a few words.") and page.endswith("Short.")


def test_wrappers_and_sections_named_like_what_is_left_out():
    for start, end in (("<div class='content has-sidebar'>", "</div>"), ("<main class='with-comments'>", "</main>"), ("<div id='sidebar-layout'>", "</div>")):
        assert extract(f"<body>{start}<p>{LONG}</p><p>{LONG}</p>{end}</body>").count("A paragraph") == 8
    for name in ("discussion", "related-work", "responses", "disclaimer"):
        assert extract(f"<article><p>{LONG}</p><p>{LONG}</p><section id='{name}'><h2>Head</h2><p>{LONG}</p></section></article>").count("A paragraph") == 12, name
    links = "<section id='related'>" + "<p><a href='/x'>Some other page, that is long enough to be read.</a></p>" * 9 + "</section>"
    for extra in (links, f"<div id='comments'><p>{LONG}</p></div>"):
        assert extract(f"<article><p>{LONG}</p><p>{LONG}</p>{extra}</article>") == " ".join(f"{LONG} {LONG}".split())


def test_words_in_attribute_values_hide_nothing():
    kept = [
        "<div title='The hidden life of trees'>{}</div>", "<article data-title=\"A hidden gem, display: none\">{}</article>", "<div data-hidden-by=x>{}</div>",
        "<section title='aria-hidden=true'>{}</section>", "<div title='class=\"sidebar\"'>{}</div>", "<div alt='no' data-class='menu'>{}</div>", "<div style='display:block'>{}</div>",
        "<div aria-hidden='false'>{}</div>",
    ]
    for page in kept:
        assert extract(f"<body><p>{LONG}</p>{page.format(f'<p>{LONG}</p>')}</body>").count("A paragraph") == 8, page
    gone = ["<div hidden>{}</div>", "<div hidden=''>{}</div>", "<div class=x HIDDEN id=y>{}</div>", "<div aria-hidden=true>{}</div>", "<div style='color: red; DISPLAY : none'>{}</div>"]
    for page in gone:
        assert extract(f"<body><p>{LONG}</p>{page.format(f'<p>{LONG}</p>')}</body>").count("A paragraph") == 4, page


def test_pages_inside_a_form():
    fields = "<label>Name</label><input name=n><select><option>One, two, three.</option></select>"
    for body in (f"<p>{LONG}</p><p>{LONG}</p>", f"<article><div>{LONG}</div><div>{LONG}</div></article>"):
        text = extract(f"<body><form id='aspnetForm' action='/x'><input type=hidden name=v value='...'>{body}{fields}</form></body>")
        assert text.count("A paragraph") == 8 and "three" not in text
        assert extract(f"<body>{body}<form><p>{LONG[:150]}</p>{fields}</form></body>").count("A paragraph") == 8
    assert extract(f"<body><form>{fields}</form></body>") == ""


def plain_blocks(tables: str) -> str:
    return " ".join(plain.unescape(re.sub(r"<[^>]*>", " ", tables)).split())


def test_pages_without_an_article_and_with_tables():
    cells = "".join(f"<tr><td>{LONG}</td><td><p>{LONG}</p></td></tr>" for _ in range(3))
    menu = "<tr><td><ul>" + "".join(f"<li><a href='/{i}'>Page {i}</a></li>" for i in range(20)) + "</ul></td></tr>"
    assert extract(f"<body><table>{menu}{cells}</table></body>") == plain_blocks(cells)
    two = f"<article><h2>One</h2><p>{LONG}</p></article><article><h2>Two</h2><p>{LONG}</p></article>"
    assert extract(f"<body><nav><a href='/'>Home</a></nav><div>{two}</div><footer>End, of it.</footer></body>") == plain_blocks(two)


def test_a_very_long_text():
    many = "".join(f"<p>Paragraph {i}, with words. And a second sentence.</p>" for i in range(20_000))
    assert extract(f"<body><nav><a href='/'>Home</a></nav>{many}</body>") == plain_blocks(many)


def test_pages_like_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = {r.page_id: r for r in main_text(pages, ["page_id", "url"]).collect()}
    for r in pages.collect():
        cut = re.search(r"(?s)<article>(.*?)(</article>|\Z)", r.html)[1]
        text = " ".join(plain.unescape(re.sub(r"<[^>]*(>|\Z)", " ", cut)).split())
        assert (found[r.page_id].text, found[r.page_id].n_chars, found[r.page_id].url) == (text, len(text), r.url)


def test_nulls_repeats_clashes_and_no_rows(spark):
    rows = [(1, None, None, "x", 1), (1, None, None, "x", 1), (None, "u", "<article>é\U0001f600</article>", "x", 1), (2, "u", "<p>" * 5000 + "deep, text", "x", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    found = main_text(pages, pages.columns).collect()
    assert sorted((repr(r.page_id), r.text, r.n_chars) for r in found) == [("1", "", 0), ("1", "", 0), ("2", "deep, text", 10), ("None", "é\U0001f600", 2)]
    assert main_text(pages.where("false"), ["page_id"]).collect() == []
