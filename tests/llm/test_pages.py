import html as htmllib
import random
import re
import time

from spoorline.llm.pages import high_cluster, main_lines, main_text, smoothed

import numpy as np


def by_pattern(page):
    """The article of a page of the test tables, by its fixed template."""
    body = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", re.sub(r"<br>", " ", body))
    out = (" ".join(htmllib.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks)
    return [b for b in out if b]


def test_whole_table_against_its_template(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r.page_id: r for r in pages.collect()}
    rows = main_text(pages).collect()
    assert len(rows) == len(source)
    for r in rows:
        assert r.text == "\n\n".join(by_pattern(source[r.page_id].html))
        assert r.n_chars == len(r.text) and r.url == source[r.page_id].url


ARTICLE = ["A heading", "The first paragraph has a good many words in it, as paragraphs do.", "Short.",
           "Another long paragraph & its friends < follow here, so that the article is plain to see."]
CLUTTER = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site name</h1><p>The site header has a long claim that nobody wants to read in a corpus.</p></header>
<nav><ul><li><a href=x>One</a></li><li><a href=y>Two</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies to make this page better for you and our many partners.</p></div>
%s
<div id="comments"><h3>Comments</h3><div class="comment"><p>I have read this with much pleasure, thank you for it all.</p></div></div>
<section class="related-posts"><p>Read more of this kind of text in our other long and fine articles.</p></section>
<aside><p>A sidebar text that is as long as any paragraph of the article itself, or longer.</p></aside>
<form><label>Name</label><textarea>write here a long message to the authors of the page</textarea></form>
<div style="Display: none"><p>A hidden block of many words that no reader of the page ever sees.</p></div>
<script>var a = "<p>not text</p>";</script><!-- <p>nor this</p> -->
<footer><p>Copyright &copy; all of us, with a line that is long enough to look like text.</p></footer></body></html>"""


def paragraphs(tag="p"):
    return f"<h1>{ARTICLE[0]}</h1>" + "".join(
        f"<{tag}>{htmllib.escape(t)}</{tag}>\n" for t in ARTICLE[1:]
    )


def test_clutter_goes_with_and_without_an_article_element():
    inside = "<div class='ad'><p>Buy this very good thing now, while it is still here to be bought.</p></div>"
    for page in (
        f"<article>{paragraphs()}{inside}</article>",
        f"<main><div>{paragraphs()}</div>{inside}</main>",
        f"<div id=content>{paragraphs()}{inside}</div>",
        f"<div><div class=post>{paragraphs('div')}</div></div>",
        f"<article><header><h1>{ARTICLE[0]}</h1></header>{paragraphs().partition('</h1>')[2]}<footer>by me</footer></article>",
    ):
        assert main_lines(CLUTTER % page) == ARTICLE


def test_markup_details():
    assert main_lines("<article><p>a<br>b&nbsp;&#233;\n\n c</p><p><b>bold</b>er<p>x<ul><li>one<li>two</ul></article>") == [
        "a b é c", "bolder", "x", "one", "two"]
    assert main_lines("just text, <i>no</i> element") == ["just text, no element"]
    for empty in ("", "   ", "<html>", "<!---->", "<article></article>", "<script>x</script>", "<![CDATA[x]]>"):
        assert main_lines(empty) == []


def test_broken_markup_never_fails():
    rng = random.Random(1)
    page = CLUTTER % f"<article>{paragraphs()}</article>"
    for _ in range(300):
        cut = page[: rng.randrange(len(page))]
        at = rng.randrange(len(cut) + 1)
        main_lines(cut[:at] + rng.choice(["<", ">", "</", "<!", "<![", "&#", "</p", "<a b='", "<!--", "<?x"]) + cut[at:])


def test_odd_rows(spark):
    rows = [(1, None, None, 5), (2, "u", "", 5), (3, "u", "<p>x</p>" * 3, None), (None, None, "<p>" + "word " * 50_000, 1), (3, "u", "<p>x</p>" * 3, 2)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    out = main_text(df).collect()
    assert len(out) == 5 and [r.text for r in out if r.page_id == 3] == ["x\n\nx\n\nx"] * 2
    assert {r.n_chars for r in out if r.page_id in (1, 2)} == {0}
    assert next(r for r in out if r.page_id is None).n_chars == 249_999
    assert main_text(df.limit(0)).collect() == []


def test_smoothing_and_clusters():
    values = smoothed(np.array([1.0, 1, 1, 50, 2, 60, 55, 1, 1, 1]))
    assert list(np.flatnonzero(high_cluster(values))) == [3, 4, 5, 6]
    assert high_cluster(np.array([3.0, 3.0])).all()


LONG = [f"Paragraph {i} of this text has many plain words, so that every reader sees at once what it is here for." for i in range(6)]


def blocks(lines, tag="p"):
    return "".join(f"<{tag}>{t}</{tag}>" for t in lines)


def test_a_heading_in_a_header_of_the_article_stays():
    page = f"<article><header class='entry-header'><h1>The title</h1></header>{blocks(LONG)}</article>"
    assert main_lines(CLUTTER % page) == ["The title", *LONG]


def test_a_section_named_discussion_of_a_paper_stays():
    page = f"<article><h1>A paper</h1>{blocks(LONG[:3])}<section id='discussion'><h2>5 Discussion</h2>{blocks(LONG[3:])}</section></article>"
    assert main_lines(CLUTTER % page) == ["A paper", *LONG[:3], "5 Discussion", *LONG[3:]]


def test_a_form_around_the_body_loses_only_its_controls():
    page = f"<form id=aspnet><input name=v><div class=main-text><h1>Title</h1>{blocks(LONG)}</div><select><option>one</select><button>Send</button></form>"
    assert main_lines(f"<html><body>{page}</body></html>") == ["Title", *LONG]


def test_sibling_articles_all_stay():
    page = f"<article><h2>First</h2>{blocks(LONG[:4])}</article><article><h2>Second</h2>{blocks(LONG[4:])}</article>"
    assert main_lines(CLUTTER % page) == ["First", *LONG[:4], "Second", *LONG[4:]]


def test_a_lead_paragraph_in_a_block_beside_the_body_stays():
    for around in ("%s<article>%s</article>", "%s<div class=body>%s</div>"):
        page = around % (f"<div class=lead><p>{LONG[0]}</p></div>", blocks(LONG[1:]))
        assert main_lines(CLUTTER % page) == LONG


def test_the_clusters_decide(spark, monkeypatch):
    """With every line in the high cluster, most pages come out otherwise."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    before = [main_lines(p) for p in pages]
    monkeypatch.setattr("spoorline.llm.pages.high_cluster", lambda values: np.ones(len(values), bool))
    assert sum(main_lines(p) != b for p, b in zip(pages, before, strict=True)) > 0.9 * len(pages)


def test_deep_and_unclosed_markup_takes_linear_time():
    for piece in ("<div>text ", "<b>x</i>", "<p>y</q><span>", "<li><i>z"):
        start = time.process_time()
        assert main_lines(piece * 30_000)
        assert time.process_time() - start < 20
