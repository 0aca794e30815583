import html
import re

import pytest
from pyspark.sql import functions as F

from stockyard.llm import html_text as H

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def weights(spark):
    return H.train(spark.read.parquet(f"{SF}/pages.parquet"))


def _inside(page):
    """Text of the one article element of a generated page."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner.replace("<b>", "").replace("</b>", ""))).split())


def test_generated_pages_give_their_article(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = {r["page_id"]: r for r in H.main_text(pages).collect()}
    for page in pages.collect():
        found = rows[page["page_id"]]
        assert found["text"] == _inside(page["html"]) and found["n_chars"] == len(found["text"])
        assert found["url"] == page["url"]


def test_without_the_article_tag(spark, weights):
    for page in spark.read.parquet(f"{SF}/pages.parquet").limit(60).collect():
        bare = page["html"].replace("<article>", "<div>").replace("</article>", "</div>")
        assert H.extract(bare, weights) == _inside(page["html"])


def test_other_layout(weights):
    page = """<html><head><title>x</title></head><body class="has-sidebar"><header><h1>Site</h1></header>
    <div id="cookie-notice">We use cookies</div><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul>
    <div class="content"><h1>Head&shy;line</h1><div>First para with <b>bo</b>ld text &amp; more words here.</div>
    <div>Second&nbsp;para of text.</div><form><input name=q>Search</form><aside>see also</aside>
    <p>Third <a href=u>link</a> para.<script>var a = "<p>no</p>";</script><!-- <p>no</p> --></div>
    <section id="comments"><p>I like this very much</p></section><div class="sidebar">Popular</div>
    <footer>c 2024</footer></body></html>"""
    assert H.extract(page, weights) == (
        "Head\xadline First para with bold text & more words here. Second para of text. Third link para."
    )


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain  text\nonly", "plain text only"), ("<p>unclosed <b>bold", "unclosed bold"),
    ("a < b &lt; c", "a < b < c"), ("<script>x", ""), ("<!-- c", ""), ("<p hidden>no</p><p>yes</p>", "yes"),
    ("<p>a<br>b</p>", "a b"), ("&#233;&eacute;&amp &bogus;", "éé& &bogus;"), ("<p title='>'>x</p>", "x"),
])
def test_odd_pages(page, text):
    assert H.extract(page, {}) == text


def test_best_region_is_the_maximum():
    """The scan against all contiguous regions."""
    weights = {("word", ("p", False)): 1.0, ("tag", "p"): -0.5, ("tag", "i"): -0.5, ("tag", "hr"): -3.0}
    page = "<p>a b</p><hr><p>c d e f</p><i></i><p>g h i</p><hr><hr><p>j</p>"
    pieces = [e for e in H.events(page)]
    value = [len(t.split()) * weights[k, key] if k == "word" else weights[k, key] for k, key, t, _, _ in pieces]
    best = max(sum(value[a:b]) for a in range(len(value)) for b in range(a, len(value) + 1))
    text = H.extract(page, weights)
    assert text == "c d e f g h i"
    a = next(i for i, e in enumerate(pieces) if e[2] == "c d e f")
    b = next(i for i, e in enumerate(pieces) if e[2] == "g h i")
    assert max(sum(value[x : b + 1]) for x in (a, a - 1)) == best


def test_long_and_repeated_pages(spark, weights):
    long = "<article>" + "<p>word &amp; more</p>" * 40_000 + "</article>"
    pages = spark.createDataFrame(
        [(1, "u", long), (1, "u", long), (None, None, None), (2, "v", "<p>x</p>")], "page_id long, url string, html string"
    ).withColumn("text", F.lit("clash"))
    rows = H.main_text(pages, weights).collect()
    assert len(rows) == 4 and rows[0]["text"] == " ".join(["word & more"] * 40_000)
    assert [r["text"] for r in rows if r["page_id"] is None] == [""]
    assert H.main_text(pages.limit(0)).count() == 0


def test_unlabelled_pages_teach_nothing():
    assert H.learn(["<p>x</p>", None, "<article>a</article><article>b</article>"]) == {}


@pytest.mark.parametrize("before, after", [
    ("<div class='layout has-sidebar'>", "</div>"), ("<div class='post no-comments'>", "</div>"),
    ("<div class='main-widget'>", "</div>"), ("<div class=sidebar>x", ""),
])
def test_wrappers_with_marks_keep_the_text(before, after):
    tag = "div" if after else "article"
    text = f"<{tag}>" + "many words of the text " * 9 + f"</{tag}>"
    assert "many words of the text" in H.extract(f"<body>{before}{text}{after}</body>", {})


@pytest.mark.parametrize("region", [
    "<div id=comments><article class=comment>leaked words</article></div>",
    "<aside><article>leaked words</article></aside>", "<article class=related>leaked words</article>",
])
def test_articles_in_comments_and_asides_stay_out(region):
    text = "many words of the text " * 9
    assert H.extract(f"<body><article>{text}</article>{region}</body>", {}) == text.strip()


@pytest.mark.parametrize("body", ['<div class="ad">', "<b>", '<div class="ad">x ', "<b>x</i>", "</i>"])
def test_many_unclosed_elements_take_time_in_proportion(body):
    import time

    start = time.process_time()
    pieces = H.events("<p>some words of a page</p>" + body * 50_000)
    assert time.process_time() - start < 20 and len(pieces) >= 50_000


def test_marks_count_the_words_of_what_they_hold():
    page = '<div class="ad"><div class="sidebar"><p>a b c</p></div><p>d e f g</p></div><p>h i</p>'
    dropped = {text: gone for kind, _, text, gone, _ in H.events(page) if kind == "word"}
    # the advert holds seven of nine words, the sidebar in it three
    assert dropped == {"a b c": True, "d e f g": False, "h i": False}


def test_sampled_pages_are_read_by_their_hashes(spark):
    rows = [(i, f"u{i}", f"<body><nav>menu {i}</nav><article><p>some text of page {i}</p></article></body>") for i in range(30)]
    table = spark.createDataFrame(rows + rows[:5] + [(99, "u", None)], "page_id long, url string, html string")
    whole = H.learn([r[2] for r in rows])
    assert H.train(table) == whole  # repeated rows teach once
    some = H.train(table, rows=10)
    assert some and some != whole and some == H.train(table.repartition(7), rows=10)
