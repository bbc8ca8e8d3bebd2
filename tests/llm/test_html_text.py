"""Main text: blocks by hand, held-out accuracy on composed pages, given pages against their article element."""

import html
import re

from peerlens.llm import html_text
from peerlens.llm.common import table


def texts(page):
    return [b.text for b in html_text.blocks(page)]


def test_blocks():
    assert texts("<p>a &amp; b<br>c\n d</p>e<div>f<b>g</b> h") == ["a & b c d", "e", "fg h"]
    assert texts("<style>p{}</style><script>x='</p>'</script><title>t</title><p>1 < 2</p>") == ["1 < 2"]
    assert texts("<p>one<p><b>two.<br><p>three") == ["one", "two.", "three"]
    assert texts("<ul><li>a<li>b</ul>c<!-- <p>no</p> --><img alt='>'>d<foot") == ["a", "b", "cd"]
    assert texts("") == texts("<") [1:] == texts("<!-- x") == texts("<script>") == []
    assert texts('<div title="a>b">x</div></div></p>y') == ["x", "y"]
    inside = html_text.blocks("<article><div class='Ad box'><p>x</p></div><p>y</article>")
    assert [(b.tags, b.marks) for b in inside] == [(["article", "div", "p"], ["ad", "box"]), (["article", "p"], [])]


def test_odd_pages_end():
    for page in ("<" * 50_000, "<p>" * 50_000, "<a '" * 20_000, "&" * 50_000, "<div class=" * 20_000, "<script>" * 5000, "İ<title>x</TITLE><p>y"):
        html_text.blocks(page)
    assert texts("İ<title>x</TITLE><p>y") == ["İ", "y"]


def test_held_out_pages():
    pages = html_text.labelled_pages(300, seed=77)
    guess = html_text.trained().decode([html_text._features(p) for p, _ in pages])
    pairs = [(g, y) for gs, (_, ys) in zip(guess, pages) for g, y in zip(gs, ys)]
    assert sum(g == y for g, y in pairs) / len(pairs) > 0.95


def test_given_pages(spark, data):
    pages = table(spark, data, "pages")
    rows = {r.page_id: r for r in html_text.main_text(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", article)
        clean = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in parts]
        assert rows[r.page_id].text == "\n\n".join(p for p in clean if p), r.page_id
        assert rows[r.page_id].n_chars == len(rows[r.page_id].text)


def test_edges(spark):
    rows = [(1, None, None, "t"), (2, "u", "", "t"), (2, "u", "", "t"), (None, "v", "<article><p>A long sentence of text is here.</p></article>", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = html_text.main_text(pages).collect()
    assert sorted((r.text, r.n_chars) for r in out) == [("", 0)] * 3 + [("A long sentence of text is here.", 32)]
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_head_without_end_tag():
    assert texts("<html><head><title>t</title><meta charset=x><style>s</style><body><article><p>one</article>") == ["one"]
    assert texts("<head><script>x</script><template><p>no</p></template><link href=y><p>two<div>three") == ["two", "three"]
    assert texts("<head><title>t</title>\n plain <title>u</title>text") == ["plain", "text"]
    assert texts("<html><head>\n<title>t</title>\n</head>\n<body><p>four") == ["four"]
    assert texts("<head>< five") == ["< five"]
    page = "<article><h1>A title of it</h1><p>A long sentence of text is here.</p></article>"
    with_end, without = (f"<html><head><title>t</title>{x}<body>{page}" for x in ("</head>", ""))
    whole, other = html_text.main_texts(html_text.trained(), [with_end, without])
    assert whole == other and "A long sentence" in whole


def test_all_words_of_attributes_count():
    classes = " ".join(f"{x}:px-4" for x in ("sm", "md", "lg", "xl", "hover", "focus", "dark"))
    (block,) = html_text.blocks(f'<div class="{classes} sidebar" id="comments">x</div>')
    assert {"sm", "dark", "px", "sidebar", "comments"} <= set(block.marks)


def main_of(*pages):
    return html_text.main_texts(html_text.trained(), pages)


LONG = "This is a rather long sentence of the page that stands for the text of an article, with commas and an end."


def test_pages_without_an_article_keep_their_text():
    two = f"{LONG}\n\n{LONG[:60]} again."
    paragraphs = "".join(f"<p>{x}</p>" for x in two.split("\n\n"))
    assert main_of(f"<html><body>{paragraphs}</body></html>", paragraphs) == [two, two]
    assert main_of(LONG, f"<html><body>{LONG}") == [LONG, LONG]


def test_formulas_objects_and_what_was_not_closed():
    assert texts("<article><p>so <math><mi>x</mi><mo>=</mo>2</math> holds<object>instead</object></article>") == ["so x=2 holds", "instead"]
    assert texts("<article><p>a <svg><path d='x'><p>b</p><p>c</p></article><p>d") == ["a", "b", "c", "d"]
    assert texts("<p>a <svg><text>no</text></svg> b") == ["a", "b"]
    assert texts("<div><select><option>no<p>yes</div>") == ["yes"]


def test_features_read_whole_blocks():
    """Links under many ancestors, a sign far into a block, and very many words count."""
    deep = "<a>" + "<b>" * 9 + "x y" + "</b>" * 9 + "</a>"
    (block,) = html_text.blocks(f"<p>{deep}</p>")
    assert block.linked == 1.0
    plain, signed = (html_text.blocks(f"<p>{'word ' * 90}{end}</p>") for end in ("a.", "©."))
    assert html_text._features(plain) != html_text._features(signed)
