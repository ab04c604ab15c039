import html
import random
import re
import time

import pytest

from logsieve.llm import html_extract as H


def own(text):
    return H.extract(H.parse(text or ""), {}, {})


def test_forgiving_parse():
    one = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p><article>";</script></head><body class=x>
    <div id="top-menu"><a href="/">Home</a></div><header><h1>Site</h1></header><div class="content-12 post"><h1>Head  line</h1>
    <p>First &lt;b&gt; para <b>bold <i>it</b>alic</i> &nbsp; end<br>next<p>Second <!-- no --> one</p><ul><li>a<li>b<ul><li>c</ul></ul>
    <table><tr><td>x<td>y<tr><td>z</table><div class='ad slot3'>Buy</div><form>Name <input></form><aside>side</aside>
    <pre> a
      b </pre>5 < 6 & 7 > 3 &copy; &#65;&#x42; &bogus;</div></div><div class="comments"><p>reader says a lot of things here, more than the article itself does, really a lot of things</p></div>
    <footer>foot</footer></body></html>"""
    want = "Head line\nFirst <b> para bold italic end next\nSecond one\na\nb\nc\nx\ny\nz\na b\n5 < 6 & 7 > 3 © AB &bogus;"
    assert own(one) == want
    page = H.parse(one)
    assert page.nodes[H.best_container(page)].path == H.votes(page)[0][0] and H.votes(H.parse(one.replace("content-12", "content-977")))[0][0] == H.votes(page)[0][0]


def test_odd_pages():
    assert own(None) == "" and own("") == "" and H.votes(H.parse("")) == []
    assert own("just text & more") == "just text & more"
    assert own("<p>a<p>b</div></span>") == "a\nb"
    assert own("<body><script>never ends") == "" and own("<body><p>x<!-- never ends") == "x"
    assert own("<body>" + "<div>" * 3000 + "deep" + "</div>" * 10) == "deep"
    assert own("<div class=aa>" * 60_000 + "x" + "</b></i>" * 60_000) == "x"
    assert own("<body><p>" + "word " * 200_000) == ("word " * 200_000).strip()


def test_consensus_beats_a_pages_own_best(spark):
    body = "<html><body><div class='story s{i}'><p>{text}</p></div><div class='box'><p>{other}</p></div></body></html>"
    rows = [(i, f"http://Host.example/{i}", body.format(i=i, text="long article text " * 20, other="short")) for i in range(8)]
    rows += [(100, "https://user@host.example:80/x", body.format(i=100, text="brief news", other="a very long box that isn't the article " * 30))]
    rows += [(200, None, None), (201, "http://host.example/none", "<p>other template only"), (None, "x", ""), (202, "nohost", "<p>y</p>"), (202, "nohost", "<p>y</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' as host", "'p' as paths", "'t' as text")
    got = sorted((r.page_id or -1, r.url or "", r.text, r.n_chars) for r in H.main_text(pages).collect())
    assert got == sorted((r.page_id or -1, r.url or "", r.text, r.n_chars) for r in H.main_text(pages, shipped_bytes=0).collect())
    by = {(p, u): t for p, u, t, _ in got}
    assert len(got) == len(rows) and all(n == len(t) for *_, t, n in got)
    assert by[100, "https://user@host.example:80/x"] == "brief news"
    assert by[200, ""] == "" and by[201, "http://host.example/none"] == "other template only" and by[202, "nohost"] == "y"
    assert H.main_text(pages.limit(0)).count() == 0


def test_pages_against_their_template(spark):
    """The synthetic pages have one article each: its heading and paragraphs, by a plain cut."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in H.main_text(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", article)
        lines = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in parts]
        assert got[r.page_id].text == "\n".join(x for x in lines if x)
        assert got[r.page_id].url == r.url and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_quotes_open_values_only_after_an_equals_sign():
    assert own("<article><p class=don't>First paragraph…</p><p>Second it's here</p><p>Third</p>") == "First paragraph…\nSecond it's here\nThird"
    assert own('<p class="x>never closed</p><p>more</p>') == "never closed\nmore"
    assert own("<p a=b'c title='1 > 0' d>kept</p>x <3 y </> z") == "kept\nx <3 y z" and own("a <b and c") == "a <b and c"
    assert own("<p>&#" + "9" * 10_000 + ";&#000065;&#x0000042;</p>") == "�AB"


@pytest.mark.parametrize("one", ["<a ", '<a href="x ', "<b>x", "<div>x", "<li>a", "<p>", "<script ", "</script ", "<!--", "<tr><td>q", "<a b='", "<i>y</b>", "<div class='comments'>x"])
def test_time_is_in_proportion(one):
    began = time.perf_counter()
    own(one * (300_000 // len(one)))
    assert time.perf_counter() - began < 8


def test_hints_are_evidence_only():
    """A name alone takes no running text away; a comment box goes by its name, place and items, in any of the languages."""
    body = "<article><p>{0}</p><p class='print'>{1}</p><div class='story side'>{2}</div><div class='promo'><p>{3}</p></div><p>{4}</p>{5}</article>"
    text = [f"Paragraph {i} goes on for a good while, as running text of an article mostly does." for i in range(5)]
    for name in ("comments", "kommentare", "commentaires", "comentarios"):
        box = f"<div class='{name}'><div class=c>So true!</div><div class=c>Not at all</div></div>"
        assert own(body.format(*text, box)) == "\n".join(text)
    assert own("<form id=all><div><p>" + text[0] + "</p></div></form>") == text[0]
    assert own("<article><header><h1>Head</h1></header><p>" + text[0] + "</p></article>") == "Head\n" + text[0]


def test_every_template_of_a_host_counts(spark):
    """Eight templates on one host, told apart only after 80 signs of class names."""
    long = "c" * 90
    page = "<html><body><div class='{0} t{1}'><p>{2}</p></div><div class='box {1}'><p>{3}</p></div></body></html>"
    rows = [(k * 100 + i, "http://one.example/", page.format(long, chr(97 + k), f"story {k} " * 30, "x")) for k in range(8) for i in range(3)]
    rows += [(9000 + k, "http://one.example/", page.format(long, chr(97 + k), f"brief {k}", "longer box text " * 40)) for k in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (0, H.SHIPPED_BYTES):
        got = {r.page_id: r.text for r in H.main_text(pages, shipped_bytes=limit).collect()}
        assert [got[9000 + k] for k in range(8)] == [f"brief {k}" for k in range(8)]


def test_made_up_pages_without_article(spark):
    """Random nested pages, written together with the text that they hold."""
    rnd = random.Random(4)
    signs = {"&amp;": "&", "&lt;": "<", "&eacute;": "é", "&#8212;": "—", "it's": "it's", "&nbsp;": " "}

    def words(n):
        chosen = [rnd.choice([*signs, "plain", "words", "of", "running", "text"]) for _ in range(n)]
        return rnd.choice([" ", "\n ", "  "]).join(chosen), " ".join(" ".join(signs.get(w, w) for w in chosen).split())

    def block(depth):
        kind = rnd.randrange(6 if depth < 4 else 3)
        if kind < 3:
            a, b = words(rnd.randrange(15, 60))
            tag = rnd.choice(["p", "p class=o'neil", 'p title="a > b"', "h2", "blockquote", "div"])
            inner = rnd.choice(["%s", "<b>%s</b>", "<a href=/x/y?z>%s</a> ", "<span data-x='\"'>%s</span>"]) % a if rnd.random() < 0.3 else a
            return f"<{tag}>{inner}</{tag.split()[0]}>", [b] if b else []
        if kind == 3:
            items = [words(12) for _ in range(3)]
            return "<ul>" + "".join(f"<li>{a}" for a, _ in items) + "</ul>", [b for _, b in items if b]
        parts = [block(depth + 1) for _ in range(rnd.randrange(1, 4))]
        return f"<section id=s{depth}>" + "".join(a for a, _ in parts) + "</section>", [x for _, b in parts for x in b]

    rows, want = [], {}
    for i in range(60):
        parts = [block(0) for _ in range(6)]
        a, b = words(80)
        rows.append((i, f"http://h{i % 3}.example/", f"<html><body><nav><a href=/>Home</a></nav><div class='story n{i}'><p>{a}</p>{''.join(x for x, _ in parts)}</div><div class=sidebar><a href=/q>Top story</a></div><footer>foot</footer></body>"))
        want[i] = "\n".join([b, *(x for _, y in parts for x in y)])
    got = {r.page_id: r.text for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


# Whole articles: expected texts are put together beside the pages, never taken from the extraction -------------

SENTENCE = "Some running text of an article that goes on for a while, long enough to count as a paragraph of prose."


def _paragraphs(*names):
    texts = [f"{SENTENCE} {n}" for n in names]
    return "".join(f"<p>{t}</p>" for t in texts), texts


def _whole(inner):
    return f"<html><body><nav><a href=/>Home</a><a href=/b>More</a></nav>{inner}<div class='footer'>Copyright <a href=/i>Imprint</a></div></body></html>"


def title_and_lead(i):
    body, texts = _paragraphs("one", "two", "three", "four")
    return _whole(f"<article><h1>Title {i}</h1><div class='lead'><p>Lead of article {i}, which says what it is all about.</p></div><div class='body'>{body}</div></article>"), [f"Title {i}", f"Lead of article {i}, which says what it is all about.", *texts]


def sibling_parts(i):
    parts = [_paragraphs(*n) for n in (("a", "b"), ("c", "d", "e", "f"), ("g",))]
    return _whole(f"<div id=c><h1>Title {i}</h1>" + "".join(f"<div class='part{k} p'>{b}</div>" for k, (b, _) in enumerate(parts)) + "</div>"), [f"Title {i}", *(t for _, ts in parts for t in ts)]


def sections(i):
    one, two = _paragraphs("x", "y", f"z{i}"), _paragraphs("w")
    return _whole(f"<article><section class=first>{one[0]}</section><section class=second>{two[0]}</section></article>"), [*one[1], *two[1]]


def long_comments(i):
    body, texts = _paragraphs("a", "b", f"c{i}")
    comments = "".join(f"<div class=entry><b>Ann {k}</b><p>I think that this is what a reader would say about the article, and some more. {k}</p></div>" for k in range(14))
    return _whole(f"<article><h1>Title {i}</h1>{body}</article><div class='comments'>{comments}</div>"), [f"Title {i}", *texts]


def formula(i):
    body, texts = _paragraphs("a", f"b{i}")
    return _whole(f"<article><h1>Title {i}</h1>{body}<p>where <math><mi>x</mi><mo>=</mo><mfrac><mn>{i}</mn><mn>2</mn></mfrac><annotation>x=\\frac</annotation></math> holds</p></article>"), [f"Title {i}", *texts, f"where x={i}2 holds"]


@pytest.mark.parametrize("make", [title_and_lead, sibling_parts, sections, long_comments, formula])
def test_articles_are_taken_whole(spark, make):
    made = [make(i) for i in range(12)]
    rows = spark.createDataFrame([(i, f"http://{make.__name__}.example/{i}", page) for i, (page, _) in enumerate(made)] + [(100, None, made[0][0])], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.main_text(rows).collect()}
    assert got == {i: "\n".join(texts) for i, (_, texts) in enumerate(made)} | {100: "\n".join(made[0][1])}


def test_what_stands_around_an_article_stays_out(spark):
    body, texts = _paragraphs("a", "b", "c")
    links = "".join(f"<li><a href=/{k}>Another story {k}</a></li>" for k in range(9))
    page = f"<html><body><div class=wrap><div class=links><ul>{links}</ul></div><div class=post><p>By Ann</p>{body}</div><div class=box><span>Ok</span><span>Go</span></div></div></body></html>"
    rows = spark.createDataFrame([(i, "http://around.example/x", page) for i in range(3)], "page_id long, url string, html string")
    assert {r.text for r in H.main_text(rows).collect()} == {"\n".join(["By Ann", *texts])}
