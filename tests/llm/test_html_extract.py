import itertools
import random
import re
import time

from tracewright.llm import html_extract as hx


def energy(odds, edges, side):
    return sum(o if not s else 0 for o, s in zip(odds, side) if o > 0) - sum(o for o, s in zip(odds, side) if o < 0 and s) + sum(w for a, b, w in edges if side[a] != side[b])


def test_cut_is_a_minimum():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randrange(1, 9)
        odds = [rng.choice([0.0, rng.uniform(-1, 1), rng.uniform(-3, 3)]) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]
        got = energy(odds, edges, hx.minimum_cut(odds, edges))
        least = min(energy(odds, edges, s) for s in itertools.product([False, True], repeat=n))
        assert abs(got - least) < 1e-9


def test_flow_alone_is_a_minimum():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randrange(2, 8)
        odds = [rng.uniform(-1, 1) for _ in range(n)]
        near = {i: {} for i in range(n)}
        edges = [(i, j, rng.uniform(0, 1)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.6]
        for a, b, w in edges:
            near[a][b] = near[b][a] = w
        side = hx.maximum_flow(dict(enumerate(odds)), near)
        assert abs(energy(odds, edges, side) - min(energy(odds, edges, s) for s in itertools.product([False, True], repeat=n))) < 1e-9


ARTICLE = """<h1>A &amp; B</h1><p><b>Some  words
 here,<br> and&nbsp;more.<p>Short.</p><ul><li>first <i>point</i> of it</li><li>second point</ul><blockquote>Said &lt;so&gt;</blockquote>"""
WANT = "A & B\nSome words here, and more.\nShort.\nfirst point of it\nsecond point\nSaid <so>"

PAGES = {
    WANT: [
        f'<html><head><title>t</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">a</a></ul></nav><!-- ad <p>x --><div class="ad">Buy this thing now.</div><article>{ARTICLE}</article><footer>&copy; x. All of it is ours.</footer>',
        f'<body><header><h1>The Site</h1><p>What a site it is.</p></header><main>{ARTICLE}<section id="comments"><h2>2 comments</h2><article class="comment"><p>I do not think that this is so, dear author.</p></article></section></main><aside><p>Read also this long story about the other thing.</p></aside></body>',
        f'<body><div class="cookie-notice"><p>We use cookies for many purposes, as you may read here.</p></div><div id="sidebar">Lorem ipsum dolor sit amet.</div><div class="article-content">{ARTICLE}<form><p>Your name and address, please.</p><input></form><div class="share-buttons">Share this</div></div><div role="contentinfo">All rights reserved.</div>',
        f'<div class="ad">unclosed<article>{ARTICLE}<noscript>Turn it on.</noscript><button>Go</button><select><option>1</select></article><div class="related-posts"><p>One more text for you to read.</p></div><div style="display: none">Hidden words are here.</div><iframe><p>in</iframe>',
    ],
    "": ["", None, "<", "<p", "<!-- never closed <p>text</p>", "<script>a", "<nav><p>only a menu here.</p></nav>", "   \n"],
    "< 5 and a <b": ["<article><p>< 5 and a &lt;b</p></article>"],
}


def test_pages(spark):
    rows, want = [], {}
    for text, pages in PAGES.items():
        for page in pages:
            want[len(rows)] = text
            rows.append((len(rows), "u", page, "x"))
    rows.append((0, None, rows[0][2], None))
    rows.append((None, "n", rows[0][2], None))
    got = hx.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    got = got.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == want.get(r.page_id, WANT) and r.n_chars == len(r.text)
    assert hx.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_a_page_without_marks_keeps_its_paragraphs():
    menu = "".join(f'<li><a href="/{k}">Item {k}</a></li>' for k in range(9))
    page = f'<body><div><ul>{menu}</ul></div><div><h1>On the thing</h1><p>It is a longer paragraph of the text, with some words in it.</p><p>Yes.</p><p>And this is one more paragraph with some words.</p></div><div><a href="/x">Imprint</a> <a href="/y">Privacy</a></div>'
    assert hx.main_text(page) == "On the thing\nIt is a longer paragraph of the text, with some words in it.\nYes.\nAnd this is one more paragraph with some words."


def test_long_and_odd_pages_take_linear_time():
    began = time.time()
    assert len(hx.main_text("<article>" + "<p>some words of a text.</p>" * 40_000)) == 40_000 * len("some words of a text.") + 39_999
    for page in ("<div>" * 50_000 + "x", "<a b='" * 20_000, '<p x="' * 20_001, "&" * 200_000, "<" * 100_000, "<p" * 100_000, "<b>" * 20_000 + "<p>x", "</div>" * 50_000, "<li>x" * 20_000):
        hx.main_text(page)
    assert time.time() - began < 40


def test_every_given_page(spark):
    """The pages of the given tables hold one article each, of a known form: the text between its tags, by a plainer way."""
    from tracewright.llm import registry

    sf = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = registry.queries()["op11_html_extract"](spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(hx.entities.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b)
