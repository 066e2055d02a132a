import itertools
import math
from html.parser import HTMLParser

import numpy as np

from sessionlens.llm.html_extract import Contexts, Crf, extract_pages, labelled_blocks, leaf_blocks, op4_html_extraction, trained, training_pages

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice">We use cookies.</div><article><h1>Title &amp; more</h1>
<p>First <b>bold</b>  text<br>goes on. It has some words.<p>Second one, with a <a href="/x">link</a> in it and words after it.
<ul><li>point one<li>point two</ul><!-- <p>hidden</p> --></article><section id="comments"><p>Nice article, thanks!</p></section>
<aside>Related things</aside><form><label>Your mail</label><textarea>x</textarea></form><footer>&copy; Us</footer></body>"""


def test_article_without_the_rest():
    assert trained().extract(PAGE) == ["Title & more", "First bold text goes on. It has some words.", "Second one, with a link in it and words after it.", "point one", "point two"]


def test_broken_pages():
    crf = trained()
    for page in ("", "plain words only, no tags at all.", "<", "<<<>>>", "<p", "<script>never ends", "<!-- never ends", "</div></p>", "<a title='x>y'>t</a>", "<table><tr><td>a<td>b<tr><td>c</table>", "<p>" * 5000):
        assert isinstance(crf.extract(page), list)
    assert [b[1] for b in leaf_blocks("<table><tr><td>a<td>b<tr><td>c</table>d", Contexts())] == ["a", "b", "c", "d"]


def test_held_out_pages():
    crf, contexts, wrong, total = trained(), Contexts(), 0, 0
    for page in training_pages(150, seed=77):
        features, labels = labelled_blocks(page, contexts)
        scores = [float(sum(crf.weights[crf.index[f]] for f in fs if f in crf.index)) for fs in features]
        wrong += sum(a != b for a, b in zip(crf.viterbi(scores), labels))
        total += len(labels)
    assert wrong <= 0.01 * total


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(1)
    for n in range(1, 8):
        crf = Crf({}, np.empty(0), rng.normal(size=(2, 2)), rng.normal(size=2))
        scores = rng.normal(size=n).tolist()

        def total(y):
            return crf.start[y[0]] + sum(s for s, k in zip(scores, y) if k) + sum(crf.transitions[a, b] for a, b in zip(y, y[1:]))

        best = max(itertools.product((0, 1), repeat=n), key=total)
        assert math.isclose(total(crf.viterbi(scores)), total(best))


def test_edges_and_query(spark, small):
    rows = [(1, None, None, 1), (2, "u", "", 1), (3, "u", PAGE, 1), (3, "u", PAGE, 1), (4, "u", "<article><p>" + "Word in it. " * 30000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    out = extract_pages(pages, trained())
    got = {r.page_id: r for r in out.collect()}
    assert got[1].text == got[2].text == "" and got[1].n_chars == 0 and got[3].n_blocks == 5 and got[4].n_chars == 30000 * 12 - 1 and out.count() == 5
    assert extract_pages(pages.limit(0), trained()).count() == 0
    assert all(r.n_chars == len(r.text) > 0 for r in op4_html_extraction(spark, small).collect())


class Article(HTMLParser):
    """The words inside <article>, by the standard library's reader instead of leaf blocks and a model."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.hidden, self.text = 0, 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.hidden += tag in ("script", "style")
        self.text.append("" if tag in ("b", "a", "i") else " ")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.hidden -= tag in ("script", "style")
        self.text.append("" if tag in ("b", "a", "i") else " ")

    def handle_data(self, data):
        if self.depth and not self.hidden:
            self.text.append(data)


def test_words_of_the_table_equal_those_of_its_articles(spark, small):
    """No page of the table is trained on, so all are held out: precision and recall of words are 1."""
    html = {r.page_id: r.html or "" for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = {r.page_id: r for r in op4_html_extraction(spark, small).collect()}
    assert got.keys() == html.keys()
    for i, page in html.items():
        reader = Article()
        reader.feed(page)
        reader.close()
        assert got[i].text.split() == "".join(reader.text).split(), i
        assert got[i].text == "\n\n".join(" ".join(b.split()) for b in got[i].text.split("\n\n")) and "\n\n\n" not in got[i].text


def test_stray_quotes_end_with_their_tag():
    crf = trained()
    page = '<html><body><nav><a href="/x">x</a></nav><article><h1>A title of it</h1><p title="x>Hello there, this is a paragraph of some words.</p><p>And another one, which is long enough to be read.</p></article></body></html>'
    assert crf.extract(page) == ["A title of it", "Hello there, this is a paragraph of some words.", "And another one, which is long enough to be read."]


def test_names_count_near_a_block():
    """A wrapper of any name around an article hides nothing; boxes inside an article go by their names."""
    crf, text, more = trained(), "<p>Some text of it, with many words in it. And more.</p>", "<p>And then the last text, which is here.</p>"
    plain = ["Some text of it, with many words in it. And more.", "And then the last text, which is here."]
    for page in (
        f'<div class="wp-related"><article>{text}{more}</article></div>',
        f'<body class="has-sidebar menu-open"><div id="page-sidebar-wrap"><main>{text}{more}</main></div></body>',
        f'<article>{text}<div class="newsletter"><p>Subscribe to our newsletter now, please.</p></div>{more}</article>',
        f'<article>{text}<div class="share-box"><div><ul><li><a href="/f">Share this</a></li></ul></div></div>{more}</article>',
        f'<article>{text}{more}</article><aside class="related"><article><h3>Other</h3><p>Teaser text of that one.</p></article></aside>',
        f'<div class="menu"><ul><li><a href="/x">Home page</a></li></ul></div><article>{text}{more}</article><section id="comments"><div class="comment"><p>Nice one, thanks for all of it!</p></div></section>',
    ):
        assert crf.extract(page) == plain, page
