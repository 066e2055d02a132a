"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read tag by tag (repairing what browsers repair: unclosed paragraphs, list items, cells, stray end tags). A leaf block
is the run of text inside one block element; inline tags and line breaks don't end it. Each block has features of its ancestors
(tags, words of class, id and role) and of its text (length, links, punctuation). A CRF with labels boilerplate and content
scores blocks and transitions; it is fitted by gradient ascent on the exact conditional likelihood (forward-backward) of pages
whose blocks are labelled, and decoded by Viterbi. The labelled pages are made by training_pages(): seeded pages of many
layouts whose blocks know what they are.

Defined results: null or empty html and pages without content blocks give an empty text with n_chars 0; an unclosed comment,
script or style hides the rest of the page; a tag whose quotes have no end goes up to the next ">"; repeated rows are extracted each; extra columns of the input are left out.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, table, text_or_empty

TAG = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+(?=>)|[^>]*)>|[!?/][^>]*>)")
HIDDEN = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "select", "math", "canvas", "audio", "video"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input link meta base area col embed source track param nobr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": set()}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
CONTENT_TAGS, NEAR = {"article", "main"}, 3
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


#: What marks boilerplate in the names that sites give to its containers.
BOILERPLATE_NAMES = "ad ads advert advertisement banner promo sponsored sponsor sidebar side widget menu nav navbar navigation breadcrumb breadcrumbs topbar header masthead footer foot bottom cookie consent notice alert popup modal newsletter subscribe signup login form search comment comments discussion respond reply disqus related recommended share social tags toolbar copyright legal".split()
CONTENT_NAMES = "content article post entry body main story text page".split()
BOILERPLATE, CONTENT = set(BOILERPLATE_NAMES), set(CONTENT_NAMES)


class Contexts:
    """Ancestor paths as numbers: the features of a path are found once.

    Words of class, id and role count as inherited (name), and once more where they are of the element itself or of the NEAR ones above, up to an article (near, marked).
    """

    def __init__(self) -> None:
        self.features: list[frozenset[str]] = [frozenset()]
        self.names: list[set[str]] = [set()]
        self.parents: list[int] = [0]
        self.tags: list[str] = [""]
        self.known: dict[tuple[int, str, str], int] = {}

    def child(self, parent: int, tag: str, attributes: str) -> int:
        names = attributes if "=" in attributes and NAMES.search(attributes) else ""
        key = (parent, tag, names)
        found = self.known.get(key)
        if found is None:
            if len(self.features) > 200_000:  # odd pages: numbers of this page stay valid, later ones start anew
                self.known.clear()
            parts = {p.lower() for m in NAMES.finditer(names) for p in PART.findall(m[1] or m[2] or m[3] or "")}
            inherited = {f for f in self.features[parent] if not f.startswith(("tag:", "near:", "marked:"))}
            near, above = set(parts), parent
            for _ in range(0 if tag in CONTENT_TAGS else NEAR):
                near |= self.names[above]
                above = 0 if self.tags[above] in CONTENT_TAGS else self.parents[above]
            found = len(self.features)
            marks = {f"marked:{k}" for k, words in enumerate((CONTENT, BOILERPLATE)) if near & words}
            self.features.append(frozenset(inherited | marks | {f"in:{tag}", f"tag:{tag}"} | {f"name:{p}" for p in parts} | {f"near:{p}" for p in near}))
            self.tags.append(tag)
            self.names.append(parts)
            self.parents.append(parent)
            self.known[key] = found
        return found


def leaf_blocks(html: str, contexts: Contexts) -> list[tuple[int, str, int]]:
    """(context, text, characters inside links) of all leaf blocks in page order."""
    out: list[tuple[int, str, int]] = []
    stack: list[tuple[str, int]] = [("", 0)]
    pieces: list[str] = []
    linked = 0
    in_link = False
    at, search, child = 0, TAG.search, contexts.child

    def flush() -> None:
        nonlocal linked, in_link
        if pieces:
            text = "".join(pieces)
            if "&" in text:
                text = unescape(text)
            text = " ".join(text.split())
            if text:
                out.append((stack[-1][1], text, linked))
            pieces.clear()
        linked, in_link = 0, False

    while True:
        m = search(html, at)
        if m is None:
            pieces.append(html[at:])
            break
        start, end = m.span()
        if start > at:
            piece = html[at:start]
            pieces.append(piece)
            if in_link:
                linked += len(piece.strip())
        at = end
        closing, tag, attributes = m.groups()
        if tag is None:
            if html.startswith("<!--", start):
                stop = html.find("-->", start + 4)
                at = len(html) if stop < 0 else stop + 3
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                in_link = not closing
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in HIDDEN:
            if not closing and not attributes.endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
                at = len(html) if stop is None else stop.end()
            continue
        flush()
        if closing:
            heading = tag in HEADINGS
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag or heading and stack[k][0] in HEADINGS:
                    del stack[k:]
                    break
        elif tag != "hr":
            shut, scope = CLOSES.get(tag), SCOPE.get(tag, ())
            if shut:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in shut:
                        del stack[k:]
                        break
                    if stack[k][0] in scope:
                        break
            elif stack[-1][0] == "p":  # a block ends an open paragraph
                stack.pop()
            if not attributes.endswith("/"):
                stack.append((tag, child(stack[-1][1], tag, attributes)))
    flush()
    return out


def text_features(text: str, linked: int) -> tuple[str, ...]:
    n = len(text)
    words = text.count(" ") + 1
    size = 0 if n < 12 else 1 if n < 30 else 2 if n < 80 else 3 if n < 200 else 4
    links = 0 if not linked else 1 if linked * 3 < n else 2 if linked * 5 < n * 4 else 3
    end = text[-1]
    last = "stop" if end in ".!?…。！？\"”»" else "colon" if end in ":;," else "none"
    mark = "c" if "©" in text or "(c)" in text[:40].lower() else "|" if "|" in text or "»" in text or "·" in text else "-"
    return (f"size:{size}", f"links:{links}", f"end:{last}", f"mark:{mark}", f"words:{min(words, 6)}", f"long:{size > 2 and links < 2 and last == 'stop'}")


class Crf:
    """Two labels: 0 boilerplate, 1 content. weights[f]: score of label 1 against 0; transitions[a, b], start[b]."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, transitions: np.ndarray, start: np.ndarray):
        self.index, self.weights, self.transitions, self.start = index, weights, transitions, start
        self.contexts = Contexts()
        self._context: dict[int, float] = {}
        self._text: dict[tuple[str, ...], float] = {}

    def potentials(self, blocks: list[tuple[int, str, int]]) -> list[float]:
        def total(features) -> float:
            return float(sum(self.weights[self.index[f]] for f in features if f in self.index))

        out = []
        for context, text, linked in blocks:
            a = self._context.get(context)
            if a is None:
                a = self._context[context] = total(self.contexts.features[context])
            own = text_features(text, linked)
            b = self._text.get(own)
            if b is None:
                b = self._text[own] = total(own)
            out.append(a + b)
        return out

    def viterbi(self, scores: list[float]) -> list[int]:
        if not scores:
            return []
        (t00, t01), (t10, t11) = self.transitions.tolist()
        zero, one = self.start[0], self.start[1] + scores[0]
        back = []
        for s in scores[1:]:
            from_zero = zero + t00 >= one + t10
            from_one = zero + t01 >= one + t11
            zero, one = (zero + t00 if from_zero else one + t10), s + (zero + t01 if from_one else one + t11)
            back.append((0 if from_zero else 1, 0 if from_one else 1))
        label = int(one > zero)
        out = [label]
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return out[::-1]

    def extract(self, html: str) -> list[str]:
        if len(self.contexts.features) > 200_000:
            self.contexts, self._context = Contexts(), {}
        blocks = leaf_blocks(html, self.contexts)
        return [b[1] for b, label in zip(blocks, self.viterbi(self.potentials(blocks)), strict=True) if label]


def fit(pages: list[tuple[list[tuple[str, ...]], list[int]]], steps: int = 400, rate: float = 0.1, ridge: float = 1e-5) -> Crf:
    """pages: each block's features, and labels. Adam on the exact gradient of the conditional log-likelihood."""
    pages = [p for p in pages if p[1]]
    index: dict[str, int] = {}
    for blocks, _ in pages:
        for features in blocks:
            for f in features:
                index.setdefault(f, len(index))
    width, depth = len(pages), max(len(y) for _, y in pages)
    cell, feature, labels, real = [], [], np.zeros((depth, width), dtype=int), np.zeros((depth, width), dtype=bool)
    for p, (blocks, y) in enumerate(pages):
        labels[: len(y), p], real[: len(y), p] = y, True
        for t, features in enumerate(blocks):
            feature += [index[f] for f in features]
            cell += [t * width + p] * len(features)
    cell_, feature_ = np.array(cell), np.array(feature)
    both = real[1:] & real[:-1]
    count_pair = np.zeros((2, 2))
    np.add.at(count_pair, (labels[:-1][both], labels[1:][both]), 1)
    count_start = np.bincount(labels[0], minlength=2)
    theta = np.zeros(len(index) + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, tr, st = theta[:-6], theta[-6:-2].reshape(2, 2), theta[-2:]
        s = np.zeros((depth, width, 2))
        s[:, :, 1] = np.bincount(cell_, w[feature_], depth * width).reshape(depth, width)
        alpha, beta = np.zeros_like(s), np.zeros_like(s)
        alpha[0] = st + s[0]
        for t in range(1, depth):
            step_in = np.logaddexp(alpha[t - 1, :, :1] + tr[0], alpha[t - 1, :, 1:] + tr[1]) + s[t]
            alpha[t] = np.where(real[t][:, None], step_in, alpha[t - 1])
        for t in range(depth - 2, -1, -1):
            ahead = s[t + 1] + beta[t + 1]
            step_back = np.logaddexp(tr[:, 0] + ahead[:, :1], tr[:, 1] + ahead[:, 1:])
            beta[t] = np.where(real[t + 1][:, None], step_back, 0)
        z = np.logaddexp(alpha[-1, :, 0], alpha[-1, :, 1])
        p_one = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z)
        grad_cell = np.where(real, labels - p_one, 0).ravel()
        grad = np.zeros_like(theta)
        grad[:-6] = np.bincount(feature_, grad_cell[cell_], len(index))
        for a in range(2):
            for b in range(2):
                joint = np.exp(alpha[:-1, :, a] + tr[a, b] + s[1:, :, b] + beta[1:, :, b] - z)
                grad[-6 + 2 * a + b] = count_pair[a, b] - joint[both].sum()
        grad[-2:] = count_start - np.exp(alpha[0] + beta[0] - z[:, None]).sum(axis=0)
        grad = grad / width - ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Crf(index, theta[:-6].copy(), theta[-6:-2].reshape(2, 2).copy(), theta[-2:].copy())


# ---- labelled pages ------------------------------------------------------------------------------------------------

def _sentence(r: random.Random, low: int, high: int, stop: str = ".") -> str:
    return " ".join("".join(r.choice(["ka", "ro", "mi", "ten", "sul", "ver", "an", "ish", "ou", "é", "ñu", "der"]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))).capitalize() + stop


def _prose(r: random.Random, odd: float = 0.0) -> str:
    if r.random() < odd:  # no sentences: repeated words, rows of cells, bare strings
        word = _sentence(r, 1, 1, "")
        return r.choice([" ", " | ", ", "]).join([word] * r.choice([1, 4, 20, 120, 400]))
    return " ".join(_sentence(r, 1, 14, r.choice(["...", ".", ".", ".", "!", "?"])) for _ in range(r.choice([1, 1, 2, 3, 5])))


def training_pages(count: int = 1500, seed: int = 11) -> list[list[tuple[str, int]]]:
    """Pages as lists of (html, label of the leaf blocks in it); joined they are the page. Labels: 1 content, 0 boilerplate."""
    r = random.Random(seed)
    out = []
    for _ in range(count):
        page: list[tuple[str, int]] = [("<html><head><title>x</title></head><body>", 0)]
        name = r.choice

        def boiler(page=page) -> None:
            words = [r.choice([_sentence(r, 1, 3, r.choice(["", ".", ","])), _sentence(r, 3, 14, r.choice(["", ".", "!"])), _prose(r)]) for _ in range(r.randint(1, 7))]
            kind = r.randrange(9)
            names = " ".join(r.sample(BOILERPLATE_NAMES, r.choice([1, 1, 2])))
            mark = r.choice([f' class="{names}"', f' id="{names.split()[0]}"', f' class="x-{names.replace(" ", "-")}"'])
            if kind <= 2:
                tag = r.choice(["nav", "nav", "header", "aside", "footer", "div"])
                page.append((f"<{tag}{mark if tag == 'div' or r.random() < 0.4 else ''}><ul>", 0))
                page.extend((f'<li><a href="/{i}">{w}</a></li>' if r.random() < 0.8 else f"<li>{w}</li>", 0) for i, w in enumerate(words))
                page.append((f"</ul></{tag}>", 0))
            elif kind == 3:
                page.append((f"<footer>&copy; {words[0]} &middot; {words[-1]}</footer>", 0))
            elif kind == 4:
                page.append((f"<form{mark if r.random() < 0.3 else ''}><label>{words[0]}</label><input name=q><button>{words[-1]}</button></form>", 0))
            elif kind == 5:
                tag = r.choice(["section", "div", "ol", "aside"])
                own = r.choice(["comments", "comment-list", "commentlist", "reader-comments", "discussion", "replies"])
                inner = "li" if tag == "ol" else r.choice(["div", "p", "article"])
                page.append((f'<{tag} {r.choice(["class", "id"])}="{own}">', 0))
                page.extend((f'<{inner}{r.choice(["", chr(32) + "class=" + chr(34) + "comment" + chr(34)])}>{w} {_prose(r)}</{inner}>', 0) for w in words)
                page.append((f"</{tag}>", 0))
            else:
                tag = r.choice(["div", "div", "section", "aside", "p", "header", "footer"])
                inner = "" if tag == "p" else r.choice(["", "p", "span", "h3"])
                page.append((f"<{tag}{mark if tag in ('div', 'section', 'p') or r.random() < 0.5 else ''}>", 0))
                page.extend(((f"<{inner}>{w}</{inner}>" if inner else w), 0) for w in words[: 1 if not inner or inner == "span" else 3])
                page.append((f"</{tag}>", 0))

        for _ in range(r.randint(0, 3)):
            boiler()
        container = r.choice(["<article>", "<article>", "<article>", "<main>", "<main><article>", f'<div class="{name(CONTENT_NAMES)}">', f'<div id="{name(CONTENT_NAMES)}"><article class="{name(CONTENT_NAMES)}">', f'<section class="{name(CONTENT_NAMES)}-body">', "<div>"])
        wrapper = ""
        if r.random() < 0.3:  # a page's wrapper may have any names
            wrapper = f'<div {r.choice(["class", "id"])}="{"-".join(r.sample(BOILERPLATE_NAMES + CONTENT_NAMES, 2))}">'
            container = wrapper + r.choice(["", "<div>"]) + container
        page.append((container, 0))
        if r.random() < 0.8:
            page.append((f"<h1>{_sentence(r, 1, 12, r.choice(['', '.', '!']))}</h1>", 1))
        for _ in range(r.choice([0, 1, 2, 3, 5, 8, 12])):
            kind = r.randrange(19)
            if kind <= 7:
                page.append((r.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", '<p>{} <a href="/x">more here</a> and on.</p>']).format(_prose(r, 0.1)), 1))
            elif kind == 8:
                page.append((f"<h{r.choice('23')}>{_sentence(r, 1, 6, '')}</h2>", 1))
            elif kind == 9:
                page.append(("<ul>", 0))
                page.extend((f"<li>{_sentence(r, 1, 9, r.choice(['', '.']))}</li>", 1) for _ in range(r.randint(1, 5)))
                page.append(("</ul>", 0))
            elif kind == 10:
                page.append((f"<blockquote>{_prose(r)}</blockquote>", 1))
            elif kind == 11:
                page.append((f"<pre>{_sentence(r, 2, 9, '')}</pre>", 1))
            elif kind == 12:
                page.append((f"<table><tr><td>{_sentence(r, 1, 4, '')}</td><td>{_sentence(r, 1, 4, '')}</td></tr></table>", 1))
            elif r.random() < 0.8:
                boiler()
        if r.random() < 0.25:
            boiler()
        page.append(("".join("</" + re.match(r"\w+", t)[0] + ">" for t in reversed(container.split("<")[1:])), 0))
        for _ in range(r.randint(0, 3)):
            boiler()
        page.append(("</body></html>", 0))
        out.append(page)
    return out


def labelled_blocks(page: list[tuple[str, int]], contexts: Contexts) -> tuple[list[tuple[str, ...]], list[int]]:
    """Features and labels of a training page's blocks: marks in the text tell which part a block came from."""
    marked = "".join(re.sub(r"(>|^)([^<>\s][^<>]*)(?=<|$)", lambda m, k=k: f"{m[1]}{chr(0xE000 + label)}{m[2]}", part) for k, (part, label) in enumerate(page))
    features, labels = [], []
    for context, text, linked in leaf_blocks(marked, contexts):
        label = int(chr(0xE001) in text)
        clean = text.replace(chr(0xE000), "").replace(chr(0xE001), "")
        if clean:
            features.append((*sorted(contexts.features[context]), *text_features(clean, linked)))
            labels.append(label)
    return features, labels


@lru_cache(maxsize=2)
def trained(count: int = 1500, seed: int = 11) -> Crf:
    contexts = Contexts()
    return fit([labelled_blocks(p, contexts) for p in training_pages(count, seed)])


def extract_pages(pages: DataFrame, model: Crf, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_blocks (content blocks)."""
    bounded_batches(pages.sparkSession, 256)
    shared = pages.sparkSession.sparkContext.broadcast((model.index, model.weights, model.transitions, model.start))
    source = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), text_or_empty(html).alias("__html"))
    schema = source.drop("__html").schema.add("text", "string").add("n_chars", "long").add("n_blocks", "integer")

    def run(batches):
        crf = Crf(*shared.value)
        for batch in batches:
            blocks = [crf.extract(x.as_py()) for x in batch.column("__html")]
            texts = ["\n\n".join(b) for b in blocks]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(map(len, blocks), pa.int32())], names=schema.names)

    return source.mapInArrow(run, schema)


def op4_html_extraction(spark, sf_dir: str) -> DataFrame:
    """The main text of every page, from its whole html; null counts as empty."""
    return extract_pages(table(spark, sf_dir, "pages"), trained())
