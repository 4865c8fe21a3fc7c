"""Training of the block labeller and extraction of main texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from spanloom.llm.html_blocks import BiLSTM, Block, blocks, page_matrix

#: Marks main blocks of made pages until they are labelled; a private-use character.
_MAIN = ""

# Words of tags, classes, ids and roles with which pages name their parts.
MAIN_TAGS = frozenset("article main".split())
OTHER_TAGS = frozenset("nav footer aside form button menu dialog".split())
OTHER_WORDS = frozenset(
    (
        "nav navbar navigation menu menubar breadcrumb breadcrumbs topbar header masthead banner logo footer copyright legal sidebar side rail widget widgets"
        " ad ads advert advertisement advertising sponsor sponsored promo promotion cookie cookies consent notice notices alert gdpr popup modal overlay"
        " subscribe newsletter signup login search share sharing social follow related recommended trending popular more tags tag pagination pager toc"
        " comment comments reply replies respond disqus discussion feedback contentinfo complementary hidden"
    ).split()
)
#: How pages wrap their main text, outermost first; the empty one is text in the body itself.
WRAPPERS = (
    ("<article>",), ("<article>",), ("<main>",), ("<main>", "<article>"), ('<div class="content">',), ('<div id="content">', "<article>"), ('<div id="main">', '<div class="post">'),
    ('<div class="post">', '<div class="entry-content">'), ('<section class="story">',), ('<div class="article-body">',), ('<div class="page">', '<div class="text">'),
    ('<article class="post">', '<div class="body">'), ('<div role="main">',), ("<table>", "<tr>", '<td class="body">'), ("<div>", "<div>"), ("<div>",), (),
    ('<div class="container">', '<div class="row">', '<div class="col main-col">'), ('<main class="site-main">', "<section>"),
)
#: (opening tags, kind of text) of other parts; several of the same kind occur under different names.
PARTS = (
    (("<nav>", "<ul>"), "links"), (('<nav class="navbar">', "<ul>"), "links"), (('<div class="menu">', "<ul>"), "links"), (('<ul class="nav">',), "links"), (('<div id="nav">',), "links"),
    (('<ul class="breadcrumbs">',), "links"), (('<div class="topbar">',), "links"), (("<header>",), "short"), (('<div class="header">',), "short"), (('<header class="site-header">', "<nav>", "<ul>"), "links"),
    (('<div id="masthead">',), "short"), (('<div role="banner">',), "short"), (("<footer>",), "prose"), (("<footer>",), "short"), (('<div class="footer">',), "prose"), (('<div id="footer">',), "links"),
    (('<div class="copyright">',), "short"), (("<footer>", "<ul>"), "links"), (("<aside>",), "prose"), (("<aside>", "<ul>"), "links"), (('<div class="sidebar">',), "prose"), (('<div id="sidebar">', "<ul>"), "links"),
    (('<div class="widget">',), "prose"), (('<div class="ad">',), "prose"), (('<div class="ad">',), "prose"), (('<div class="ads">',), "short"), (('<div class="advert">',), "prose"), (('<div class="sponsored">',), "prose"),
    (('<div class="promo">',), "prose"), (('<div class="banner">',), "prose"), (('<div class="cookie-notice">',), "prose"), (('<div class="notice">',), "prose"), (('<div class="cookie-banner">',), "prose"),
    (('<div id="consent">',), "prose"), (('<div class="alert">',), "short"), (("<form>",), "form"), (('<form class="search">',), "form"), (('<div class="newsletter">', "<form>"), "form"),
    (('<div class="subscribe">',), "prose"), (('<div class="share">',), "links"), (('<div class="social">', "<ul>"), "links"), (('<div class="related">', "<ul>"), "links"), (('<section class="recommended">',), "links"),
    (('<div class="pagination">',), "links"), (('<div class="tags">',), "links"), (('<section id="comments">', '<div class="comment">'), "prose"), (('<div class="comments">',), "prose"),
    (('<div id="comments">', "<ul>", '<li class="comment">'), "prose"), (('<section class="comments">', "<article>"), "prose"), (('<div class="comment-list">', '<div class="comment-body">'), "prose"),
)
FRONT = frozenset("nav navbar menu header topbar masthead banner breadcrumbs ad ads cookie notice consent alert search site".split())


def _closing(opened: tuple[str, ...]) -> str:
    return "".join(f"</{x[1:].split()[0].rstrip('>')}>" for x in reversed(opened))


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;")


def _phrase(rng: np.random.Generator, pool: list[str], low: int, high: int) -> str:
    words = pool[int(rng.integers(len(pool)))].split(" ")
    n = int(rng.integers(low, high + 1))
    a = int(rng.integers(max(1, len(words) - n)))
    return _escaped(" ".join(words[a : a + n]))


def _part(rng: np.random.Generator, pool: list[str], part: tuple) -> str:
    opened, kind = part
    if kind == "links":
        item = "<li><a href='/x'>{}</a></li>" if "<ul" in opened[-1] or rng.random() < 0.3 else "<a href='/x'>{}</a> "
        inside = "".join(item.format(_phrase(rng, pool, 1, 5)) for _ in range(int(rng.integers(2, 9))))
    elif kind == "short":
        inside = "".join(("<p>{}</p>", "<div>{}</div>", "{}")[int(rng.integers(3))].format(_phrase(rng, pool, 1, 8)) for _ in range(int(rng.integers(1, 3))))
    elif kind == "form":
        inside = "".join(f"<label>{_phrase(rng, pool, 1, 4)}</label><input name=a><button>{_phrase(rng, pool, 1, 2)}</button>" for _ in range(int(rng.integers(1, 4))))
    else:
        inside = "".join(("<p>{}</p>", "{}")[int(rng.random() < 0.3)].format(_phrase(rng, pool, 5, 60)) for _ in range(int(rng.integers(1, 4))))
        if rng.random() < 0.3:
            inside = f"<h3>{_phrase(rng, pool, 1, 4)}</h3>" + inside
    return "".join(opened) + inside + _closing(opened)


def _main(rng: np.random.Generator, pool: list[str]) -> list[str]:
    out = [f"<h1>{_MAIN}{_phrase(rng, pool, 2, 12)}</h1>"] if rng.random() < 0.85 else []
    for _ in range(int(rng.integers(1, 16))):
        kind = rng.random()
        if kind < 0.72:
            out.append(f"<p>{_MAIN}{_phrase(rng, pool, 1, 150)}</p>")
        elif kind < 0.8:
            out.append(f"<h2>{_MAIN}{_phrase(rng, pool, 1, 8)}</h2>")
        elif kind < 0.87:
            out.append("<ul>" + "".join(f"<li>{_MAIN}{_phrase(rng, pool, 1, 20)}</li>" for _ in range(int(rng.integers(2, 6)))) + "</ul>")
        elif kind < 0.91:
            out.append(f"<blockquote>{_MAIN}{_phrase(rng, pool, 5, 40)}</blockquote>")
        elif kind < 0.94:
            out.append(f"<figure><figcaption>{_MAIN}{_phrase(rng, pool, 3, 15)}</figcaption></figure>")
        elif kind < 0.97:
            out.append(f"<div>{_MAIN}{_phrase(rng, pool, 5, 80)}</div>")
        else:
            out.append("<table>" + "".join(f"<tr><td>{_MAIN}{_phrase(rng, pool, 1, 6)}</td><td>{_MAIN}{_phrase(rng, pool, 1, 6)}</td></tr>" for _ in range(2)) + "</table>")
    return out


def made_page(rng: np.random.Generator, pool: list[str]) -> str:
    """A page with a known division: main blocks carry the mark."""
    pick = lambda front: [p for p in PARTS if front is None or bool(FRONT & set(_names(p))) == front]
    some = lambda parts, most: [_part(rng, pool, parts[int(rng.integers(len(parts)))]) for _ in range(int(rng.integers(0, most + 1)))]
    main = _main(rng, pool)
    if rng.random() < 0.35:  # a foreign part between the paragraphs
        main.insert(int(rng.integers(1, len(main) + 1)), _part(rng, pool, PARTS[int(rng.integers(len(PARTS)))]))
    if rng.random() < 0.25:
        main += some(pick(False), 2)
    opened = WRAPPERS[int(rng.integers(len(WRAPPERS)))]
    before, after = some(pick(True), 4) + (some(pick(None), 1)), some(pick(False), 4)
    return "<html><body>" + "".join(before) + "".join(opened) + "".join(main) + _closing(opened) + "".join(after) + "</body></html>"


def _names(part: tuple) -> list[str]:
    return [w for x in part[0] for w in x.strip("<>").replace('"', " ").replace("=", " ").replace("-", " ").split()]


def taught(page: list[Block]) -> np.ndarray | None:
    """Labels of a real page from the names of its parts, or none if it doesn't name its main part."""
    y = np.zeros(len(page))
    for k, b in enumerate(page):
        y[k] = any(t in MAIN_TAGS for t in b.path) and not any(t in OTHER_TAGS or t in OTHER_WORDS for t in b.path)
    return y if y.any() else None


def train(sample: list[str], made: int = 1600, seed: int = 4) -> BiLSTM:
    """A labeller from real pages (taught by the names of their parts) and made ones over the same words."""
    real = [blocks(h) for h in sample]
    pool = [b.text for p in real for b in p if b.text.count(" ") >= 5][:20_000]
    rng = np.random.default_rng(seed)
    if len(pool) < 50:  # no pages to speak of: words of random letters
        letters = np.array(list("etaoinshrdlucmfwypvbgk"))
        word = lambda: "".join(rng.choice(letters, int(rng.integers(1, 9))))
        pool += [" ".join(word() for _ in range(60)) + "." for _ in range(200)]
    xs, ys = [], []
    for p in real:
        y = taught(p)
        if y is not None:
            xs.append(p)
            ys.append(y)
    for _ in range(made):
        p = blocks(made_page(rng, pool))
        ys.append(np.array([b.text.startswith(_MAIN) for b in p], dtype=np.float64))
        xs.append([Block(b.path, b.text.lstrip(_MAIN) or "-", b.linked) for b in p])
    return BiLSTM().fit(page_matrix(xs), ys)


def _sample(pages: DataFrame, rows: int, most_bytes: int, id_col: str, html_col: str) -> list[str]:
    usable = pages.filter(F.octet_length(html_col).between(1, most_bytes))
    n = usable.count()
    if n > rows:
        usable = usable.filter(F.pmod(F.xxhash64(id_col, F.lit(21)), F.lit(1 << 20)) < int((1 << 20) * rows / n))
    return [r[0] for r in usable.select(id_col, html_col).orderBy(id_col, html_col).select(html_col).collect()]


def extract(
    pages: DataFrame, labeller: BiLSTM | None = None, sample_rows: int = 300, sample_bytes: int = 100_000, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)
) -> DataFrame:
    """``(<id>, <keep>, text, n_chars, n_blocks)`` of every page.

    ``text`` is the blocks labelled main, in page order, joined by a line feed;
    it is empty for a null or empty page and for one without main blocks.
    Without a labeller one is trained on about ``sample_rows`` pages of at most
    ``sample_bytes`` bytes (a bound of the training sample only: every page is
    read whole).  Null ids and repeated rows are pages like others.
    """
    model = labeller or train(_sample(pages, sample_rows, sample_bytes, id_col, html_col))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), 256):
                part = pdf.iloc[k : k + 256]
                found = [blocks(h) for h in part["html"]]
                texts = ["\n".join(b.text for b, p in zip(page, share, strict=True) if p >= 0.5) for page, share in zip(found, model.predict(page_matrix(found)), strict=True)]
                out = {c: part[c] for c in part.columns if c != "html"}
                yield pd.DataFrame(out | {"text": texts, "n_chars": [len(t) for t in texts], "n_blocks": [len(p) for p in found]})

    kind = lambda c: pages.schema[c].dataType.simpleString()
    columns = (id_col, *keep)
    rows = pages.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)], F.col(html_col).alias("html"))
    schema = ", ".join(f"c{i} {kind(c)}" for i, c in enumerate(columns)) + ", text string, n_chars long, n_blocks long"
    out = rows.mapInPandas(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], "text", "n_chars", "n_blocks")
