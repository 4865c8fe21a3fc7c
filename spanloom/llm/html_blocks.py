"""Main text of HTML pages by a recurrent block labeller.

A page is a sequence of leaf blocks.  Each block has a vector of its tag path
(hashed tags, classes and roles of its ancestors), one of its words (hashed),
and a few shape numbers; a bidirectional LSTM reads the whole sequence and
labels every block as main text or not.  The network is trained here, on pages
put together from blocks of a bounded sample and from a set of layouts with
known labels; everything runs in numpy over many pages at once.
"""

from __future__ import annotations

import html as entities
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

# Fixed values of HTML: which elements hold no text, end a block, or have no end tag.
SILENT = frozenset("script style noscript template svg iframe object canvas head title select datalist audio video".split())
#: Of these: without an end tag the rest of the page is theirs; any other is then passed over as if it were empty.
RAW = frozenset("script style title".split())
#: Elements nested deeper than this have the path of the element at this depth, as in browsers.
DEPTH = 512
BREAKING = frozenset(
    (
        "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3"
        " h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul"
    ).split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Opening one of these ends an open one of the second list (end tags that may be left out).
IMPLIED = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
CLOSES_P = BREAKING - {"body", "html", "button", "label", "legend", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "summary", "figcaption"}
SCOPE = frozenset("ul ol dl table td th button body html".split())

_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_MARK = re.compile(r"(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_WORD = re.compile(r"[a-z]+")

TAG_DIM, WORD_DIM, SHAPE_DIM = 96, 64, 10
INPUT_DIM = TAG_DIM + WORD_DIM + SHAPE_DIM


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int  # characters inside links


def _marks(tag: str, attributes: str) -> tuple[str, ...]:
    """Path tokens of one element: its tag and the words of its class, id and role."""
    out = [tag]
    if attributes:
        for name, value in _MARK.findall(attributes):
            name = name.lower()
            if name in ("hidden", "aria-hidden"):
                if value.strip("\"'").lower() != "false":
                    out.append("*hidden")
            else:
                out += _WORD.findall(value.lower())
    return tuple(out)


def tags(page: str) -> Iterator[tuple[int, int, str | None, str]]:
    """(start, end, name, attributes) of tags in order; the name of an end tag begins with ``/``, that of a comment or declaration is None.

    One pass: a quoted value reaches to its closing quote.  If a quote is never
    closed, tags from there on end at the next ``>``, whatever the quotes; one
    without it is text.  The reader may send the place to go on from.
    """
    at, quoted = 0, True
    while (start := page.find("<", at)) >= 0:
        at = start + 1
        if page.startswith("<!--", start):
            stop = page.find("-->", start + 4)
            end = stop + 3 if stop >= 0 else len(page)
            at = (yield start, end, None, "") or end
            continue
        if page[at : at + 1] in ("!", "?"):
            stop = page.find(">", at)
            end = stop + 1 if stop >= 0 else len(page)
            at = (yield start, end, None, "") or end
            continue
        m = _NAME.match(page, start)
        if not m:
            continue
        end = -1
        if quoted:
            k = m.end()
            while (stop := _STOP.search(page, k)) and stop[0] != ">":
                k = page.find(stop[0], stop.end()) + 1
                if not k:
                    stop = None
                    break
            quoted = stop is not None
            end = stop.end() if stop else -1
        if not quoted:
            end = page.find(">", m.end()) + 1
            if not end:
                return
        name = m[1].lower()
        at = (yield start, end, "/" + name if page[start + 1] == "/" else name, page[m.end() : end - 1]) or end


def _end_of(page: str, tag: str, at: int, known: dict[str, tuple[int, int]]) -> tuple[int, int] | None:
    """Place of the next end tag of an element; each is searched for once."""
    found = known.get(tag)
    if found is None or (found[0] >= 0 and found[0] < at):
        m = re.compile(rf"</{re.escape(tag)}\s*/?>", re.I).search(page, at)
        found = known[tag] = (m.start(), m.end()) if m else (-1, -1)
    return found if found[0] >= 0 else None


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page in order: white space collapsed and trimmed, character references decoded, empty ones left out.

    A block ends where an element that is not inline begins or ends.  Elements
    without an end tag are closed as HTML does; a page that breaks off is read
    to its end.  Script, style and other elements without text of their own are
    skipped whole; one that is never closed, or only behind another one of its name,
    hides nothing that follows it.  Time and memory grow with the page, also for
    pages of unclosed quotes or elements.
    """
    if not page:
        return []
    out, parts, linked, in_link = [], [], 0, 0
    stack: list[str] = []
    paths: list[tuple[str, ...]] = [()]
    opened: Counter[str] = Counter()
    at, end = 0, len(page)
    ends: dict[str, tuple[int, int]] = {}
    starts: dict[str, int] = {}

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Block(paths[-1], text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def close(tag: str) -> None:
        nonlocal in_link
        while stack:
            top = stack.pop()
            opened[top] -= 1
            if top in BREAKING:
                flush()
            paths.pop()
            in_link -= top == "a"
            if top == tag:
                break

    def hidden(tag: str, at: int) -> int:
        """Where reading goes on behind a silent element that begins here: its end, or right here if it isn't closed on its own."""
        if tag == "head":  # its end tag may be missing
            stop = re.compile(r"</head\s*>|<body[\s>]", re.I).search(page, at)
            return (stop.end() if stop[0][1] == "/" else stop.start()) if stop else at
        stop = _end_of(page, tag, at, ends)
        if tag in RAW:
            return stop[1] if stop else end
        if not stop:
            return at
        if starts.get(tag, -1) < at:
            again = re.compile(rf"<{re.escape(tag)}[\s/>]", re.I).search(page, at)
            starts[tag] = again.start() if again else end
        return stop[1] if starts[tag] > stop[0] else at

    reader, go = tags(page), None
    while True:
        try:
            token = reader.send(go)
        except StopIteration:
            token = None
        go = None
        piece = page[at : token[0]] if token else page[at:]
        if piece:
            parts.append(piece)
            if in_link:
                linked += len(piece.strip())
        if not token:
            break
        _, at, tag, attributes = token
        if tag is None:
            continue
        if tag[0] == "/":
            tag = tag[1:]
            if opened[tag]:
                close(tag)
            elif tag == "br":
                parts.append(" ")
            elif tag in BREAKING:
                flush()
            continue
        if tag in SILENT and not attributes.endswith("/"):
            at = go = hidden(tag, at)
            if tag not in ("script", "style", "noscript", "template", "head"):
                parts.append(" ")
            continue
        if tag in BREAKING:
            flush()
        if tag in CLOSES_P and opened["p"]:
            close("p")
        for other in IMPLIED.get(tag, ()):
            if not opened[other]:
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k] == other:
                    close(other)
                    break
                if stack[k] in SCOPE:
                    break
        if tag in VOID:
            if tag not in ("wbr",):
                parts.append(" ")
            continue
        if attributes.endswith("/") and tag not in BREAKING:
            continue
        stack.append(tag)
        opened[tag] += 1
        paths.append(paths[-1] + _marks(tag, attributes) if len(stack) <= DEPTH else paths[-1])
        in_link += tag == "a"
    flush()
    return out


def _bucket(token: str, size: int) -> tuple[int, float]:
    h = zlib.crc32(token.encode())
    return h % size, 1.0 if h >> 31 else -1.0


_PATHS: dict[tuple[str, ...], np.ndarray] = {}


def path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Signed hashed counts of the path's tokens; the nearest ancestors count double."""
    known = _PATHS.get(path)
    if known is None:
        known = np.zeros(TAG_DIM, dtype=np.float32)
        for k, token in enumerate(path):
            i, sign = _bucket(token, TAG_DIM)
            known[i] += sign * (1.0 if k < len(path) - 2 else 2.0)
        known = np.tanh(known / 2)
        if len(_PATHS) < 50_000:
            _PATHS[path] = known
    return known


_LETTER_VALUE = np.random.default_rng(3).integers(1, 2**31, 256, dtype=np.uint32)


def word_vectors(texts: list[str]) -> np.ndarray:
    """Scaled hashed word counts of whole blocks, vectorised over their bytes."""
    parts = [t.lower().encode("utf-8", "surrogatepass") + b" " for t in texts]
    raw = np.frombuffer(b"".join(parts), dtype=np.uint8)
    out = np.zeros((len(texts), WORD_DIM), dtype=np.float32)
    if not len(texts):
        return out
    ends = np.cumsum([len(x) for x in parts])
    blank = raw == 32
    stop = np.flatnonzero(blank)
    start = np.concatenate(([0], stop[:-1] + 1))
    value = _LETTER_VALUE[raw]
    value[blank] = 0
    # a word's value is the sum of its letters' values and of those of letter pairs
    value[1:] += (value[1:] * np.uint32(31)) ^ (_LETTER_VALUE[raw[:-1]] * np.uint32(7)) * ~blank[1:] * ~blank[:-1]
    h = np.add.reduceat(value, start, dtype=np.uint32) * np.uint32(2654435761)
    row = np.searchsorted(ends, start, side="right")
    keep = stop > start
    flat = np.bincount(row[keep] * WORD_DIM + (h[keep] >> np.uint32(26)).astype(np.int64), minlength=len(texts) * WORD_DIM)
    out = np.sqrt(flat.reshape(len(texts), WORD_DIM).astype(np.float32))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)


def shape_vector(b: Block, at: int, n: int) -> list[float]:
    size = len(b.text)
    words = b.text.count(" ") + 1
    stops = b.text.count(".") + b.text.count("!") + b.text.count("?")
    return [
        math.log1p(size) / 8, math.log1p(words) / 6, b.linked / size, min(1.0, stops / 5), min(1.0, b.text.count(",") / 5),
        1.0 if b.text[-1] in ".!?…»”\"" else 0.0, min(1.0, size / words / 10), at / n, math.log1p(n) / 5, 1.0,
    ]


def page_matrix(pages: list[list[Block]]) -> list[np.ndarray]:
    """One input matrix (blocks x features) per page."""
    flat = [b for p in pages for b in p]
    words, at, out = word_vectors([b.text for b in flat]), 0, []
    for p in pages:
        n = len(p)
        if n:
            shape = np.array([shape_vector(b, k, n) for k, b in enumerate(p)], dtype=np.float32)
            out.append(np.concatenate([np.stack([path_vector(b.path) for b in p]), words[at : at + n], shape], axis=1))
        else:
            out.append(np.zeros((0, INPUT_DIM), dtype=np.float32))
        at += n
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class BiLSTM:
    """Two LSTMs over a padded batch, one for each direction, and a logistic output per block."""

    def __init__(self, hidden: int = 24, seed: int = 1):
        rng, self.hidden = np.random.default_rng(seed), hidden
        init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p |= {f"wx{d}": init(INPUT_DIM, 4 * hidden), f"wh{d}": init(hidden, 4 * hidden), f"b{d}": np.zeros(4 * hidden, np.float32)}
            self.p[f"b{d}"][hidden : 2 * hidden] = 1.0  # forget gates start open
        self.p |= {"wo": init(2 * hidden, 1), "wi": init(INPUT_DIM, 1) * 0.1, "bo": np.zeros(1, np.float32)}

    @staticmethod
    def padded(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        steps = max(len(x) for x in xs)
        out, mask = np.zeros((steps, len(xs), INPUT_DIM), np.float32), np.zeros((steps, len(xs), 1), np.float32)
        for k, x in enumerate(xs):
            out[: len(x), k], mask[: len(x), k] = x, 1
        return out, mask

    def _pass(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        h_n, steps = self.hidden, range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        pre = x @ self.p[f"wx{d}"] + self.p[f"b{d}"]
        h, c = np.zeros((x.shape[1], h_n), np.float32), np.zeros((x.shape[1], h_n), np.float32)
        out, memo = np.zeros((*x.shape[:2], h_n), np.float32), []
        for t in steps:
            g = pre[t] + h @ self.p[f"wh{d}"]
            i, f, o, z = _sigmoid(g[:, :h_n]), _sigmoid(g[:, h_n : 2 * h_n]), _sigmoid(g[:, 2 * h_n : 3 * h_n]), np.tanh(g[:, 3 * h_n :])
            new_c = f * c + i * z
            tc = np.tanh(new_c)
            if keep:
                memo.append((t, h, c, i, f, o, z, tc))
            m = mask[t]  # past the end of a page the state stays as it is
            h, c = m * (o * tc) + (1 - m) * h, m * new_c + (1 - m) * c
            out[t] = h
        return out, memo

    def predict(self, xs: list[np.ndarray], batch: int = 64) -> list[np.ndarray]:
        """Probability of main text for every block; pages of like length share a batch."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(xs)
        order = sorted((k for k in range(len(xs)) if len(xs[k])), key=lambda k: len(xs[k]))
        at = 0
        while at < len(order):
            size = max(1, min(batch, 200_000 // len(xs[order[min(at + batch, len(order)) - 1]])))
            ks = order[at : at + size]
            x, mask = self.padded([xs[k] for k in ks])
            both = np.concatenate([self._pass(x, mask, d, False)[0] for d in "fb"], axis=2)
            p = _sigmoid(both @ self.p["wo"] + x @ self.p["wi"] + self.p["bo"])[..., 0]
            for n, k in enumerate(ks):
                out[k] = p[: len(xs[k]), n]
            at += size
        return out

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        h_n = self.hidden
        (hf, mf), (hb, mb) = (self._pass(x, mask, d, True) for d in "fb")
        both = np.concatenate([hf, hb], axis=2)
        p = _sigmoid(both @ self.p["wo"] + x @ self.p["wi"] + self.p["bo"])
        total = mask.sum()
        loss = float(-(mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / total)
        d_out = mask * (p - y) / total
        grad = {"wo": np.einsum("tbh,tbo->ho", both, d_out), "wi": np.einsum("tbi,tbo->io", x, d_out), "bo": d_out.sum(axis=(0, 1))}
        d_both = d_out @ self.p["wo"].T
        for d, memo, part in (("f", mf, d_both[..., :h_n]), ("b", mb, d_both[..., h_n:])):
            d_pre, gw = np.zeros((*x.shape[:2], 4 * h_n), np.float32), np.zeros_like(self.p[f"wh{d}"])
            dh, dc = np.zeros_like(memo[0][1]), np.zeros_like(memo[0][1])
            for t, h, c, i, f, o, z, tc in reversed(memo):
                m = mask[t]
                dh = dh + part[t]
                live_h, live_c = dh * m, dc * m
                cell = live_c + live_h * o * (1 - tc**2)
                g = np.concatenate([cell * z * i * (1 - i), cell * c * f * (1 - f), live_h * tc * o * (1 - o), cell * i * (1 - z**2)], axis=1)
                d_pre[t] = g
                gw += h.T @ g
                dh = g @ self.p[f"wh{d}"].T + dh * (1 - m)
                dc = cell * f + dc * (1 - m)
            grad |= {f"wh{d}": gw, f"wx{d}": np.einsum("tbi,tbg->ig", x, d_pre), f"b{d}": d_pre.sum(axis=(0, 1))}
        return loss, grad

    def fit(self, xs: list[np.ndarray], ys: list[np.ndarray], epochs: int = 6, batch: int = 32, rate: float = 0.01, seed: int = 2) -> BiLSTM:
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        step, plan = 0, sorted(range(len(xs)), key=lambda k: len(xs[k]))
        groups = [plan[k : k + batch] for k in range(0, len(plan), batch)]
        for epoch in range(epochs):
            for g in rng.permutation(len(groups)):
                x, mask = self.padded([xs[k] for k in groups[g]])
                y = np.zeros_like(mask)
                for n, k in enumerate(groups[g]):
                    y[: len(ys[k]), n, 0] = ys[k]
                _, grad = self.gradients(x, mask, y)
                step += 1
                norm = np.sqrt(sum(float((a**2).sum()) for a in grad.values()))
                for k, a in grad.items():
                    a = a * min(1.0, 1.0 / (norm + 1e-9)) + 1e-5 * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * a
                    v[k] = 0.99 * v[k] + 0.01 * a**2
                    now = rate * (0.3 if epoch >= epochs - 2 else 1.0)
                    self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self
