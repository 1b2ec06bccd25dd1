"""Main text of HTML pages: a linear-chain conditional random field over DOM leaf blocks.

A page is tokenised once into leaf blocks: runs of text between block-level tags,
each with its ancestors' tags and class names.  Features are ancestor tags, class
words, the own tag, and the text's shape; the field has a state for article text
and one for everything else.  Its weights are the maximum of the regularised
conditional likelihood of labelled pages (``labelled_pages``), and Viterbi decodes
the best labelling of a whole page.  Scripts, styles, comments in the markup and the
head are no text in the first place; neither is what stands inside of ``_SKIPPED``
elements.

Defined results: null and empty html give an empty text; unclosed and crossing tags
are closed as browsers do for blocks and paragraphs; an element of ``_SKIPPED`` that is
not closed, or closes itself, is a tag without an inside; names that only begin like
one are other elements; what stands in ``math``, ``svg``, ``object`` and ``noscript`` is text like any other; character references are decoded run by run; white space inside a block becomes one space; blocks are joined by one line
feed; repeated pages are extracted alike; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from slotloom.llm.labelled_pages import labelled_pages
from slotloom.llm.shared import send
from slotloom.llm.words import tidy

TRAINING_PAGES, EPOCHS, RIDGE = 250, 120, 0.02

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(script|style)(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"'<]|\"[^\"<]*\"|'[^'<]*')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")
#: Elements whose inside isn't text of the page, if they are closed: form fields, the title, and what a page shows elsewhere or not at all.
_SKIPPED = frozenset("textarea title template iframe select".split())
#: Elements that have no inside.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that start and end a leaf block.
_BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul head".split()
)
#: What an opening tag closes, up to the nearest of the named scopes.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "form"})}
_CLOSES_P = _BLOCKS - {"label", "button", "body", "html", "option", "legend", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}


def _insides(tokens: list[re.Match]) -> dict[int, int]:
    """The closing token of each opening token of a skipped element that has one."""
    opened: dict[str, list[int]] = {}
    closed: dict[int, int] = {}
    for i, m in enumerate(tokens):
        tag = (m[3] or m[6] or "").lower()
        if tag in _SKIPPED:
            if m[2] or m[5]:
                if opened.get(tag):
                    closed[opened[tag].pop()] = i
            elif not (m[4] or m[7] or "").endswith("/"):
                opened.setdefault(tag, []).append(i)
    return closed


def leaf_blocks(html: str) -> list[tuple[tuple, str, int]]:
    """(ancestors as (tag, names) from the root, text, characters inside links) of each non-empty leaf block."""
    stack: list[tuple[str, str]] = []
    blocks: list[tuple[tuple, str, int]] = []
    parts: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks.append((tuple(x for x in stack if x[0] in _BLOCKS), text, linked))
            parts.clear()
        linked = 0

    def close(index: int) -> None:
        nonlocal links
        if any(t in _BLOCKS for t, _ in stack[index:]):
            flush()
        links -= sum(t == "a" for t, _ in stack[index:])
        del stack[index:]

    at = upto = 0
    tokens = list(_TOKEN.finditer(html))
    skipped = _insides(tokens)
    for i, m in enumerate(tokens):
        if i < upto:
            continue
        if m.start() > at:
            text = html[at : m.start()]
            # Each run for itself: a reference doesn't go on behind a tag.
            parts.append(unescape(text))
            linked += len(text) if links else 0
        at = m.end()
        tag = m[3] or m[6]
        if not tag:
            continue
        if i in skipped:
            upto = skipped[i] + 1
            at = tokens[skipped[i]].end()
            if tag.lower() not in ("title", "template"):
                parts.append(" ")
            continue
        tag, ends = tag.lower(), m[2] or m[5]
        if tag in _SKIPPED:
            continue
        if ends:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if tag not in _BLOCKS and stack[k][0] in _BLOCKS:
                    break
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            elif tag in ("br", "wbr"):
                parts.append(" " if tag == "br" else "")
            continue
        if tag in _CLOSES_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in _BLOCKS:
                    break
        if tag in _CLOSES:
            own, scope = _CLOSES[tag]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in own:
                    close(k)
                    break
                if stack[k][0] in scope:
                    break
        if tag in _BLOCKS:
            flush()
        attributes = m[4] or m[7] or ""
        names = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)).lower() if "=" in attributes else ""
        stack.append((tag, names))
        links += tag == "a"
    if at < len(html):
        parts.append(unescape(html[at:]))
    flush()
    return blocks


@lru_cache(maxsize=1 << 14)
def path_features(path: tuple) -> tuple[str, ...]:
    """Features of a block's ancestors: tags, class words, the own tag, the innermost section-like tag."""
    tags = [t for t, _ in path if t not in ("html", "body")]
    out = {f"in:{t}" for t in tags}
    for tag, names in path:
        for w in _WORDS.findall(names):
            out.add(f"name:{w}")
            out.add(f"stem:{w[:5]}")
    out.add(f"own:{tags[-1]}" if tags else "own:none")
    sections = [t for t in tags if t in ("article", "main", "nav", "aside", "header", "footer", "form", "section")]
    out.add("section:" + ">".join(sections[-2:]) if sections else "section:none")
    return tuple(sorted(out))


def text_features(text: str, linked: int) -> tuple[str, ...]:
    n = len(text)
    share = linked / n
    out = [f"size:{min(7, n.bit_length() - 1)}", f"links:{0 if share == 0 else 1 if share < 0.5 else 2}"]
    if text[-1] in ".!?":
        out.append("sentence")
    if "©" in text or "(c)" in text.lower():
        out.append("copyright")
    return tuple(out)


class ExtractionModel:
    """A linear-chain conditional random field with two states (1: article)."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray, start: np.ndarray):
        self.index, self.weights, self.moves, self.start = index, weights, moves, start
        self.known: dict[tuple, float] = {}

    def emission(self, features: tuple[str, ...]) -> float:
        """How much the features speak for article text."""
        if features not in self.known:
            if len(self.known) > 1 << 15:
                self.known.clear()
            self.known[features] = float(sum(self.weights[self.index[f]] for f in features if f in self.index))
        return self.known[features]

    def decode(self, blocks: list) -> list[int]:
        """The best labelling of a page's blocks, by Viterbi."""
        if not blocks:
            return []
        (m00, m01), (m10, m11) = self.moves.tolist()
        back, a, b = [], float(self.start[0]), float(self.start[1])
        for i, (path, text, linked) in enumerate(blocks):
            e = self.emission(path_features(path)) + self.emission(text_features(text, linked))
            if i:
                back.append((a + m00 < b + m10, a + m01 < b + m11))
                a, b = max(a + m00, b + m10), max(a + m01, b + m11)
            b += e
        state = int(b > a)
        out = [state]
        for step in reversed(back):
            state = int(step[state])
            out.append(state)
        return out[::-1]

    def extract(self, html: str | None) -> str:
        blocks = leaf_blocks(html or "")
        return "\n".join(text for (_, text, _), keep in zip(blocks, self.decode(blocks)) if keep)

    @classmethod
    def train(cls, pages: list[str], epochs: int = EPOCHS, ridge: float = RIDGE) -> ExtractionModel:
        """Maximises the pages' conditional log-likelihood by Adam; gradients by forward-backward over all pages at once."""
        rows, labels = [], []
        for html in pages:
            found = [(path_features(p) + text_features(t[1:], n), ord(t[0]) - 0xE000) for p, t, n in leaf_blocks(html) if t[0] in "\ue000\ue001" and len(t) > 1]
            rows.append([f for f, _ in found])
            labels.append([y for _, y in found])
        index = {f: i for i, f in enumerate(sorted({f for page in rows for b in page for f in b}))}
        n, longest = len(rows), max(map(len, rows))
        mask = np.zeros((n, longest), bool)
        y = np.zeros((n, longest), int)
        x = np.zeros((n, longest, len(index)), np.float32)
        for i, page in enumerate(rows):
            mask[i, : len(page)] = True
            y[i, : len(page)] = labels[i]
            for j, features in enumerate(page):
                x[i, j, [index[f] for f in features]] = 1
        flat = x.reshape(-1, len(index))
        size = len(index) + 6
        theta, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
        pairs = np.zeros((2, 2))
        both = mask[:, 1:] & mask[:, :-1]
        np.add.at(pairs, (y[:, :-1][both], y[:, 1:][both]), 1)
        starts = np.bincount(y[:, 0][mask[:, 0]], minlength=2)
        for step in range(1, epochs + 1):
            w, moves, start = theta[:-6], theta[-6:-2].reshape(2, 2), theta[-2:]
            e = np.stack([np.zeros((n, longest)), (flat @ w.astype(np.float32)).reshape(n, longest)], 2)
            forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
            forward[:, 0] = start + e[:, 0]
            for t in range(1, longest):
                s = np.logaddexp(forward[:, t - 1, 0, None] + moves[0], forward[:, t - 1, 1, None] + moves[1]) + e[:, t]
                forward[:, t] = np.where(mask[:, t, None], s, forward[:, t - 1])
            for t in range(longest - 2, -1, -1):
                s = e[:, t + 1] + backward[:, t + 1]
                s = np.logaddexp(moves[:, 0] + s[:, 0, None], moves[:, 1] + s[:, 1, None])
                backward[:, t] = np.where(mask[:, t + 1, None], s, 0)
            total = np.logaddexp(*(forward[:, 0] + backward[:, 0]).T)
            node = np.exp(forward + backward - total[:, None, None]) * mask[:, :, None]
            edge = np.exp(forward[:, :-1, :, None] + moves + (e + backward)[:, 1:, None, :] - total[:, None, None, None]) * both[:, :, None, None]
            gradient = np.concatenate([flat.T @ ((y * mask) - node[:, :, 1]).reshape(-1).astype(np.float32), (pairs - edge.sum((0, 1))).reshape(-1), starts - node[:, 0].sum(0)]) - ridge * theta
            m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
            theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return cls(index, theta[:-6], theta[-6:-2].reshape(2, 2), theta[-2:])


@cache
def trained(count: int = TRAINING_PAGES, seed: int = 0) -> ExtractionModel:
    return ExtractionModel.train(labelled_pages(count, seed))


def extracted(pages: DataFrame, model: ExtractionModel | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    sent = send(pages.sparkSession, model or trained())

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [sent.value.extract(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op8_html_extract(spark, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
