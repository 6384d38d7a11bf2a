"""Main-text extraction from web pages by a linear-chain conditional random field.

A page is a sequence of leaf blocks: runs of text between block-level tags, with
their ancestors.  Each block is described by its ancestors' tags and class and id
words and by its text, and labelled main text or not; the labels of neighbours
depend on each other.  Weights come from labelled pages (by default those that
:mod:`pagemaker` composes), and the best labels from Viterbi's algorithm.
"""

from __future__ import annotations

import html as _html
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(?P<raw>script|style|textarea|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|$)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>",
    re.S | re.I,
)
_CLASS = re.compile(r"""(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a block's start tag ends, as their content is no block.
FOREIGN = frozenset("svg math select".split())
#: Elements of a block's text or of their own kind, which do not end those.
WITHIN = INLINE | frozenset("option optgroup hr svg g path rect circle line polyline polygon ellipse text tspan defs use symbol desc foreignobject lineargradient radialgradient stop clippath mask filter pattern image style script".split())
#: Elements that a start tag of the key closes when they are open inside the nearest container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = frozenset("html body div section article main aside header footer nav form table ul ol dl td th li dd blockquote figure".split())
#: Word parts that say what an element is for.
CUES = tuple("nav menu foot head side comment reply respon disqus ad ads advert sponsor promo banner share social relat recommend cookie consent notice alert gdpr popup modal form sign login search subscri newsletter breadcrumb widget tag crumb copyright legal masthead logo toolbar pagin skip article content post entry story main body text hentry".split())


class Block:
    __slots__ = ("ancestors", "linked", "text")

    def __init__(self, text: str, ancestors: tuple, linked: int) -> None:
        self.text, self.ancestors, self.linked = text, ancestors, linked


@lru_cache(maxsize=20_000)
def _names(attrs: str) -> tuple[str, ...]:
    found = []
    for m in _CLASS.finditer(attrs):
        found += _WORDS.findall((m[1] or m[2] or m[3] or "").lower())
    return tuple(dict.fromkeys(found))


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order; broken markup never fails."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked, links = 0, 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, tuple(stack), linked))
            parts.clear()
        linked = 0

    def pop_to(i):
        nonlocal links
        for name, _ in stack[i:]:
            links -= name == "a"
        del stack[i:]

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            t = _html.unescape(page[at : m.start()])
            parts.append(t)
            if links:
                linked += len(t)
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m["raw"]:
                flush()
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
            continue
        if tag in VOID:
            if tag not in ("img", "wbr"):
                flush()
            continue
        inline = tag in INLINE
        if not inline:
            flush()
        if m["close"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop_to(i)
                    break
                if inline and stack[i][0] not in INLINE:
                    break
            continue
        foreign = next((i for i, (name, _) in enumerate(stack) if name in FOREIGN), None)
        if m["attrs"].endswith("/") and (inline or tag in FOREIGN or foreign is not None):
            continue
        if foreign is not None and tag not in WITHIN and not any(name == "foreignobject" for name, _ in stack[foreign:]):
            flush()
            pop_to(foreign)
        if not inline:
            gone = CLOSES.get(tag, set()) | {"p"} | ({"h1", "h2", "h3", "h4", "h5", "h6"} if tag[0] == "h" and tag[1:].isdigit() else set())
            for i in range(len(stack) - 1, -1, -1):
                name = stack[i][0]
                if name in gone:
                    pop_to(i)
                    break
                if name in CONTAINERS:
                    break
        stack.append((tag, _names(m["attrs"])))
        links += tag == "a"
    if at < len(page):
        rest = page[at:]
        cut = re.search(r"<[a-zA-Z/!][^<>]*$", rest)  # a tag that the page's end cuts
        parts.append(_html.unescape(rest[: cut.start()] if cut else rest))
    flush()
    return out


@lru_cache(maxsize=50_000)
def _ancestor_features(ancestors: tuple) -> tuple[str, ...]:
    found = {}
    for depth, (tag, names) in enumerate(reversed(ancestors)):
        if tag in INLINE:
            continue
        found["a:" + tag] = 1
        for n in names:
            found["c:" + n] = 1
            for cue in CUES:
                if n.startswith(cue):
                    found["s:" + cue] = 1
    parents = [t for t, _ in ancestors if t not in INLINE]
    if not any(names for _, names in ancestors):
        found["plain"] = 1
        found["plain:" + (parents[-2] if len(parents) > 1 else "")] = 1
    found["p:" + (parents[-1] if parents else "")] = 1
    found["pp:" + ">".join(parents[-2:])] = 1
    return tuple(found)


def _size(n: int, steps: tuple[int, ...]) -> int:
    return sum(n >= s for s in steps)


def features(page: list[Block]) -> list[list[str]]:
    out = []
    n = len(page)
    for i, b in enumerate(page):
        words = b.text.count(" ") + 1
        f = list(_ancestor_features(b.ancestors))
        f.append(f"w:{_size(words, (2, 4, 8, 15, 30, 60))}")
        f.append(f"l:{_size(int(100 * b.linked / len(b.text)), (1, 30, 70, 95))}")
        f.append(f"e:{b.text[-1] in '.!?…。:;'}")
        f.append(f"d:{_size(b.text.count('.') + b.text.count(','), (1, 3, 8))}")
        f.append(f"@:{_size(100 * i // n, (1, 10, 40, 75, 95))}")
        if "©" in b.text:
            f.append("copyright")
        f.append("bias")
        out.append(f)
    return out


class Crf:
    """Two labels, log-linear; ``weights``: feature -> (other, main)."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, step: np.ndarray) -> None:
        self.names, self.weights, self.step = names, weights, step
        self.gap = {k: float(weights[i, 1] - weights[i, 0]) for k, i in names.items()}

    def decode(self, rows: list[list[str]]) -> list[int]:
        """The labels of the greatest joint score."""
        if not rows:
            return []
        gap, (a, b), (c, d) = self.gap, self.step[0], self.step[1]
        back = []
        s0, s1 = 0.0, sum(gap.get(f, 0.0) for f in rows[0])
        for row in rows[1:]:
            e = sum(gap.get(f, 0.0) for f in row)
            from0, from1 = (0 if s0 + a >= s1 + c else 1), (0 if s0 + b > s1 + d else 1)
            s0, s1 = max(s0 + a, s1 + c), max(s0 + b, s1 + d) + e
            back.append((from0, from1))
        y = [int(s1 > s0)]
        for step in reversed(back):
            y.append(step[y[-1]])
        return y[::-1]

    @classmethod
    def train(cls, pages: list[tuple[list[list[str]], list[int]]], rounds: int = 120, ridge: float = 0.5, rate: float = 0.15) -> Crf:
        """Conditional likelihood with an L2 penalty, by Adam; all pages forward and backward at once."""
        pages = [p for p in pages if p[0]]
        names: dict[str, int] = {}
        for rows, _ in pages:
            for r in rows:
                for f in r:
                    names.setdefault(f, len(names))
        flat = [[names[f] for f in r] for rows, _ in pages for r in rows]
        item = np.repeat(np.arange(len(flat)), [len(r) for r in flat])
        feat = np.array([f for r in flat for f in r], np.int64)
        size = np.array([len(rows) for rows, _ in pages])
        longest, n = int(size.max()), len(pages)
        row, col = np.repeat(np.arange(n), size), np.concatenate([np.arange(s) for s in size])
        y = np.concatenate([np.array(t) for _, t in pages])
        gold = np.zeros((len(names), 2))
        np.add.at(gold, (feat, y[item]), 1.0)
        follow = (row[1:] == row[:-1])
        gold_step = np.zeros((2, 2))
        np.add.at(gold_step, (y[:-1][follow], y[1:][follow]), 1.0)
        live = np.arange(longest)[None, :] < size[:, None]
        w, step = np.zeros((len(names), 2)), np.zeros((2, 2))
        moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(step), np.zeros_like(step)]
        lse = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
        for t in range(1, rounds + 1):
            emit = np.zeros((n, longest, 2))
            emit[row, col] = np.column_stack([np.bincount(item, weights=w[feat, k], minlength=len(flat)) for k in (0, 1)])
            fwd, bwd = np.zeros_like(emit), np.zeros_like(emit)
            fwd[:, 0] = emit[:, 0]
            for i in range(1, longest):
                new = lse(fwd[:, i - 1, :, None] + step, 1) + emit[:, i]
                fwd[:, i] = np.where(live[:, i, None], new, fwd[:, i - 1])
            for i in range(longest - 2, -1, -1):
                new = lse(step[None] + (emit[:, i + 1] + bwd[:, i + 1])[:, None, :], 2)
                bwd[:, i] = np.where(live[:, i + 1, None], new, 0.0)
            z = lse(fwd[:, -1], 1)
            p = np.exp(fwd + bwd - z[:, None, None])[row, col]
            pair = fwd[:, :-1, :, None] + step + (emit[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]
            expect_step = np.exp(pair[live[:, 1:]]).sum(axis=0)
            expect = np.column_stack([np.bincount(feat, weights=p[item, k], minlength=len(names)) for k in (0, 1)])
            for x, g, k in ((w, expect - gold + ridge * w, 0), (step, expect_step - gold_step + ridge * step, 2)):
                moments[k] += 0.1 * (g - moments[k])
                moments[k + 1] += 0.01 * (g * g - moments[k + 1])
                x -= rate * (moments[k] / (1 - 0.9**t)) / (np.sqrt(moments[k + 1] / (1 - 0.99**t)) + 1e-8)
        return cls(names, w, step)


def label(page: str, main: set[str]) -> tuple[list[list[str]], list[int]]:
    """Training rows of a page whose main blocks have the given texts."""
    found = blocks(page)
    return features(found), [int(b.text in main) for b in found]


@lru_cache(maxsize=2)
def default_model(pages: int = 400, seed: int = 11) -> Crf:
    from .pagemaker import labelled_pages

    return Crf.train([label(*p) for p in labelled_pages(pages, seed)])


def main_text(page: str | None, model: Crf) -> str:
    found = blocks(page)
    return " ".join(b.text for b, y in zip(found, model.decode(features(found))) if y)


def extract_main_text(spark, pages: DataFrame, model: Crf | None = None) -> DataFrame:
    """page_id, url, text, n_chars: the main text of every page.

    Character references are decoded, white space in a block becomes one space,
    and main blocks are joined by a space.  Null or empty html, and pages without
    main text, give the empty text.  Every row gives a row, null ids and repeated
    rows too.  Other columns are ignored.
    """
    ex.prepare(spark)
    model = model or default_model()
    columns = [F.col("page_id"), F.col("url").cast("string").alias("url") if "url" in pages.columns else F.lit(None).cast("string").alias("url"), F.col("html").cast("string").alias("html")]

    def run(batches):
        for b in batches:
            texts = [main_text(x, model) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)["page_id"]
    return pages.select(*columns).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
