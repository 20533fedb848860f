"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page.

A page becomes the sequence of its leaf blocks, each with its ancestors' tags and names and with features of its text and
links. The field gives each block one of two labels, main or not; Viterbi decoding picks the best sequence. It is trained on
labelled pages: a sample of expected size PAGES of the table, labelled by their landmark elements, and as many pages made
of the same blocks in layouts without landmarks, whose labels are known as they are made.

Cases: null and empty pages give an empty text; pages cut off anywhere are read up to there; unclosed elements end where
HTML has them end; any length is read whole; an empty table gives no rows; repeated rows and other columns don't matter.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from random import Random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.llm.common import fields, table

#: Expected number of pages that are learned from, and rounds over them.
PAGES, ROUNDS, RATE, DECAY = 400, 6, 0.2, 1e-5
FEATURES = 1 << 14

# Elements whose text isn't shown, that end a block, that have no content, that a new one of the kind ends.
_SILENT = frozenset("script style noscript template head title textarea iframe svg object select".split())
_RAW = frozenset("script style textarea title iframe noscript".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ENDS_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_ENDS_OWN_KIND = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_BOILER_TAGS = frozenset("nav aside footer form button dialog menu".split())
_BOILER_NAMES = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer discussion footer gdpr header login masthead menu nav navbar navigation newsletter notice "
    "popup promo promoted promotion related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe tags toolbar topbar widget".split()
)
_MAIN_NAMES = ("content", "main", "article-body", "post", "entry-content", "story", "page-content", "text", "post-body", "story-body")

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"'<]++|"[^"<]*+"|'[^'<]*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*)>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*\Z""", re.S)
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PIECES = re.compile(r"[A-Za-z]+")


class Block:
    """A shown block: its text, its ancestors' tags and names, the share of it in links, its closest element and its closest
    one that isn't inline. Blocks below the same element share the sets."""

    __slots__ = ("text", "tags", "names", "linked", "last", "leaf")

    def __init__(self, text: str, tags: frozenset[str], names: frozenset[str], linked: float, last: str, leaf: str):
        self.text, self.tags, self.names, self.linked, self.last, self.leaf = text, tags, names, linked, last, leaf


_NOTHING: frozenset[str] = frozenset()


def leaf_blocks(page: str | None) -> list[Block]:
    """The shown blocks of a page in order: white space is one blank, character references are decoded."""
    page = page or ""
    out: list[Block] = []
    # open elements: tag, and the tags, names and closest block element from the top down to it
    stack: list[tuple[str, frozenset[str], frozenset[str], str]] = []
    open_tags: Counter[str] = Counter()
    raw: list[str] = []
    linked = silent = links = 0

    def close_block() -> None:
        nonlocal linked
        if raw:
            text = " ".join(html.unescape("".join(raw)).split())
            if text:
                last, tags, own, leaf = stack[-1] if stack else ("", _NOTHING, _NOTHING, "")
                out.append(Block(text, tags, own, min(1.0, linked / len(text)), last, leaf))
            raw.clear()
        linked = 0

    def pop(down_to: int) -> None:
        nonlocal silent, links
        while len(stack) > down_to:
            tag = stack.pop()[0]
            open_tags[tag] -= 1
            silent -= tag in _SILENT
            links -= tag == "a"

    def add(text: str) -> None:
        nonlocal linked
        if text and not silent:
            raw.append(text)
            linked += len(text) if links else 0

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag not in _INLINE:
                close_block()
            for i in range(len(stack) - 1, -1, -1) if open_tags[tag] else ():
                if stack[i][0] == tag:
                    pop(i)
                    break
            continue
        if tag == "br":
            add(" ")
            continue
        if tag not in _INLINE:
            close_block()
        if tag in _ENDS_PARAGRAPH and open_tags["p"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    pop(i)
                    break
                if stack[i][0] not in _INLINE:
                    break
        for i in range(len(stack) - 1, -1, -1) if tag in _ENDS_OWN_KIND else ():
            if stack[i][0] in _ENDS_OWN_KIND[tag]:
                pop(i)
            elif stack[i][0] not in _INLINE and stack[i][0] != "p":
                break
        if tag == "body":
            pop(sum(t[0] == "html" for t in stack[:1]))
        if tag in _EMPTY:
            continue
        attributes = m[3] or m[6] or ""
        names = frozenset(p.lower() for n in _NAMES.findall(attributes) for p in _PIECES.findall("".join(n))) if "=" in attributes else frozenset()
        if tag in _RAW:  # its content isn't markup
            closing = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = closing.end() if closing else end
            continue
        _, tags, own, leaf = stack[-1] if stack else ("", _NOTHING, _NOTHING, "")
        stack.append((tag, tags if tag in tags else tags | {tag}, own if names <= own else own | names, leaf if tag in _INLINE else tag))
        open_tags[tag] += 1
        silent += tag in _SILENT
        links += tag == "a"
    close_block()
    return out


def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % FEATURES


def features(blocks: list[Block], cache: dict) -> list[list[int]]:
    """Feature indexes of each block of a page."""
    out, n = [], len(blocks)
    for i, b in enumerate(blocks):
        key = (b.tags, b.names, b.leaf)
        if key not in cache:
            cache[key] = [_slot(x) for x in {"bias", f"leaf={b.leaf}", *(f"in={t}" for t in b.tags), *(f"name={x}" for x in b.names), f"boiler={not _BOILER_NAMES.isdisjoint(b.names)}"}]
            if len(cache) > 50_000:
                cache.clear()
                return features(blocks, cache)
        size = len(b.text)
        found = {
            f"size={min(9, int(math.log2(size)))}", f"links={int(b.linked * 4)}", f"stops={min(4, sum(map(b.text.count, '.!?')))}", f"commas={min(3, b.text.count(','))}",
            f"end={b.text[-1] if b.text[-1] in '.!?:…' else 'x'}", f"mark={'©' in b.text}", f"from={min(3, i)}", f"to={min(3, n - 1 - i)}", f"leaf,size={b.last},{size > 80}",
        }
        out.append(cache[key] + [_slot(x) for x in found])
    return out


class Field:
    """Weights of a linear chain of two labels."""

    def __init__(self):
        self.weight, self.step = np.zeros((FEATURES, 2)), np.zeros((2, 2))

    def _states(self, rows: list[list[int]]) -> list[tuple[float, float]]:
        flat = self.weight[[i for r in rows for i in r]]
        return [tuple(x) for x in np.add.reduceat(flat, np.cumsum([0, *map(len, rows[:-1])]), axis=0).tolist()]

    def learn(self, rows: list[list[int]], labels: list[int], rate: float) -> None:
        """One step up the log likelihood of a page's labels."""
        states, step = self._states(rows), np.exp(self.step).tolist()
        expd = []
        for a, b in states:
            top = max(a, b)
            expd.append((math.exp(a - top), math.exp(b - top)))
        ahead = [expd[0]]
        for e in expd[1:]:
            p = ahead[-1]
            x, y = (p[0] * step[0][0] + p[1] * step[1][0]) * e[0], (p[0] * step[0][1] + p[1] * step[1][1]) * e[1]
            ahead.append((x / (x + y), y / (x + y)))
        back = [(1.0, 1.0)]
        for e in expd[:0:-1]:
            q = (back[-1][0] * e[0], back[-1][1] * e[1])
            x, y = step[0][0] * q[0] + step[0][1] * q[1], step[1][0] * q[0] + step[1][1] * q[1]
            back.append((x / (x + y), y / (x + y)))
        back.reverse()
        for i, (f, g) in enumerate(zip(ahead, back, strict=True)):
            a, b = f[0] * g[0], f[1] * g[1]
            error = labels[i] - b / (a + b)
            self.weight[rows[i], 1] += rate * error
            self.weight[rows[i], 0] -= rate * error
            if i:
                p, e, q = ahead[i - 1], expd[i], back[i]
                pair = [[p[r] * step[r][c] * e[c] * q[c] for c in (0, 1)] for r in (0, 1)]
                total = sum(map(sum, pair))
                for r in (0, 1):
                    for c in (0, 1):
                        self.step[r, c] += 0.1 * rate * ((labels[i - 1] == r and labels[i] == c) - pair[r][c] / total)

    def decode(self, rows: list[list[int]]) -> list[int]:
        """Viterbi: the most likely labels."""
        if not rows:
            return []
        states, step = self._states(rows), self.step.tolist()
        (x, y), came = states[0], []
        for a, b in states[1:]:
            p, q = x + step[0][0] >= y + step[1][0], x + step[0][1] >= y + step[1][1]
            came.append((0 if p else 1, 0 if q else 1))
            x, y = a + (x + step[0][0] if p else y + step[1][0]), b + (x + step[0][1] if q else y + step[1][1])
        out = [0 if x >= y else 1]
        for c in reversed(came):
            out.append(c[out[-1]])
        return out[::-1]

    def text(self, page: str | None, cache: dict) -> str:
        blocks = leaf_blocks(page)
        return "\n".join(b.text for b, y in zip(blocks, self.decode(features(blocks, cache)), strict=True) if y)


# ---- labelled pages ----


def landmark_label(b: Block) -> int:
    """Whether a block is main text, by the landmarks that stand above it."""
    inside = "article" in b.tags or "main" in b.tags
    return int(inside and _BOILER_TAGS.isdisjoint(b.tags) and _BOILER_NAMES.isdisjoint(b.names))


_SPARE_MAIN = ("Plain words about a place, a day, and those who were there. They went on for a while, and then they stopped.", "A second paragraph, somewhat longer than the first one, tells how the matter ended and what was said about it later on.")
_SPARE_REST = ("Home", "About us", "© 2020 All rights reserved.", "We use cookies. Accept all", "Read more", "Log in", "5 comments")


def made_page(rng: Random, main: list[str], rest: list[str]) -> tuple[str, str]:
    """A page in a layout of div elements, and its main text."""
    e = html.escape
    pick = lambda lo, hi: [rng.choice(rest) for _ in range(rng.randint(lo, hi))]
    name = lambda *names: f'{rng.choice(("class", "id"))}="{rng.choice(names)}{rng.choice(("", "-wrap", " clearfix", "-1", "_box"))}"'
    links = lambda n: "".join(f'<li><a href="/x">{e(t[:30])}</a></li>' for t in pick(1, n))
    rows = lambda n, tag="p": "".join(f"<{tag}>{e(t)}</{tag}>" for t in pick(1, n))
    prose = lambda n: "".join(f"<p>{e(rng.choice(main))}</p>" for _ in range(rng.randint(1, n)))
    own = [rng.choice(main) for _ in range(rng.randint(1, 8))]
    tags = [rng.choice(("h1", "h2")) if i == 0 and rng.random() < 0.7 else rng.choice(("p", "p", "p", "p", "li", "blockquote", "h2", "div", "pre", "td")) for i in range(len(own))]
    own = [t[:60] if g in ("h1", "h2") else t for t, g in zip(own, tags, strict=True)]
    wrap = {"li": ("<ul>", "</ul>"), "td": ("<table><tr>", "</tr></table>")}
    body = "".join(f"{wrap.get(g, ('', ''))[0]}<{g}>{e(t)}</{g}>{wrap.get(g, ('', ''))[1]}" for t, g in zip(own, tags, strict=True))
    holder = rng.choice(("div", "div", "section", "main", "article", "td"))
    before = [f"<div {name('header', 'masthead', 'topbar')}>{rows(2, 'div')}</div>", f"<header>{rows(2)}</header>", f"<div {name('menu', 'nav', 'navbar', 'breadcrumb')}><ul>{links(6)}</ul></div>", f"<nav>{links(5)}</nav>",
              f"<div {name('ad', 'ads', 'banner', 'sponsored', 'promo')}>{rng.choice((rows(2), prose(1)))}</div>", f"<div {name('cookie', 'notice', 'consent', 'popup')}>{rng.choice((rows(2), prose(1)))}</div>", f"<form>{rows(2, 'label')}<button>{e(rng.choice(rest)[:20])}</button></form>"]
    after = [f"<div {name('sidebar', 'related', 'widget', 'promo')}>{rng.choice((rows(3), prose(2)))}</div>", f"<aside>{rng.choice((rows(3), prose(2)))}</aside>", f"<div {name('comments', 'comment', 'discussion', 'replies')}><h3>{e(rng.choice(rest)[:30])}</h3>{prose(4)}</div>",
             f"<div {name('newsletter', 'subscribe', 'share', 'social')}>{rows(2)}</div>", f"<div {name('footer', 'copyright')}>{rows(3, rng.choice(('p', 'div', 'span')))}</div>", f"<footer>{rows(2)}</footer>", f"<section {name('comments', 'respond')}>{prose(3)}</section>"]
    inner = rng.choice(after) if rng.random() < 0.3 else ""
    top, low = "".join(rng.sample(before, rng.randint(1, 4))), "".join(rng.sample(after, rng.randint(1, 4)))
    named = f" {name(*_MAIN_NAMES)}" if rng.random() < 0.7 else ""
    table_open, table_close = ("<table><tr>", "</tr></table>") if holder == "td" else ("", "")
    return f"<html><body>{top}{table_open}<{holder}{named}>{body}{inner}</{holder}>{table_close}{low}</body></html>", "\n".join(" ".join(t.split()) for t in own)


def labelled(pages: list[str]) -> Iterator[tuple[list[Block], list[int]]]:
    """Blocks and labels of the pages given, and of as many made from their blocks."""
    rng, main, rest = Random(5), [*_SPARE_MAIN], [*_SPARE_REST]
    for page in pages:
        blocks = leaf_blocks(page)
        labels = [*map(landmark_label, blocks)]
        if blocks:
            yield blocks, labels
        for b, y in zip(blocks, labels, strict=True):
            (main if y and len(b.text) > 60 else rest if not y else []).append(b.text)
    for _ in range(max(200, len(pages))):
        page, text = made_page(rng, main, rest)
        blocks, wanted, labels = leaf_blocks(page), text.split("\n"), []
        opened = [_BOILER_NAMES.isdisjoint(b.names) and _BOILER_TAGS.isdisjoint(b.tags) and "header" not in b.tags for b in blocks]
        for b, o in zip(blocks, opened, strict=True):
            labels.append(int(bool(o and wanted and b.text == wanted[0])))
            if labels[-1]:
                wanted.pop(0)
        yield blocks, labels


def train(pages: list[str]) -> Field:
    field, rng, cache = Field(), Random(3), {}
    rows = [(features(b, cache), y) for b, y in labelled(pages)]
    for epoch in range(ROUNDS):
        rng.shuffle(rows)
        for x, y in rows:
            field.learn(x, y, RATE / (1 + epoch))
        field.weight *= 1 - DECAY
    return field


def fit(pages: DataFrame, column: str = "html", sample: int = PAGES) -> Field:
    known = pages.select(F.col(column).alias("html")).where(F.col("html").isNotNull())
    n = known.count()
    if not n:
        return train([])
    chosen = known.where(F.pmod(F.xxhash64("html"), F.lit(1_000_000)) < min(1.0, sample / n) * 1_000_000).distinct()
    return train(sorted(r["html"] for r in chosen.collect()))


def extracted(spark: SparkSession, field: Field) -> Column:
    shipped = spark.sparkContext.broadcast(field)

    @F.pandas_udf(fields("text string, n_chars long"))
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cache: dict = {}
        for pages in batches:
            texts = [shipped.value.text(p, cache) for p in pages]
            yield pd.DataFrame({"text": texts, "n_chars": [*map(len, texts)]})

    return extract


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", extracted(spark, fit(pages))(F.col("html")).alias("r")).select("page_id", "url", "r.*")
