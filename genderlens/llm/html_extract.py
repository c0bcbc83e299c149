"""Main-text extraction: a linear-chain conditional random field over the
leaf blocks of a page.

A page is read into leaf blocks: the text between two boundaries of
block-level elements, with its ancestors, their class, id and role words, and
its share of linked text. Scripts, styles, templates and comments hold no
text; formulas read on in their block, and drawings, objects, frames and
``noscript`` are blocks like others. A two-label chain (main or not) scores the blocks by indicators of
ancestors, attribute words and the text's length, links, signs and place, and
neighbours by label pairs. It is trained by gradient ascent on the
conditional likelihood over labelled pages and decoded by Viterbi. The blocks
labelled main, joined in page order, are the text.

Labelled pages come from page html with its known text (``align``): the run of
blocks that reads through that text is main. As such pages may all have one
layout, each is also laid out anew in ``LAYOUTS`` other ways (containers for
the text, menus, headers, sidebars, notices, adverts, forms and reader
comments), with its own blocks as contents. The number of labelled pages is
bounded by ``SAMPLE``; extraction covers every page and whole html.

Defined results: null or empty html gives an empty text; broken markup is
read as far as it goes (an unclosed tag is text, an unclosed element ends with
its parent; only an unclosed script or style lasts to the end); repeated rows are
extracted alike; an empty table gives an empty result; other columns are
kept."""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small

SAMPLE = 300
LAYOUTS = 4

# Element kinds of html.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav noscript object ol "
    "noembed noframes optgroup option p pre section select summary svg table tbody td template textarea tfoot th thead title tr ul "
    "video audio".split())
#: Blocks that may stand inside a paragraph and do not end it.
PHRASE = frozenset("iframe noembed noframes noscript object svg template".split())
#: Elements whose content is never text; that of the raw ones has no tags.
RAW = frozenset("script style".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element that opens closes these if they are on top of the open ones.
CLOSES = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"),
          "option": ("option",), "optgroup": ("option", "optgroup"), "tbody": ("td", "th", "tr", "thead", "tbody"),
          "tfoot": ("td", "th", "tr", "thead", "tbody"), "body": ("head", "title")}

TEMPLATE = re.compile(r"<(/?)template(?=[\s/>])[^>]*>", re.I)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
GOLD = "data-main-text"
NAME_WORD = re.compile(r"[a-z]{2,24}")


class Block:
    __slots__ = ("text", "path", "links", "gold")

    def __init__(self, text, path, links, gold):
        self.text, self.path, self.links, self.gold = text, path, links, gold


def attribute_words(raw: str) -> tuple[str, ...]:
    out: dict[str, None] = {}
    for m in NAMED.finditer(raw):
        value = m[2] or m[3] or m[4] or ""
        for w in NAME_WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()):
            out[w] = None
    return tuple(out)


def template_end(page: str, pos: int) -> int | None:
    """Where the template that opens before ``pos`` ends; None if unclosed."""
    depth = 1
    for m in TEMPLATE.finditer(page, pos):
        depth += -1 if m[1] else 1
        if not depth:
            return m.end()
    return None


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page in order; ``path`` holds ``(tag, attribute
    words)`` from the outermost ancestor to the innermost."""
    page = page or ""
    out: list[Block] = []
    path: list[tuple[str, tuple[str, ...]]] = []
    gold: list[bool] = []
    parts: list[str] = []
    linked, in_link, at = 0, 0, 0

    def text(raw):
        nonlocal linked
        if raw:
            t = entities.unescape(raw) if "&" in raw else raw
            parts.append(t)
            if in_link:
                linked += len(t.strip())

    def flush():
        nonlocal linked
        if parts:
            t = " ".join("".join(parts).split())
            if t and not any(tag == "template" for tag, _ in path):
                out.append(Block(t, tuple(path), min(1.0, linked / len(t)), any(gold)))
            parts.clear()
        linked = 0

    pos, n = 0, len(page)
    while pos < n:
        m = TOKEN.search(page, pos)
        if m is None:
            break
        text(page[at:m.start()])
        pos = at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        tag, raw = name.lower(), (m[3] if m[2] else m[6]) or ""
        if m[1] or m[4]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            elif tag in BLOCK and (tag == "p" or any(t == tag for t, _ in path)):
                flush()
                if any(t == tag for t, _ in path):
                    while path:
                        gold.pop()
                        if path.pop()[0] == tag:
                            break
            continue
        empty = raw.rstrip().endswith("/")
        if tag in RAW and not empty:
            end = re.compile(rf"</{tag}[^>]*>", re.I).search(page, pos)
            pos = at = end.end() if end else n
            parts.append(" ")
            continue
        if tag == "template" and not empty and (end := template_end(page, pos)):
            pos = at = end
            parts.append(" ")
            continue
        if tag == "a":
            in_link += 1
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCK:
            flush()
            if path and path[-1][0] == "p" and tag not in PHRASE:
                path.pop()
                gold.pop()
            while path and path[-1][0] in CLOSES.get(tag, ()):
                path.pop()
                gold.pop()
            if tag not in EMPTY and not (empty and tag in PHRASE):
                path.append((tag, attribute_words(raw) if "=" in raw else ()))
                gold.append(GOLD in raw)
            in_link = 0 if tag not in ("div", "p", "span") and tag not in PHRASE else in_link
    text(page[at:])
    flush()
    return out


def _bin(x: float, edges) -> int:
    return sum(x >= e for e in edges)


def describe(found: list[Block], memo: dict | None = None) -> list[list[str]]:
    """Indicators of each block of a page."""
    out, n = [], len(found)
    memo = {} if memo is None else memo
    for i, b in enumerate(found):
        place = memo.get(b.path)
        if place is None:
            place = ["on:" + (b.path[-1][0] if b.path else "")]
            place += sorted({"in:" + t for t, _ in b.path})
            place += sorted({"name:" + w for _, ws in b.path for w in ws})
            if not any(ws for _, ws in b.path):
                place.append("nameless")
            memo[b.path] = place
        words = b.text.count(" ") + 1
        last = b.text[-1]
        out.append([*place, f"words:{_bin(words, (2, 3, 6, 11, 26, 61))}", f"links:{_bin(b.links, (0.01, 0.34, 0.9))}",
                    "ends:" + ("." if last in ".!?…\"”" else "," if last in ",:;" else "a" if last.isalnum() else "x"),
                    f"commas:{min(b.text.count(','), 3)}", "sign:" + ("©" if "©" in b.text else "|" if "|" in b.text else ""),
                    f"place:{5 * i // n}", *(["first"] if i == 0 else []), *(["last"] if i == n - 1 else [])])
    return out


# ---- the chain ---------------------------------------------------------------

class Chain:
    """Weights of indicators for label 1 (label 0 is the zero point), of
    label pairs and of the first label."""

    def __init__(self, weights: dict[str, float], pairs: np.ndarray, first: np.ndarray):
        self.weights, self.pairs, self.first = weights, pairs, first

    def scores(self, rows: list[list[str]]) -> list[float]:
        get = self.weights.get
        return [sum([get(f, 0.0) for f in fs]) for fs in rows]

    def viterbi(self, rows: list[list[str]]) -> list[int]:
        """The most likely labels of a page's blocks."""
        s = self.scores(rows)
        if not s:
            return []
        (p00, p01), (p10, p11) = self.pairs.tolist()
        a, b = float(self.first[0]), float(self.first[1]) + s[0]
        back = []
        for x in s[1:]:
            to0, to1 = (0 if a + p00 >= b + p10 else 1), (0 if a + p01 > b + p11 else 1)
            back.append((to0, to1))
            a, b = max(a + p00, b + p10), max(a + p01, b + p11) + x
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 150, rate: float = 0.3, ridge: float = 0.002) -> Chain:
    """Fit a chain on ``(indicators, labels)`` per page: adaptive gradient
    ascent on the conditional log-likelihood, forward-backward over all pages
    at once."""
    pages = [p for p in pages if p[0]]
    if not pages:
        return Chain({}, np.zeros((2, 2)), np.zeros(2))
    names: dict[str, int] = {}
    flat, of, length = [], [], np.array([len(r) for r, _ in pages])
    width = int(length.max())
    y = np.zeros((len(pages), width), np.int64)
    for p, (rows, labels) in enumerate(pages):
        y[p, :len(labels)] = labels
        for i, fs in enumerate(rows):
            for f in fs:
                flat.append(names.setdefault(f, len(names)))
                of.append(p * width + i)
    flat, of = np.array(flat), np.array(of)
    mask = np.arange(width)[None, :] < length[:, None]
    w, pairs, first = np.zeros(len(names)), np.zeros((2, 2)), np.zeros(2)
    grown = [np.full(x.shape, 1e-6) for x in (w, pairs, first)]
    gold_pairs = np.zeros((2, 2))
    both = mask[:, 1:]
    np.add.at(gold_pairs, (y[:, :-1][both], y[:, 1:][both]), 1)
    gold_first = np.bincount(y[:, 0], minlength=2)
    total = mask.sum()
    for _ in range(rounds):
        node = np.zeros((len(pages), width, 2))
        node[:, :, 1] = np.bincount(of, weights=w[flat], minlength=len(pages) * width).reshape(len(pages), width)
        fwd = np.zeros_like(node)
        fwd[:, 0] = node[:, 0] + first
        for t in range(1, width):
            step = np.logaddexp(fwd[:, t - 1, 0, None] + pairs[0], fwd[:, t - 1, 1, None] + pairs[1]) + node[:, t]
            fwd[:, t] = np.where(mask[:, t, None], step, fwd[:, t - 1])
        z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        bwd = np.zeros_like(node)
        expect_pairs = np.zeros((2, 2))
        for t in range(width - 2, -1, -1):
            after = bwd[:, t + 1] + node[:, t + 1]
            step = np.logaddexp(pairs[:, 0] + after[:, :1], pairs[:, 1] + after[:, 1:])
            bwd[:, t] = np.where(mask[:, t + 1, None], step, 0)
            p = np.exp(fwd[:, t, :, None] + pairs[None] + after[:, None, :] - z[:, None, None])
            expect_pairs += p[mask[:, t + 1]].sum(axis=0)
        one = np.exp(fwd[:, :, 1] + bwd[:, :, 1] - z[:, None]) * mask
        miss = (y - one) * mask
        steps = (np.bincount(flat, weights=miss.ravel()[of], minlength=len(names)) / total - ridge * w / 10,
                 (gold_pairs - expect_pairs) / total - ridge * pairs,
                 (gold_first - np.array([(1 - one[:, 0]).sum(), one[:, 0].sum()])) / total - ridge * first)
        for x, g, s in zip((w, pairs, first), steps, grown, strict=True):
            s += g * g
            x += rate * g / np.sqrt(s)
    return Chain({f: float(w[i]) for f, i in names.items() if abs(w[i]) > 1e-6}, pairs, first)


# ---- labelled pages ------------------------------------------------------------

def align(found: list[Block], known: str | None) -> list[int]:
    """Label the run of blocks that reads through the page's known text, and
    headings of the same container that begin it."""
    flat = " ".join((known or "").split())
    if not flat:
        return [0] * len(found)
    best, run, here = (0, []), [], -1
    size = 0
    for i, b in enumerate(found):
        at = flat.find(b.text, max(0, here))
        if here >= 0 and 0 <= at <= here + 1:
            run.append(i)
            size += len(b.text)
            here = at + len(b.text)
        else:
            at = flat.find(b.text)
            run, size = ([i], len(b.text)) if at >= 0 else ([], 0)
            here = at + len(b.text) if at >= 0 else -1
        if size > best[0]:
            best = size, list(run)
    labels = [0] * len(found)
    if best[0] * 2 < len(flat):
        return labels
    for i in best[1]:
        labels[i] = 1
    i = best[1][0] - 1
    around = found[best[1][0]].path[:-1]
    while i >= 0 and found[i].path and found[i].path[-1][0] in ("h1", "h2", "h3") and found[i].path[:-1] == around:
        labels[i] = 1
        i -= 1
    return labels


MAINS = ("<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', '<div id="main-content">{}</div>',
         '<section class="post">{}</section>', '<div class="entry-content">{}</div>', '<div class="article-body">{}</div>',
         '<main><article class="story">{}</article></main>', '<div role="main">{}</div>', "<div>{}</div>",
         '<table><tr><td class="text">{}</td></tr></table>', '<section>{}</section>', '<div class="wrapper"><div class="page">{}</div></div>')
BEFORE = ("<header>{}</header>", "<nav>{}</nav>", '<div class="header">{}</div>', '<div id="nav" class="menu">{}</div>',
          '<ul class="menu">{}</ul>', '<div class="breadcrumb">{}</div>', '<div class="banner notice">{}</div>',
          '<div class="cookie-notice" id="cookie-banner">{}</div>', '<div role="navigation">{}</div>', '<div class="topbar">{}</div>',
          '<div class="ad">{}</div>', '<div class="advert sponsored">{}</div>', '<form class="search">{}</form>')
AFTER = ("<footer>{}</footer>", '<div id="footer">{}</div>', "<aside>{}</aside>", '<div class="sidebar">{}</div>',
         '<div id="sidebar" class="widget">{}</div>', '<section class="related">{}</section>', '<div class="share social">{}</div>',
         "<form>{}</form>", '<form class="newsletter subscribe">{}</form>', '<div class="ads promo">{}</div>',
         '<section id="comments" class="comments">{}</section>', '<div class="comment-list">{}</div>',
         '<ol class="comments"><li class="comment">{}</li></ol>', '<div class="comment reply">{}</div>', '<div class="popup modal">{}</div>',
         '<div class="copyright">{}</div>', '<div class="author bio">{}</div>', '<div class="disqus responses">{}</div>')
INSIDE = ("<aside>{}</aside>", '<div class="ad">{}</div>', '<div class="related">{}</div>', '<nav class="toc">{}</nav>',
          '<div class="notice">{}</div>', '<section class="comments">{}</section>', "<form>{}</form>", '<figure class="advert">{}</figure>')


def lay_out(main: list[tuple[str, str]], rest: list[str], foreign: list[str], rng: np.random.Generator) -> str:
    """A page with ``main`` (tag, text) blocks as its text and other blocks
    around it; ``foreign`` are texts of other pages, for readers' comments,
    adverts and the like, which only their place tells from the text."""
    esc = entities.escape

    def filler(short):
        pool = rest if short and rest else foreign or rest
        texts = [pool[int(i)] for i in rng.integers(0, len(pool), int(rng.integers(1, 4)))] if pool else []
        kind = int(rng.integers(0, 4))
        if kind == 0:
            return "".join(f"<p>{esc(t)}</p>" for t in texts)
        if kind == 1:
            return "<ul>" + "".join(f'<li><a href="#">{esc(t[:40])}</a></li>' for t in texts) + "</ul>"
        if kind == 2:
            return "".join(f"<div>{esc(t)}</div>" for t in texts)
        return f"<h3>{esc(texts[0][:30])}</h3>" + "".join(f"<p>{esc(t)}</p>" for t in texts[1:]) if texts else ""

    pieces = [f"<{t} {GOLD}>{esc(x)}</{t}>" for t, x in main]
    if rng.random() < 0.6 and len(pieces) > 1:
        at = int(rng.integers(1, len(pieces) + 1))
        pieces.insert(at, INSIDE[int(rng.integers(len(INSIDE)))].format(filler(rng.random() < 0.5)))
    body = MAINS[int(rng.integers(len(MAINS)))].format("".join(pieces))
    pre = "".join(BEFORE[int(i)].format(filler(True)) for i in rng.permutation(len(BEFORE))[:int(rng.integers(1, 4))])
    post = "".join(AFTER[int(i)].format(filler(rng.random() < 0.4)) for i in rng.permutation(len(AFTER))[:int(rng.integers(1, 5))])
    return f"<html><head><title>{esc(main[0][1][:60])}</title></head><body>{pre}{body}{post}</body></html>"


def labelled_pages(known: list[tuple[str, str]], layouts: int = LAYOUTS, seed: int = 5):
    """``(indicators, labels)`` of pages with known text ``(html, text)``,
    as they are and laid out anew."""
    rng = np.random.default_rng(seed)
    out, made = [], []
    for page, text in known:
        found = blocks(page)
        labels = align(found, text)
        if any(labels):
            out.append((describe(found), labels))
            main = [(b.path[-1][0] if b.path and b.path[-1][0] in ("p", "h1", "h2", "h3") else "p", b.text)
                    for b, l in zip(found, labels, strict=True) if l]
            made.append((main, [b.text for b, l in zip(found, labels, strict=True) if not l]))
    for i, (main, rest) in enumerate(made):
        for k in range(layouts):
            other = [t for _, t in made[(i + 1 + k) % len(made)][0]]
            found = blocks(lay_out(main, rest, other, rng))
            out.append((describe(found), [int(b.gold) for b in found]))
    return out


#: Pages for tables without labelled ones, so that a chain can always be fitted.
PLAIN = [("<html><head><title>On rivers</title></head><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/a'>About</a></li></ul>"
          "</nav><article><h1>On rivers</h1><p>A river carries water from the hills to the sea, and sand with it.</p><p>In spring it is "
          "high, brown and fast.</p><p>Short line.</p></article><footer>&copy; Example House</footer></body></html>",
          "On rivers A river carries water from the hills to the sea, and sand with it. In spring it is high, brown and fast. Short line."),
         ("<html><body><header><p>The daily page</p></header><main><h1>Bread</h1><p>Flour, water, salt and time make bread.</p><p>The dough "
          "rests overnight, then it is baked.</p></main><aside><p>Subscribe to our letter.</p></aside><footer><p>All rights reserved</p>"
          "</footer></body></html>", "Bread Flour, water, salt and time make bread. The dough rests overnight, then it is baked.")]


def learn(labelled: DataFrame | None, sample: int = SAMPLE) -> Chain:
    """Fit a chain on ``labelled(html, text)``; at most ``sample`` rows come
    to the driver, those with the smallest hash."""
    known = []
    if labelled is not None:
        rows = labelled.where("html is not null and text is not null").orderBy(F.xxhash64("html", F.lit(3)), "html").limit(sample).collect()
        known = [(r["html"], r["text"]) for r in rows]
    return train(labelled_pages(known + PLAIN * 3))


def extract(chain: Chain, page: str | None, memo: dict | None = None) -> str:
    """Main text of one page."""
    found = blocks(page)
    labels = chain.viterbi(describe(found, memo))
    return " ".join(b.text for b, l in zip(found, labels, strict=True) if l)


def extracted(pages: DataFrame, chain: Chain, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with its columns (but the html) and the main text."""
    keep = [c for c in pages.columns if c not in (html_col, out)]
    shared = pages.sparkSession.sparkContext.broadcast(chain)  # weights of a bounded sample

    def run(batches):
        memo: dict = {}
        for b in small(batches, len(keep)):
            if len(memo) > 20_000:
                memo = {}
            texts = [extract(shared.value, p, memo) for p in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(texts, pa.string())], names=[*keep, out])

    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.select(*keep).schema)
    return pages.select(*keep, html_col).mapInArrow(run, f"{types}`{out}` string")
