"""Main text of web pages by a tree-structured graphical model (operator 8).

The page becomes a tree of block elements; each run of inline text is a leaf block.
Every node is content or not. Node potentials come from its tag, class and id words,
length and link share; pair potentials tie parent and child. Sum-product messages
go up the tree and down again, exactly, in page order without recursion, and a leaf
is kept where its marginal of being content is above one half. Weights maximise the
likelihood of labelled pages that ``training_pages`` writes from several layouts; the
tables have no labels of their own.

Script, style, markup and form controls never become text. White space inside a
block becomes one space, a line break counts as white space, blocks are trimmed,
empty ones go, and the rest join by a newline.

Defined cases: null and empty html give "" and 0; unclosed and crossed tags close as
browsers close paragraphs and list items; an unclosed comment, script, style or
textarea runs to the end; of other skipped elements without an end only the tag goes,
a head without an end closes before its first foreign tag or text; plain text without tags is one block; every row gives one row, repeated rows
too; other columns are ignored. Work and memory grow linearly with one page.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .exchange import tidy

SLICE = 1 << 20

_RAW = r"<!--(?s:.*?)(?:-->|\Z)|<(script|style|textarea)\b[^>]*+>(?s:.*?)(?:</\1\s*>|\Z)"
_SKIPPED = frozenset("noscript template svg select button iframe object canvas".split())
#: Skipped elements that lie within themselves.
_NESTED = frozenset("template svg object".split())
_PART = re.compile(
    rf"{_RAW}|<({'|'.join(sorted(_SKIPPED))}|head)\b[^>]*+>"
    r"""|<(/?)([a-zA-Z][^\s>/]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s>/]*+)([^>]*+)>|<[!?][^>]*+>|[^<]++|<""",
    re.I,
)
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Elements that begin a block of their own.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_MARK = re.compile(rf"{_RAW}|<(/?)({'|'.join(sorted(_SKIPPED | BLOCKS - {'html'}))}|head|body)(?=[\s/>])[^>]*+>", re.I)
#: What may stand in a head.
_HEAD = re.compile(r"(?:\s++|<!--(?s:.*?)-->|<(title|style|script|noscript|template)\b[^>]*+>(?s:.*?)</\1\s*>|<(?:meta|link|base)\b[^>]*+>)*+", re.I)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role that speak for a group.
GROUPS = {
    "ad": r"ads?|advert\w*|sponsor\w*|promo\w*|banner",
    "menu": r"nav\w*|menu\w*|breadcrumbs?|toc|pagination|pager|tabs?|skip",
    "foot": r"foot\w*|copyright|legal|credits",
    "head": r"head|masthead|topbar|site-?header|logo",
    "side": r"side\w*|aside|widgets?|related|recommend\w*|share|social|tags|rail",
    "talk": r"comments?\w*|replies|reply|disqus|respond|discussion",
    "note": r"cookies?|consent|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|gdpr",
    "main": r"article\w*|content|post|entry|story|main|body|text|prose",
}
_GROUP = re.compile("|".join(f"(?P<{k}>(?<![a-z0-9])(?:{v})(?![a-z0-9]))" for k, v in GROUPS.items()), re.I)
_TAGS = "html body main article section nav header footer aside form div ul ol li p h1 h2 h3 table td blockquote pre figure figcaption address details dialog other".split()
_TAG = {t: i for i, t in enumerate(_TAGS)}
_GROUP_AT = {g: len(_TAGS) + i for i, g in enumerate(GROUPS)}
_LEAF = len(_TAGS) + len(GROUPS)
#: Leaf features: bias, length classes, link share classes, sentence marks, under heading.
N_NODE = _LEAF + 1 + 5 + 3 + 2
#: Pair features: (parent, child) states for inner children and for leaves.
N_PAIR = 8


class Tree:
    """Nodes in page order: parent, features; leaves also have text."""

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.features: list[list[int]] = []
        self.text: list[str | None] = []


def _features(tag: str, attributes: str) -> list[int]:
    out = [_TAG.get(tag, _TAG["other"])]
    if attributes:
        words = " ".join(a or b or c for a, b, c in _ATTRIBUTE.findall(attributes))
        if words:
            out += {_GROUP_AT[m.lastgroup] for m in _GROUP.finditer(words)}
    return out


def _ends(source: str) -> dict[int, int]:
    """Where each skipped element that has an end begins and ends, in one pass."""
    out: dict[int, int] = {}
    opened: dict[str, list[int]] = {x: [] for x in _SKIPPED}
    head = None
    for m in _MARK.finditer(source):
        if not m[3]:
            continue
        closing, tag = m[2], m[3].lower()
        if tag == "head":
            if not closing:
                head = head or m
            elif head:
                out[head.start()], head = m.end(), None
        elif tag not in _SKIPPED:
            if head and not closing and (tag == "body" or not any(opened.values())):
                out[head.start()], head = _HEAD.match(source, head.end()).end(), None
        elif closing:
            if opened[tag]:
                out[opened[tag].pop()] = m.end()
        elif tag == "svg" and m[0].endswith("/>"):
            out[m.start()] = m.end()
        else:
            if tag not in _NESTED:
                opened[tag].clear()
            opened[tag].append(m.start())
    if head:
        out[head.start()] = _HEAD.match(source, head.end()).end()
    return out


def parse(source: str) -> Tree:
    tree = Tree()
    stack: list[tuple[str, int]] = []  # open block elements
    run: list[str] = []
    linked = 0  # characters of the run inside links
    in_link = 0

    def add(parent: int, features: list[int], text: str | None) -> int:
        tree.parent.append(parent)
        tree.features.append(features)
        tree.text.append(text)
        return len(tree.parent) - 1

    def flush() -> None:
        nonlocal run, linked
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                tag, parent = stack[-1] if stack else ("other", add(-1, [_TAG["other"]], None) if not tree.parent else 0)
                n, share = len(text), linked / max(1, len(text))
                f = [_LEAF, _LEAF + 1 + (n > 20) + (n > 60) + (n > 150) + (n > 400), _LEAF + 6 + (share > 0.2) + (share > 0.7), _TAG.get(tag, _TAG["other"])]
                if re.search(r"[.!?;,:](?:\s|$)", text):
                    f.append(_LEAF + 9)
                if tag[:1] == "h" and tag[1:].isdigit():
                    f.append(_LEAF + 10)
                add(parent, f, text)
            run, linked = [], 0

    # what follows the last ">" holds no whole tag: searching it for one at every "<" would be quadratic
    last = source.rfind(">") + 1
    source, tail = source[:last], source[last:]
    at, ends = 0, None
    while m := _PART.match(source, at):
        s, at = m[0], m.end()
        if at == last and (s.startswith("<!--") and not s.endswith("-->") or m[1] and not re.search(rf"</{m[1]}\s*>$", s, re.I)):
            tail = ""  # an open comment or script goes on
        if m[2]:
            ends = _ends(source) if ends is None else ends
            at = ends.get(m.start(), at)
            continue
        if s[0] != "<" or s == "<":
            run.append(s)
            if in_link:
                linked += len(s.strip())
            continue
        tag = m[4] or m[7]
        if not tag:
            continue
        closing, tag, attributes = m[3] or m[6], tag.lower(), m[5] or m[8] or ""
        if tag == "a":
            in_link = max(0, in_link + (-1 if closing else 1))
        elif tag == "br":
            run.append(" ")
        if tag not in BLOCKS:
            continue
        flush()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            in_link = 0
        else:
            while stack and (stack[-1][0] == "p" or (tag in _CLOSES and stack[-1][0] in _CLOSES[tag])):
                stack.pop()
            if tag not in _VOID:
                stack.append((tag, add(stack[-1][1] if stack else (0 if tree.parent else -1), _features(tag, attributes), None)))
    tail = tail.split("<!--", 1)[0]
    run.append(tail)
    linked += len(tail.strip()) if in_link else 0
    flush()
    return tree


def _messages(tree: Tree, node: np.ndarray, pair: np.ndarray) -> tuple[list, list, list]:
    """Scores of content, log-odds messages up and marginal log-odds of each node."""
    w = node.tolist()
    from math import exp, log1p

    def both(a: float, b: float) -> float:
        return a + log1p(exp(b - a)) if a > b else b + log1p(exp(a - b))

    tables = [pair[:4].tolist(), pair[4:].tolist()]
    n = len(tree.parent)
    score = [sum([w[k] for k in f]) for f in tree.features]
    own = score[:]
    up = [0.0] * n
    for i in range(n - 1, -1, -1):
        p = tree.parent[i]
        t = tables[tree.text[i] is not None]
        # message to the parent: child summed out, as log-odds of the parent being content
        up[i] = both(t[2], t[3] + own[i]) - both(t[0], t[1] + own[i])
        if p >= 0:
            own[p] += up[i]
    odds = own[:]
    for i in range(n):
        p = tree.parent[i]
        if p >= 0:
            t = tables[tree.text[i] is not None]
            above = odds[p] - up[i]
            odds[i] = own[i] + both(t[1], t[3] + above) - both(t[0], t[2] + above)
    return own, up, odds


def marginals(tree: Tree, node: np.ndarray, pair: np.ndarray) -> list[float]:
    """Each node's log-odds of being content."""
    return _messages(tree, node, pair)[2]


def _expected(tree: Tree, node: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, up, odds = _messages(tree, node, pair)
    e_node, e_pair = np.zeros(N_NODE), np.zeros(N_PAIR)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -35, 35)))
    for i, f in enumerate(tree.features):
        e_node[f] += sigmoid(odds[i])
        p = tree.parent[i]
        if p >= 0:
            leaf = 4 * (tree.text[i] is not None)
            above = odds[p] - up[i]
            joint = np.array([pair[leaf], pair[leaf + 1] + own[i], pair[leaf + 2] + above, pair[leaf + 3] + above + own[i]])
            joint = np.exp(joint - joint.max())
            e_pair[leaf : leaf + 4] += joint / joint.sum()
    return e_node, e_pair


def training_pages(count: int, seed: int = 5) -> list[tuple[str, list[str]]]:
    """Pages of several layouts with the texts of their content blocks."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("bcdfghlmnprstvw") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda a, b: words(a, b).capitalize() + r.choice([".", ".", "", "!"])
    links = lambda: "<ul>" + "".join(f'<li><a href="/{word()}">{words(1, 2)}</a></li>' for _ in range(r.randint(2, 7))) + "</ul>"

    def boiler(kind: str) -> str:
        return {
            "nav": lambda: f"<nav{r.choice(['', ' class=menu'])}>{links()}</nav>",
            "menu": lambda: f'<div class="{r.choice(["menu", "navbar", "breadcrumb"])}">{links()}</div>',
            "header": lambda: f"<header>{r.choice([f'<div class=logo>{words(1, 2)}</div>', f'<p>{words(1, 3)}</p>', links()])}</header>",
            "ad": lambda: f'<div class="{r.choice(["ad", "ads", "advert", "sponsored", "promo"])}">{r.choice([sentence(3, 14), f"<p>{sentence(3, 20)}</p>"])}</div>',
            "aside": lambda: f"<aside>{r.choice([links(), f'<p>{sentence(4, 25)}</p>'])}</aside>",
            "side": lambda: f'<div id="{r.choice(["sidebar", "related"])}"><h3>{words(1, 2)}</h3>{r.choice([links(), f"<p>{sentence(4, 25)}</p>"])}</div>',
            "note": lambda: f'<div class="{r.choice(["cookie-notice", "notice", "newsletter", "alert"])}"><p>{sentence(4, 20)}</p></div>',
            "form": lambda: f"<form><label>{words(1, 3)}</label><input name=q><p>{sentence(2, 8)}</p></form>",
            "talk": lambda: f'<{(t := r.choice(["section", "div"]))} {r.choice(["id=comments", "class=comments"])}><h2>{words(1, 2)}</h2>' + "".join(f'<div class="comment"><p>{sentence(4, 40)}</p></div>' for _ in range(r.randint(1, 4))) + f"</{t}>",
            "footer": lambda: f"<footer>{r.choice([f'&copy; {words(1, 2)} &middot; {sentence(3, 25)}', f'<p>{sentence(3, 15)}</p>', links()])}</footer>",
            "foot": lambda: f'<div class="footer"><p>{sentence(3, 15)}</p></div>',
        }[kind]()

    out = []
    for _ in range(count):
        kept: list[str] = []

        def say(text: str, kept: list[str] = kept) -> str:
            kept.append(text)
            return text

        parts = []
        if r.random() < 0.9:
            parts.append(f"<h1>{say(words(1, 9))}</h1>")
        for _ in range(r.randint(1, 7)):
            kind = r.random()
            if kind < 0.7:
                parts.append(f"<p>{say(sentence(1, 60))}</p>")
            elif kind < 0.78:
                parts.append(f"<h2>{say(words(1, 5))}</h2>")
            elif kind < 0.86:
                parts.append("<ul>" + "".join(f"<li>{say(words(1, 12))}</li>" for _ in range(r.randint(1, 4))) + "</ul>")
            elif kind < 0.9:
                parts.append(f"<blockquote><p>{say(sentence(3, 20))}</p></blockquote>")
            elif kind < 0.95:
                parts.append(f"<p>{say(sentence(3, 20))} <b>")
            else:
                parts.append(boiler(r.choice(["ad", "note", "side"])))
        body = "".join(parts)
        shell = r.choice(["<article>{}</article>", "<article>{}</article>", '<main><article class="post">{}</article></main>', "<main>{}</main>", '<div class="content">{}</div>', '<div id="main"><div class="entry">{}</div></div>', "<section>{}</section>"])
        before = [boiler(k) for k in r.sample(["nav", "menu", "header", "ad", "note", "side", "form"], r.randint(1, 4))]
        after = [boiler(k) for k in r.sample(["ad", "aside", "side", "talk", "footer", "foot", "form", "note"], r.randint(1, 4))]
        out.append(("<html><body>" + "".join(before) + shell.format(body) + "".join(after) + "</body></html>", kept))
    return out


@lru_cache(maxsize=2)
def trained(count: int = 160, rounds: int = 40, l2: float = 0.01) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Node and pair weights by gradient ascent on the likelihood of labelled pages."""
    data = []
    for page, kept in training_pages(count):
        tree = parse(page)
        left = list(kept)
        label = [0] * len(tree.parent)
        for i, text in enumerate(tree.text):
            if text is not None and left and text == " ".join(left[0].split()):
                label[i] = 1
                left.pop(0)
        # an element is content where most of the text below it is
        weight = np.zeros((len(label), 2))
        for i in range(len(label) - 1, -1, -1):
            if tree.text[i] is not None:
                weight[i, label[i]] = len(tree.text[i]) + 20
            else:
                label[i] = int(weight[i, 1] > weight[i, 0])
            if tree.parent[i] >= 0:
                weight[tree.parent[i]] += weight[i]
        t_node, t_pair = np.zeros(N_NODE), np.zeros(N_PAIR)
        for i, f in enumerate(tree.features):
            t_node[f] += label[i]
            if (p := tree.parent[i]) >= 0:
                t_pair[4 * (tree.text[i] is not None) + 2 * label[p] + label[i]] += 1
        data.append((tree, t_node, t_pair))
    w = np.zeros(N_NODE + N_PAIR)
    scale = np.full(len(w), 1e-6)
    for _ in range(rounds):
        g = -l2 * count * w
        for tree, t_node, t_pair in data:
            e_node, e_pair = _expected(tree, w[:N_NODE], w[N_NODE:])
            g += np.concatenate([t_node - e_node, t_pair - e_pair])
        scale += g * g
        w += 1.5 * g / np.sqrt(scale)
    return tuple(w[:N_NODE]), tuple(w[N_NODE:])


def main_text(source: str | None, node: np.ndarray, pair: np.ndarray) -> str:
    if not source:
        return ""
    tree = parse(source)
    odds = marginals(tree, node, pair)
    return "\n".join(t for t, o in zip(tree.text, odds, strict=True) if t is not None and o > 0)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    node, pair = (np.array(x) for x in trained())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in S.slices(batch, "html", SLICE)):
            texts = [main_text(x, node, pair) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(tidy(rows), "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: the main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
