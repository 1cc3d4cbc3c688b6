"""HTML extraction: gradient-boosted trees over the features of block nodes, decoded from the root down.

A page becomes a tree of block elements, whose own text is what inline elements hold. Features are a node's tag, tokens of its id,
class and role and those of its ancestors, text and link density of its subtree, depth, and its place among its siblings. The trees
are trained here, on pages that `training_page` and `bare_page` write with known answers. The decoder keeps the set of nodes with the largest
sum of log odds in which every kept node has only kept ancestors, so that no part of a dropped block comes back.

Pages are independent: there is no shuffle. Edges: null or empty html, or a page without a main text, gives an empty text; broken
markup is read as far as it goes; repeated rows get equal results; extra columns are passed over; no rows give no rows.
"""
from __future__ import annotations

import functools
import html
import math
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidescan.llm.boosting import Boosted

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|template|title|iframe)\b[^>]*?(?:/>|>.*?(?:</\1\s*>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*|[^>]*)(?:>|\Z)""", re.S | re.I)
_ATTR = re.compile(r"""(?:id|class|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a head may hold; any other ends it.
HEAD = frozenset("base link meta noscript script style template title".split())
#: Elements that start a block of their own.
BLOCK = frozenset("html body div p article section main nav header footer aside ul ol li dl dt dd table thead tbody tfoot tr td th form fieldset h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address details summary dialog menu button select option textarea label hgroup search center noscript head".split())
#: Elements that end an open paragraph.
ENDS_P = BLOCK - {"button", "label", "option", "select", "textarea", "td", "th", "tr"}
GROUPS = {
    "content": "article content post entry story body text main blog news page prose markdown description".split(),
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs pagination pager tabs toolbar toc links".split(),
    "header": "header head masthead banner top logo branding topbar title".split(),
    "footer": "footer foot bottom copyright legal colophon".split(),
    "side": "sidebar side aside widget related recommended trending rail tags popular more archive".split(),
    "advert": "ad ads advert advertisement advertising sponsor sponsored promo promotion adslot dfp commercial".split(),
    "comment": "comment comments reply replies disqus respond discussion reader feedback reviews thread".split(),
    "notice": "cookie cookies consent notice alert popup modal overlay gdpr newsletter subscribe subscription signup banner toast paywall".split(),
    "share": "share sharing social follow tweet facebook like meta byline author date".split(),
    "form": "form search login register contact input field".split(),
}
_GROUP = {w: k for k, (_, ws) in enumerate(GROUPS.items()) for w in ws}
TAGS = "p div article main section nav header footer aside ul li form h1 h2 blockquote pre table td figure".split()
_TAG = {t: k for k, t in enumerate(TAGS)}


class Node:
    __slots__ = ("tag", "groups", "parent", "children", "tags", "runs", "links", "depth")

    def __init__(self, tag: str, groups: int, parent: Node | None):
        self.tag, self.groups, self.parent = tag, groups, parent
        self.children: list[Node] = []
        self.tags: dict[str, int] = {}  # how many children have a tag
        self.runs: list[tuple[int, str]] = []
        self.links, self.depth = 0, parent.depth + 1 if parent else 0


def groups_of(attributes: str) -> int:
    """Bits of the groups whose words occur in id, class or role."""
    out = 0
    for value in _ATTR.findall(attributes) if "=" in attributes else ():
        for w in re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()):
            if w in _GROUP:
                out |= 1 << _GROUP[w]
    return out


def parse(page: str) -> list[Node]:
    """Block nodes in page order; runs are (place in the page, text of one stretch of inline content)."""
    root = Node("html", 0, None)
    nodes, stack, at, place, text, anchor, head = [root], [("html", root)], 0, 0, [], 0, False
    places: dict[str, list[int]] = defaultdict(list)  # of each tag's open elements in the stack

    def flush():
        nonlocal place, text
        joined = " ".join("".join(text).split())
        text = []
        if joined:
            stack[-1][1].runs.append((place, joined))
            place += 1

    def close(k: int):
        nonlocal anchor
        if any(b for _, b in stack[k:] if b is not stack[k - 1][1]):
            flush()
        for t, _ in stack[k:]:
            anchor -= t == "a"
            places[t].pop()
        del stack[k:]

    def last(*tags: str) -> int:
        """Place of the innermost open element with one of the tags; 0 if there is none."""
        return max((places[t][-1] for t in tags if places[t]), default=0)

    def push(tag: str, node: Node):
        places[tag].append(len(stack))
        stack.append((tag, node))

    def put(raw: str):
        if raw and not head:
            found = html.unescape(raw)
            text.append(found)
            if anchor:
                stack[-1][1].links += len(found.strip())

    for m in _TOKEN.finditer(page):
        put(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if m[2]:
            if tag == "head":
                head = False
            if tag == "br":
                text.append(" ")
            k = last(tag)
            # An inline end tag doesn't reach beyond its block.
            if k and (tag in BLOCK or stack[k][1] is stack[-1][1]):
                close(k)
            continue
        if tag == "head":
            head = True
            continue
        if head and tag not in HEAD:
            head = False
        if head and tag == "noscript":
            continue
        if tag == "html" or tag == "body" and places["body"]:
            continue
        if tag in VOID:
            text.append(" ")
            continue
        if tag in ENDS_P:
            k = last("p")
            if k > last("button", "td", "th", "table"):
                close(k)
        if tag in ("li", "option", "tr", "td", "th", "dt", "dd"):
            same = {"td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}.get(tag, (tag,))
            stop = {"li": ("ul", "ol", "menu"), "option": ("select",), "dt": ("dl",), "dd": ("dl",)}.get(tag, ("table",))
            k = last(*same)
            if k > last(*stop):
                close(k)
        if tag in BLOCK:
            flush()
            node = Node(tag, groups_of(m[4] or ""), stack[-1][1])
            stack[-1][1].children.append(node)
            stack[-1][1].tags[tag] = stack[-1][1].tags.get(tag, 0) + 1
            nodes.append(node)
            push(tag, node)
        else:
            anchor += tag == "a"
            push(tag, stack[-1][1])
    put(page[at:])
    flush()
    return nodes


WIDTH = len(TAGS) + 2 * len(GROUPS) + 20


def features(nodes: list[Node]) -> np.ndarray:
    n = len(nodes)
    number = {id(v): k for k, v in enumerate(nodes)}
    own = [sum(len(t) for _, t in v.runs) for v in nodes]
    chars, links, blocks, paras, stops = list(own), [v.links for v in nodes], [1] * n, [v.tag == "p" for v in nodes], [sum(t.count(".") + t.count(",") for _, t in v.runs) for v in nodes]
    for k in range(n - 1, 0, -1):
        p = number[id(nodes[k].parent)]
        for x in (chars, links, blocks, paras, stops):
            x[p] += x[k]
    above = [0] * n
    out = np.zeros((n, WIDTH))
    total, seen, g, base = max(1, chars[0]), 0, len(GROUPS), len(TAGS)
    ancestors: list[int] = [0] * n
    for k, v in enumerate(nodes):
        p = number[id(v.parent)] if v.parent else 0
        if k:
            above[k] = above[p] | nodes[p].groups
            ancestors[k] = ancestors[p] | 1 << _TAG.get(nodes[p].tag, 31)
        siblings, alike = (len(v.parent.children), v.parent.tags[v.tag]) if v.parent else (1, 1)
        row = out[k]
        if v.tag in _TAG:
            row[_TAG[v.tag]] = 1
        for j in range(g):
            row[base + j] = v.groups >> j & 1
            row[base + g + j] = above[k] >> j & 1
        row[base + 2 * g :] = (
            math.log1p(own[k]), math.log1p(chars[k]), links[k] / max(1, chars[k]), chars[k] / blocks[k], math.log1p(blocks[k]), math.log1p(paras[k]), stops[k] / max(1, chars[k]),
            v.depth, siblings, alike / siblings, chars[k] / total, seen / total, chars[k] / max(1, chars[p]), v.tag in ("button", "select", "option", "textarea", "label", "fieldset"),
            ancestors[k] >> _TAG["article"] & 1 or ancestors[k] >> _TAG["main"] & 1, ancestors[k] >> _TAG["nav"] & 1 or ancestors[k] >> _TAG["form"] & 1, ancestors[k] >> _TAG["header"] & 1, ancestors[k] >> _TAG["footer"] & 1, ancestors[k] >> _TAG["aside"] & 1, ancestors[k] >> _TAG["li"] & 1,
        )
        seen += own[k]
    return out


def decode(nodes: list[Node], logits: np.ndarray) -> list[bool]:
    """Kept nodes: the best sum of weighted log odds with no kept node below a dropped one. The root is kept."""
    number = {id(v): k for k, v in enumerate(nodes)}
    gain = [float(x) * (1 + math.log1p(sum(len(t) for _, t in v.runs))) for x, v in zip(logits, nodes, strict=True)]
    best = list(gain)
    for k in range(len(nodes) - 1, 0, -1):
        if best[k] > 0:
            best[number[id(nodes[k].parent)]] += best[k]
    kept = [True] * len(nodes)
    for k in range(1, len(nodes)):
        kept[k] = kept[number[id(nodes[k].parent)]] and best[k] > 0
    return kept


def text_of(nodes: list[Node], kept: list[bool], logits: np.ndarray) -> str:
    """Texts of kept blocks in page order. A node that is kept for its children alone gives no text of its own."""
    return " ".join(t for _, t in sorted(r for v, k, x in zip(nodes, kept, logits, strict=True) if k and x > 0 for r in v.runs))


# Training pages ------------------------------------------------------------------------------------------------------

_SYLLABLES = "ra to mi ne sul ver an or tis ble ing con der pa lo ge shu ki mon est ur da fen vo".split()


def _sentence(r: random.Random, lo: int, hi: int) -> str:
    words = ["".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 3))) + ("," if r.random() < 0.08 else "") for _ in range(r.randint(lo, hi))]
    return " ".join(words).strip(",").capitalize() + "."


def _prose(r: random.Random, most: int = 6) -> str:
    return " ".join(_sentence(r, 4, 18) for _ in range(r.randint(1, most)))


def _links(r: random.Random, n: int) -> str:
    items = "".join(f'<li><a href="/{k}">{_sentence(r, 1, 3).strip(".")}</a></li>' for k in range(n))
    return f"<ul>{items}</ul>"


def _name(r: random.Random, group: str) -> str:
    return f' {r.choice(("class", "id"))}="{r.choice(("", "site-", "page-", "block "))}{r.choice(GROUPS[group])}{r.choice(("", "-box", " wide", "-1"))}"'


def _noise(r: random.Random, group: str) -> str:
    """A block that isn't main text; its paragraphs can look like it."""
    tag = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form"}.get(group, "div")
    tag, name = (tag, "" if r.random() < 0.5 else _name(r, group)) if tag != "div" and r.random() < 0.7 else ("div", _name(r, group))
    if group == "menu":
        inner = _links(r, r.randint(3, 9))
    elif group == "form":
        inner = f"<label>{_sentence(r, 1, 3)}</label><input name=q><p>{_sentence(r, 2, 8)}</p><select><option>{_sentence(r, 1, 2)}<option>{_sentence(r, 1, 2)}</select><button>{_sentence(r, 1, 2)}</button>"
    elif group == "comment":
        inner = f"<h3>{_sentence(r, 1, 3)}</h3>" + "".join(f"<div{_name(r, 'comment') if r.random() < 0.6 else ''}><p>{_prose(r, 3)}</p></div>" for _ in range(r.randint(1, 5)))
    elif group == "side":
        inner = f"<h3>{_sentence(r, 1, 3)}</h3>" + (_links(r, r.randint(2, 6)) if r.random() < 0.6 else "".join(f"<p>{_prose(r, 2)}</p>" for _ in range(r.randint(1, 3))))
    elif group == "header":
        inner = f"<h1>{_sentence(r, 1, 3)}</h1>" + (_noise(r, "menu") if r.random() < 0.4 else f"<p>{_sentence(r, 2, 8)}</p>")
    else:
        inner = r.choice((_sentence(r, 2, 12), f"<p>{_prose(r, 2)}</p>", f'<p>{_sentence(r, 2, 9)} <a href="/x">{_sentence(r, 1, 3)}</a></p>', f"<div>{_sentence(r, 2, 10)}</div>"))
    return f"<{tag}{name}>{inner}</{tag}>"


def training_page(seed: int) -> tuple[str, str]:
    """A page and its main text."""
    r, main = random.Random(seed), []

    def keep(tag: str, text: str) -> str:
        main.append(text)
        style = r.random()
        return f"<{tag}>{text}</{tag}>" if style < 0.7 or tag != "p" else f"<p>{text}" if style < 0.8 else f"<p><b>{text}</b></p>" if style < 0.9 else f'<p class="{r.choice(("lead", "text", "para"))}">{text}</p>'

    body = [keep("h1", _sentence(r, 1, 10))] if r.random() < 0.8 else []
    short = r.random() < 0.3
    for _ in range(r.randint(0 if body else 1, 2) if short else r.randint(1, 12)):
        kind = r.random()
        if short:
            body.append(keep("p", _sentence(r, 1, 12)))
        elif kind < 0.75:
            body.append(keep("p", _prose(r, r.choice((1, 3, 8)))))
        elif kind < 0.82:
            body.append(keep("h2", _sentence(r, 1, 6)))
        elif kind < 0.88:
            body.append("<ul>" + "".join(keep("li", _sentence(r, 2, 12)) for _ in range(r.randint(2, 4))) + "</ul>")
        elif kind < 0.92:
            body.append("<blockquote>" + keep("p", _prose(r, 2)) + "</blockquote>")
        elif kind < 0.95:
            body.append("<div>" + keep("p", _prose(r, 3)) + "</div>")
        else:
            body.append(_noise(r, r.choice(("advert", "share", "side", "notice", "form"))))
    if r.random() < 0.15:
        body.append(_noise(r, "comment"))
    tag = r.choice(("article", "article", "main", "div", "section"))
    name = _name(r, "content") if tag in ("div", "section") or r.random() < 0.3 else ""
    block = f"<{tag}{name}>{''.join(body)}</{tag}>"
    if r.random() < 0.3:
        block = f"<div{r.choice(('', ' class=row', ' id=wrap'))}>{block}{_noise(r, 'side') if r.random() < 0.5 else ''}</div>"
    before = [_noise(r, g) for g in ("notice", "header", "menu", "advert", "form") if r.random() < (0.7 if g in ("menu", "header") else 0.4)]
    after = [_noise(r, g) for g in ("share", "comment", "side", "advert", "form", "footer") if r.random() < (0.8 if g == "footer" else 0.4)]
    page = f"<!DOCTYPE html><html><head><title>{_sentence(r, 1, 5)}</title><script>var a='<p>';</script></head><body>{''.join(before)}{block}{''.join(after)}" + ("</body></html>" if r.random() < 0.8 else "")
    return page, " ".join(main)


def bare_page(seed: int) -> tuple[str, str]:
    """A page of prose alone, in paragraphs or without markup, and its text."""
    r = random.Random(f"bare {seed}")
    texts = [_prose(r, r.choice((1, 3, 8))) for _ in range(r.choice((1, 1, 2, 5)))]
    kind = r.choice(("plain", "p", "body", "div"))
    if kind == "plain":
        return " ".join(texts), " ".join(texts)
    page = "".join(f"<{'div' if kind == 'div' else 'p'}>{t}</{'div' if kind == 'div' else 'p'}>" for t in texts)
    return f"<html><body>{page}</body></html>" if kind == "body" else page, " ".join(texts)


def _labels(nodes: list[Node], main: str) -> list[int]:
    """1 for a node with main text of its own or below it."""
    number = {id(v): k for k, v in enumerate(nodes)}
    out, at = [0] * len(nodes), 0
    for _, k, t in sorted((place, number[id(v)], t) for v in nodes for place, t in v.runs):
        if main.startswith(t, at):
            out[k], at = 1, at + len(t) + 1
    for k in range(len(nodes) - 1, 0, -1):
        out[number[id(nodes[k].parent)]] |= out[k]
    return out


@functools.lru_cache(maxsize=2)
def trained(pages: int = 1000) -> Boosted:
    x, y = [], []
    for page, main in [*map(training_page, range(pages)), *map(bare_page, range(pages // 10))]:
        nodes = parse(page)
        x.append(features(nodes))
        y += _labels(nodes, main)
    return Boosted(trees=60).fit(np.concatenate(x), np.array(y, float))


def extract(pages: list[str | None], model: Boosted) -> list[str]:
    trees = [parse(p) if p else [] for p in pages]
    every = [features(t) for t in trees if t]
    logits = model.logit(np.concatenate(every)) if every else np.empty(0)
    out, at = [], 0
    for t in trees:
        x = logits[at : at + len(t)]
        at += len(t)
        out.append(text_of(t, decode(t, x), x) if t else "")
    return out


def html_extract(pages: DataFrame, html_col: str = "html", training_pages: int = 1000) -> DataFrame:
    """pages without the html, with its main text in a column `text` (one that is there already is replaced)."""
    model = pages.sparkSession.sparkContext.broadcast(trained(training_pages))

    def run(batches):
        for b in batches:
            k = b.num_columns - 1
            texts = []
            for lo in range(0, b.num_rows, 64):
                texts += extract(b.column(k)[lo : lo + 64].to_pylist(), model.value)
            yield pa.RecordBatch.from_arrays([*(b.column(j) for j in range(k)), pa.array(texts, pa.string())], names=[*b.schema.names[:-1], "text"])

    rest = [c for c in pages.columns if c not in (html_col, "text")]
    ready = pages.select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{html_col}`").cast("string").alias("_html"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema.fields[:-1])
    return ready.mapInArrow(run, f"{fields}, text string")


def query(spark, sf_dir: str) -> DataFrame:
    out = html_extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
