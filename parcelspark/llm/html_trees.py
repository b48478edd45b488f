"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the hierarchy.

Pages are read into a tree of block elements; inline elements do not cut text. Every node has features of
its subtree (text density, link share, sentence marks), its attribute tokens and those of its ancestors, its depth, its
place among its siblings and in the page. Boosted trees give each node the log-odds that its text is main text.
Decoding keeps the set of nodes with the largest total log-odds among those sets in which a kept node's ancestors are
all kept, by one pass from the leaves: so no block is kept below a dropped ancestor.

Training needs no labels: on a bounded sample of pages, blocks inside the semantic main element are main text. Each sampled page
is also rebuilt a few times from its own texts in other layouts, with and without semantic elements, with menus, notices,
adverts, sidebars, forms and reader comments in known places, so that the trees do not lean on one template.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from parcelspark.llm.textblocks import slices

#: Pages that the trees are fitted to, at most about; a bound of the method. Rebuilt layouts of each.
SAMPLE_PAGES, LAYOUTS = 250, 4
#: Elements of HTML. Raw ones have no text of the page, block ones cut it.
#: Of svg, a self-closed tag is the whole element.
RAW = "script|style|noscript|template|textarea|select|iframe|title|canvas|audio|video"
BLOCK = frozenset("""html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    header hgroup hr legend li main menu nav ol p pre section summary table caption tbody thead tfoot tr td th ul""".split())
VOID = frozenset("hr br img input meta link area base col embed source track wbr".split())
#: A start tag of the key closes open elements of the value, up to a container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
PIECE = re.compile(rf"<!--.*?(?:-->|\Z)|<svg(?=[\s/>])[^>]*(?:(?<=/)>|>.*?(?:</svg\s*>|\Z))|<({RAW})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL | re.IGNORECASE)
ATTRIBUTE = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
#: Attribute tokens by what they tell.
LEXICON = [
    "nav menu navbar navigation breadcrumb breadcrumbs toc tabs pager pagination", "header masthead topbar logo branding hero", "footer foot copyright colophon legal",
    "sidebar side aside related widget widgets recommended rail more popular trending", "ad ads advert advertisement adverts sponsor sponsored promo promotion banner",
    "cookie cookies notice consent gdpr popup modal alert message newsletter subscribe overlay privacy", "form search login signup contact register poll",
    "comment comments reply replies respond discussion disqus thread feedback reader", "content article main post entry story body text maincontent articlebody prose",
    "share social tags meta byline author date",
]
GROUP_OF = {word: k for k, words in enumerate(LEXICON) for word in words.split()}
TAGS = ["nav", "header", "footer", "aside", "form", "article", "main", "section", "div", "p", "h1 h2 h3 h4 h5 h6", "ul ol menu", "li", "table tr td th tbody", "blockquote pre", "figure figcaption"]
TAG_OF = {tag: k for k, tags in enumerate(TAGS) for tag in tags.split()}
SEMANTIC = 7  # the first tags also count when an ancestor has them
N_FEATURES = 2 * len(LEXICON) + len(TAGS) + SEMANTIC + 17
MARK = "\ue000"  # stands before main text in rebuilt pages


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    groups: int  # bits of LEXICON
    above: int  # those of the ancestors
    semantic: int  # bits of the first TAGS at or above
    index: int
    children: list[int] = field(default_factory=list)


def parse(page: str | None) -> tuple[list[Node], list[tuple[int, str, int]]]:
    """Block elements, and blocks in page order: (node, text, characters inside links)."""
    nodes = [Node("root", -1, 0, 0, 0, 0, 0)]
    stack, blocks, buffer, links = [0], [], [], [0, 0]  # links: open anchors, characters in them
    at, page = 0, page or ""

    def flush() -> None:
        text = " ".join("".join(buffer).split())
        if text:
            blocks.append((stack[-1], text, min(links[1], len(text))))
        buffer.clear()
        links[1] = 0

    def put(raw: str) -> None:
        if raw:
            text = html.unescape(raw)
            buffer.append(text)
            if links[0]:
                links[1] += len(text)

    for found in PIECE.finditer(page):
        put(page[at : found.start()])
        at = found.end()
        tag = found[3].lower() if found[3] else None
        if tag is None:
            continue
        if tag not in BLOCK:
            if tag == "a":
                links[0] = 0 if found[2] else 1
            elif tag in ("br", "img", "input", "button", "option"):
                buffer.append(" ")
            continue
        flush()
        links[0] = 0
        if found[2]:
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == tag:
                    del stack[k:]
                    break
            continue
        if nodes[stack[-1]].tag == "p":
            stack.pop()
        if tag in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag in SCOPES[tag]:
                    break
                if nodes[stack[k]].tag in CLOSES[tag]:
                    del stack[k:]
                    break
        if tag in VOID:
            continue
        groups = 0
        for value in ATTRIBUTE.findall(found[4]):
            for word in re.findall(r"[a-z]+", "".join(value).lower()):
                if word in GROUP_OF:
                    groups |= 1 << GROUP_OF[word]
        up = nodes[stack[-1]]
        own = TAG_OF.get(tag, 99)
        nodes.append(Node(tag, stack[-1], up.depth + 1, groups, up.above | up.groups, up.semantic | (1 << own if own < SEMANTIC else 0), len(up.children)))
        up.children.append(len(nodes) - 1)
        stack.append(len(nodes) - 1)
    put(page[at:])
    flush()
    return nodes, blocks


STOPS = re.compile(r"[.!?;,]")


def features(nodes: list[Node], blocks: list[tuple[int, str, int]]) -> np.ndarray:
    """One row per node; children come after their parents, so sums run backwards."""
    n = len(nodes)
    # own and then subtree sums: characters, link characters, words, sentence marks, blocks, first character's place
    sums = np.zeros((n, 5))
    first, done = np.full(n, -1.0), 0
    for node, text, linked in blocks:
        sums[node] += (len(text), linked, text.count(" ") + 1, len(STOPS.findall(text)), 1)
        if first[node] < 0:
            first[node] = done
        done += len(text)
    own = sums.copy()
    for k in range(n - 1, 0, -1):
        up = nodes[k].parent
        sums[up] += sums[k]
        if first[k] >= 0 and (first[up] < 0 or first[k] < first[up]):
            first[up] = first[k]
    rows = np.zeros((n, N_FEATURES), np.float32)
    g, t = len(LEXICON), len(TAGS)
    tags_below = [Counter(nodes[c].tag for c in node.children) for node in nodes]
    for k, node in enumerate(nodes):
        row = rows[k]
        for bit in range(g):
            row[bit] = node.groups >> bit & 1
            row[g + bit] = node.above >> bit & 1
        place = TAG_OF.get(node.tag)
        if place is not None:
            row[2 * g + place] = 1
        for bit in range(SEMANTIC):
            row[2 * g + t + bit] = node.semantic >> bit & 1
        chars, linked, words, stops, count = sums[k]
        up = max(node.parent, 0)
        beside = nodes[up].children
        like = tags_below[up][node.tag]
        row[2 * g + t + SEMANTIC :] = (
            np.log1p(chars), np.log1p(own[k, 0]), linked / max(chars, 1), stops / max(words, 1), words / max(count, 1), np.log1p(count), len(node.children), node.depth,
            node.index, len(beside), like, chars / max(sums[up, 0], 1), chars / max(done, 1), max(first[k], 0) / max(done, 1), sums[up, 1] / max(sums[up, 0], 1),
            stops / max(stops + count, 1), (sums[up, 3] - stops) / max(sums[up, 2] - words, 1))
    return rows


@dataclass
class Trees:
    """Boosted trees of equal depth: feature and threshold of the inner nodes, values of the leaves."""

    base: float
    split_feature: np.ndarray  # trees x inner nodes, breadth first
    split_value: np.ndarray
    leaves: np.ndarray

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.base)
        depth, number = int(np.log2(self.leaves.shape[1])) if len(self.leaves) else 0, np.arange(len(rows))
        for splits, values, leaves in zip(self.split_feature, self.split_value, self.leaves):
            at = np.zeros(len(rows), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (rows[number, splits[at]] > values[at])
            total += leaves[at - (len(leaves) - 1)]
        return total


def fit_trees(rows: np.ndarray, labels: np.ndarray, weights: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 24, ridge: float = 2.0) -> Trees:
    """Newton boosting of the logistic loss with histogram splits. Without rows of both labels: a constant."""
    inner = (1 << depth) - 1
    share = float((labels * weights).sum() + 0.5) / float(weights.sum() + 1)
    base = float(np.log(share / (1 - share)))
    if len(set(labels.tolist())) < 2:
        return Trees(base if len(labels) else -1.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    m, width = rows.shape
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    codes = np.column_stack([np.searchsorted(e, rows[:, f], side="left") for f, e in enumerate(edges)]) if m else np.zeros((0, width), np.int64)
    shifted = codes + np.arange(width) * bins
    score = np.full(m, base)
    out = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        grad, hess = weights * (p - labels), weights * p * (1 - p) + 1e-6
        feature, value, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(m, np.int64)
        for level in range(depth):
            low, many = (1 << level) - 1, 1 << level
            cell = ((at - low)[:, None] * (width * bins) + shifted).ravel()
            g = np.bincount(cell, np.repeat(grad, width), many * width * bins).reshape(many, width, bins).cumsum(2)
            h = np.bincount(cell, np.repeat(hess, width), many * width * bins).reshape(many, width, bins).cumsum(2)
            gt, ht = g[:, :1, -1:], h[:, :1, -1:]
            gain = g * g / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt * gt / (ht + ridge)
            gain[..., -1] = -1
            best = gain.reshape(many, -1).argmax(1)
            for node in range(many):
                f, b = divmod(int(best[node]), bins)
                if gain[node, f, b] > 1e-3 and b < len(edges[f]):
                    feature[low + node], value[low + node] = f, edges[f][b]
            at = 2 * at + 1 + (rows[np.arange(m), feature[at]] > value[at])
        leaf = at - inner
        step = -rate * np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, hess, inner + 1) + ridge)
        score += step[leaf]
        for part, new in zip(out, (feature, value, step)):
            part.append(new)
    return Trees(base, *(np.array(part) for part in out))


def decode(nodes: list[Node], log_odds: np.ndarray) -> np.ndarray:
    """The ancestor-closed set of nodes with the largest sum of log-odds, as flags."""
    worth = log_odds.copy()
    for k in range(len(nodes) - 1, 0, -1):
        if worth[k] > 0:
            worth[nodes[k].parent] += worth[k]
    keep = worth > 0
    for k in range(1, len(nodes)):
        keep[k] &= keep[nodes[k].parent]
    return keep


def semantic_blocks(nodes: list[Node], blocks: list[tuple[int, str, int]]) -> list[bool]:
    """Whether each block is main text by the page's semantic elements; without any, by attribute tokens and links."""
    inside = 1 << TAG_OF["article"] | 1 << TAG_OF["main"]
    outside = sum(1 << TAG_OF[t] for t in ("nav", "footer", "aside", "form"))
    marked = any(node.semantic & inside for node in nodes)
    found = []
    for at, text, linked in blocks:
        node = nodes[at]
        bad = node.semantic & outside or (node.groups | node.above) & 0b11111111
        good = node.semantic & inside if marked else node.tag in ("p", "h1", "h2", "h3", "blockquote", "pre", "li") and linked < 0.3 * len(text)
        found.append(bool(good and not bad))
    return found


def layouts(main: list[str], other: list[str], seed: int, count: int = LAYOUTS) -> list[str]:
    """Pages rebuilt from main and other texts in random layouts; MARK stands before each main text."""
    draw = random.Random(seed)
    esc = html.escape
    pick = draw.choice
    some = lambda texts, n: [esc(pick(texts)[: draw.choice((40, 160, 600))]) for _ in range(n)]
    attr = lambda group: pick((f' class="{pick(LEXICON[group].split())}"', f' id="{pick(LEXICON[group].split())}-{pick(("box", "wrap", "1", "inner"))}"', f' class="x{draw.randint(1, 99)}"'))
    sure = lambda group: pick((f' class="{pick(LEXICON[group].split())}"', f' id="{pick(LEXICON[group].split())}"', f' class="{pick(LEXICON[group].split())} c{draw.randint(1, 9)}"'))
    pages = []
    for _ in range(count):
        linked = lambda n: "".join(f'<li><a href="#">{t[:30]}</a></li>' for t in some(other + main, n))  # noqa: E731,B023
        text = lambda n: "".join(f"<p>{t}</p>" for t in some(other + main, n))  # noqa: E731,B023
        body = [f"<p>{MARK}{esc(t)}</p>" if draw.random() < 0.9 else f"<p><b>{MARK}{esc(t)}<br>" for t in main[1 : draw.randint(2, 14)]]
        if draw.random() < 0.3:
            body.insert(draw.randint(0, len(body)), f"<div{sure(4)}>{text(1)}</div>")
        if draw.random() < 0.2:
            body.insert(draw.randint(0, len(body)), f"<ul>{''.join(f'<li>{MARK}{esc(t[:120])}</li>' for t in main[:3])}</ul>")
        if draw.random() < 0.2:
            body.insert(draw.randint(0, len(body)), f"<blockquote>{MARK}{esc(pick(main))}</blockquote>")
        head = f"<{(h := pick(('h1', 'h1', 'h2')))}>{MARK}{esc(main[0])}</{h}>" if draw.random() < 0.8 else ""
        tag = pick(("article", "main", "div", "div", "section"))
        inner = head + "".join(body)
        if draw.random() < 0.2:
            inner = f"<header>{head}</header>" + "".join(body)
        article = f"<{tag}{sure(8) if tag in ('div', 'section') or draw.random() < 0.3 else ''}>{inner}</{tag}>"
        if draw.random() < 0.4:
            article = f"<div{attr(8)}>{article}</div>"
        parts = []
        if draw.random() < 0.6:
            parts.append(pick((f"<header{attr(1)}><p>{some(other, 1)[0]}</p></header>", f"<div{sure(1)}><h1>{some(other, 1)[0][:30]}</h1>{text(1)}</div>")))
        if draw.random() < 0.9:
            parts.append(pick((f"<nav><ul>{linked(draw.randint(2, 9))}</ul></nav>", f"<div{sure(0)}><ul>{linked(draw.randint(2, 9))}</ul></div>", f"<ul{sure(0)}>{linked(5)}</ul>")))
        if draw.random() < 0.4:
            parts.append(f"<div{sure(5)}>{text(draw.randint(1, 2))}</div>")
        if draw.random() < 0.5:
            parts.append(pick((f"<div{sure(4)}>{some(other, 1)[0]}</div>", f"<aside{sure(4)}>{text(1)}</aside>", f"<div{sure(4)}>{text(2)}</div>")))
        parts.append(article)
        if draw.random() < 0.5:
            side = pick((f"<aside><h3>{some(other, 1)[0][:30]}</h3>{text(draw.randint(1, 3))}<ul>{linked(3)}</ul></aside>", f"<div{sure(3)}><h3>{some(other, 1)[0][:30]}</h3><ul>{linked(4)}</ul>{text(draw.randint(0, 3))}</div>"))
            parts.insert(draw.choice((len(parts), len(parts) - 1)), side)
        if draw.random() < 0.5:
            replies = "".join(f"<div class=\"{pick(('comment', 'reply', 'c1'))}\">{text(draw.randint(1, 2))}</div>" for _ in range(draw.randint(1, 4)))
            parts.append(f"<{(t := pick(('section', 'div', 'ol')))}{sure(7)}><h3>{some(other, 1)[0][:25]}</h3>{replies}</{t}>")
        if draw.random() < 0.4:
            parts.append(f"<form{attr(6)}><p>{some(other, 1)[0]}</p><label>{some(other, 1)[0][:20]}</label><input name=q><button>{some(other, 1)[0][:10]}</button></form>")
        if draw.random() < 0.9:
            parts.append(pick((f"<footer>&copy; {some(other, 1)[0]}</footer>", f"<div{sure(2)}>{text(1)}&copy;</div>", f"<footer{attr(2)}>{text(1)}<ul>{linked(3)}</ul></footer>")))
        inside = "".join(parts)
        if draw.random() < 0.4:
            inside = f'<div id="{pick(("page", "wrapper", "container", "app"))}">{inside}</div>'
        pages.append(f"<html><head><title>{esc(main[0])}</title></head><body>{inside}</body></html>")
    return pages


def _examples(page: str, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature rows, labels and weights of a page's nodes with text and of its rebuilt layouts'."""
    nodes, blocks = parse(page)
    flags = semantic_blocks(nodes, blocks)
    cases = [(nodes, blocks, flags)]
    main, other = ([text for (_, text, _), flag in zip(blocks, flags) if flag == want] for want in (True, False))
    if main and other:
        for rebuilt in layouts(main, other, seed):
            nodes, blocks = parse(rebuilt)
            cases.append((nodes, [(a, t.replace(MARK, ""), n) for a, t, n in blocks], [t.startswith(MARK) for _, t, _ in blocks]))
    rows, labels = [], []
    for nodes, blocks, flags in cases:
        size = np.zeros((len(nodes), 2))
        for (at, text, _), flag in zip(blocks, flags):
            size[at, int(flag)] += len(text)
        for k in range(len(nodes) - 1, 0, -1):
            size[nodes[k].parent] += size[k]
        some = np.flatnonzero(size.sum(1))
        rows.append(features(nodes, blocks)[some])
        labels.append(size[some, 1] >= size[some].sum(1) / 2)
    rows_, labels_ = np.concatenate(rows), np.concatenate(labels)
    return rows_, labels_, np.full(len(labels_), 20 / max(len(labels_), 20))


def train(pages: DataFrame, id_column: str = "page_id", html_column: str = "html", sample_pages: int = SAMPLE_PAGES) -> Trees:
    """Trees fitted to about ``sample_pages`` pages, chosen by id hash. No pages: nothing is main text."""
    rows = pages.select(F.coalesce(pages[id_column].cast("string"), F.lit("")).alias("id"), pages[html_column].alias("html")).filter("html is not null")
    limit = int(min(1.0, sample_pages / max(rows.count(), 1)) * (1 << 30))
    chosen = rows.withColumn("place", F.pmod(F.xxhash64("id"), F.lit(1 << 30))).filter(F.col("place") <= limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            made = [_examples(page, place) for page, place in zip(batch.column("html").to_pylist(), batch.column("place").to_pylist())]
            yield pa.RecordBatch.from_arrays([
                batch.column("place"), *(pa.array([np.asarray(m[k], kind).tobytes() for m in made], pa.binary()) for k, kind in enumerate(("f4", "u1", "f8")))],
                names=["place", "rows", "labels", "weights"])

    found = chosen.select("place", "html").mapInArrow(run, "place long, rows binary, labels binary, weights binary").collect()
    found.sort(key=lambda row: (row.place, row.rows))
    join = lambda name, kind: np.frombuffer(b"".join(bytes(row[name]) for row in found), kind)
    return fit_trees(join("rows", "f4").reshape(-1, N_FEATURES), join("labels", "u1").astype(np.float64), join("weights", "f8"))


def extract(pages: DataFrame, model: Trees, html_column: str = "html") -> DataFrame:
    """The input's columns with ``text`` and ``n_chars``: the main text, its blocks joined by line feeds.

    Character references are decoded, white space within a block is one blank, blocks are trimmed. A null or empty page, and one without
    main text, has the empty text. Input columns of these two names are replaced. Rows stay as they are.
    """
    pages = pages.drop("text", "n_chars")
    schema = T.StructType([*pages.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    shared = pages.sparkSession.sparkContext.broadcast(model)  # a fixed number of trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, html_column):
            parsed = [parse(page) for page in batch.column(html_column).to_pylist()]
            rows = np.concatenate([features(*tree) for tree in parsed])
            odds = np.split(model.log_odds(rows), np.cumsum([len(nodes) for nodes, _ in parsed])[:-1])
            texts = []
            for (nodes, blocks), own in zip(parsed, odds):
                keep = decode(nodes, own)
                texts.append("\n".join(text for at, text, _ in blocks if keep[at]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return pages.mapInArrow(run, schema)
