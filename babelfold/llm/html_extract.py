"""Main text of web pages by boosted trees over DOM nodes.

Every block element and every run of text between block boundaries is a node.
Its features are the tag, tokens of class, id and role (own and inherited),
subtree text, link and tag density, depth, place in the page and statistics of
its siblings.  Gradient-boosted trees (Spark ML) give the probability that a
node's subtree holds no main text.

Decoding is hierarchical: over the whole tree the likeliest choice is taken
under which everything below a rejected node is rejected and everything above
a kept one is kept (two costs a node, summed from the leaves up).

There are no labelled pages, so training pages are made from the words of
about ``TRAIN_PAGES`` pages of the table: layouts with menus, headers, footers,
sidebars, notices, adverts, forms and reader comments around an article, of
which it is known what is what.  Pages are read where they lie, without a
shuffle; the trees, of a fixed size, are broadcast.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cluster import cut, ready, sampled

TRAIN_PAGES, VARIANTS = 300, 3
TREES, DEPTH = 20, 5
SLICE_CHARS = 1 << 21

# fixed values: what HTML says of its elements
RAW = ("script", "style", "textarea", "iframe", "title", "noembed", "noframes", "xmp")
HIDDEN = frozenset(("noscript", "template", "svg", "select", "object"))  # markup inside, which shows no main text
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure
footer form frameset h1 h2 h3 h4 h5 h6 header hgroup legend li main menu nav ol p pre search section summary table caption
tbody td tfoot th thead tr ul button label option""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# elements that end when one of the second begins
ENDS = {"p": BLOCKS - {"html", "body", "button", "label", "option"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
        "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"},
        "option": {"option"}}
SCOPES = frozenset("table ul ol dl div article section aside main nav body html".split())
# tokens of class, id and role by what they speak for
TOKENS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc tabs pagination pager skip",
    "head": "header masthead topbar top branding logo sitename siteheader",
    "foot": "footer foot bottom copyright legal colophon contentinfo imprint",
    "side": "sidebar side aside widget widgets related recommended recommendations more trending popular complementary rail teaser teasers",
    "notice": "notice notices cookie cookies consent gdpr alert banner popup modal overlay message disclaimer warning subscribe paywall",
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted commercial",
    "form": "form search login signup newsletter register contact poll survey",
    "comment": "comment comments commentlist discussion disqus replies reply responses respond reviews",
    "share": "share sharing social follow tags meta byline toolbar buttons",
    "content": "article content main post entry story text body copy maincontent prose page",
}
GROUP = {w: i for i, ws in enumerate(TOKENS.values()) for w in ws.split()}
TAGS = ("nav", "header", "footer", "aside", "form", "article", "main", "section", "div", "p", "heading", "list", "li", "table", "button", "text", "other")

# attributes as HTML reads them: a quote opens a value only directly after '='
_ATTRS = r"(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)?+)*+"


def _token(raw: str) -> re.Pattern:
    return re.compile(r"<!--.*?(?:--!?>|\Z)|<(" + raw + r")(?=[\s/>])" + _ATTRS + r">.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
                      r"|<(/?)([a-zA-Z][^\s/>]*)(" + _ATTRS + r")>|<[!?/][^>]*>|([^<]+|<)", re.S | re.I)


_TOKEN, _FOREIGN = _token("|".join(RAW)), _token(r"(?!)")  # svg has no raw text
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_SPLIT = re.compile(r"[^a-z]+")


def _tokens(source: str) -> list[re.Match]:
    """The tokens outside of hidden elements, which end at their own end tag.
    One that has none hides nothing; an svg also ends where a block begins or ends."""
    found, edge, inside, names, pos = [], Counter(), [], Counter(), 0

    def end(k):  # of the open element k and those in it, before the next token
        if inside[k][0] in HIDDEN:
            edge[inside[k][1]] += 1
            edge[len(found)] -= 1
        names.subtract(n for n, _ in inside[k:])
        del inside[k:]
    while pos < len(source):
        foreign = bool(inside) and inside[-1][0] == "svg"
        m = (_FOREIGN if foreign else _TOKEN).match(source, pos)
        pos, tag = m.end(), (m.group(3) or "").lower()
        if foreign and tag in BLOCKS:
            while inside and inside[-1][0] == "svg":
                end(len(inside) - 1)
        if tag == "select" and not m.group(2) and inside and inside[-1][0] == "select":
            end(len(inside) - 1)
        found.append(m)
        if tag in HIDDEN or tag == "foreignobject" and (foreign or names[tag]):
            if not m.group(2):
                if not ((foreign or tag == "svg") and m.group(4).endswith("/")):
                    inside.append((tag, len(found) - 1))
                    names[tag] += 1
            elif names[tag]:
                end(max(k for k in range(len(inside)) if inside[k][0] == tag) if inside[-1][0] != tag else len(inside) - 1)
    depth = accumulate(edge[i] for i in range(len(found)))
    return [m for m, d in zip(found, depth) if not d]


class Page:
    """Nodes of a page in document order: parent, tag, groups of tokens, text of runs, link characters."""

    def __init__(self, source: str):
        self.parent, self.tag, self.groups, self.text, self.links = [-1], ["html"], [0], [None], [0]
        stack, run, linked, in_link, skip = [0], [], 0, 0, 0

        def end_run():
            nonlocal linked
            t = " ".join("".join(run).split())
            if t:
                self._add(stack[-1], "text", 0, t, min(linked, len(t)))
            run.clear()
            linked = 0
        for m in _tokens(source):
            raw, close, tag, attrs, text = m.group(1), m.group(2), m.group(3), m.group(4), m.group(5)
            if text is not None:
                if not skip:
                    t = html.unescape(text)
                    run.append(t)
                    if in_link:
                        linked += len(t)
                continue
            if tag is None:
                continue
            tag = tag.lower()
            if tag == "head":
                skip = 0 if close else 1
                run.clear()
            elif tag == "body":
                skip = 0
                if not close and attrs:
                    self.groups[0] |= _groups(attrs)
            elif tag == "a":
                in_link = 0 if close else 1
            elif tag in ("br", "hr"):
                end_run()
            elif tag in BLOCKS and tag != "html":
                if skip and not close:
                    skip = 0  # a page without an end of its head
                end_run()
                if close:
                    for k in range(len(stack) - 1, 0, -1):
                        if self.tag[stack[k]] == tag:
                            del stack[k:]
                            break
                        if self.tag[stack[k]] in SCOPES and tag in ENDS:
                            break
                else:
                    in_link = 0
                    for k in range(len(stack) - 1, 0, -1):
                        if tag in ENDS.get(self.tag[stack[k]], ()):
                            del stack[k:]
                            break
                        if self.tag[stack[k]] in SCOPES:
                            break
                    if tag not in VOID and not (attrs or "").endswith("/"):
                        stack.append(self._add(stack[-1], tag, _groups(attrs) if attrs else 0, None, 0))
        end_run()

    def _add(self, parent, tag, groups, text, links):
        self.parent.append(parent), self.tag.append(tag), self.groups.append(groups), self.text.append(text), self.links.append(links)
        return len(self.parent) - 1

    def features(self) -> np.ndarray:
        n, p = len(self.parent), self.parent
        chars, links = [len(t) if t else 0 for t in self.text], list(self.links)
        own = list(chars)
        stops = [sum(map(t.count, ".,;!?")) if t else 0 for t in self.text]
        tags, runs, paras = [1] * n, [1 if t else 0 for t in self.text], [1 if t == "p" else 0 for t in self.tag]
        kids, heads = [0] * n, [1 if t in HEADINGS else 0 for t in self.tag]
        place, depth, above, before = [0] * n, [0] * n, [0] * n, [0] * n
        at = 0
        for v in range(n):
            before[v] = at
            at += own[v]
            if v:
                u = p[v]
                place[v], depth[v], above[v] = kids[u], depth[u] + 1, above[u] | self.groups[u] | _TAG_BIT.get(self.tag[u], 0)
                kids[u] += 1
        for v in range(n - 1, 0, -1):
            u = p[v]
            chars[u] += chars[v]
            links[u] += links[v]
            stops[u] += stops[v]
            tags[u] += tags[v]
            runs[u] += runs[v]
            paras[u] += paras[v]
            heads[u] += heads[v]
        total = max(chars[0], 1)
        par = [0, *p[1:]]
        f = np.zeros((n, 14 + len(TAGS) + 2 * len(TOKENS) + len(_TAG_BIT) + 4))
        c, l_ = np.array(chars, float), np.array(links, float)
        up = c[par]
        f[:, 0] = np.log1p(c)
        f[:, 1] = l_ / np.maximum(c, 1)
        f[:, 2] = np.array(tags) / np.maximum(c, 1)
        f[:, 3] = np.array(stops) / np.maximum(c, 1)
        f[:, 4] = c / total
        f[:, 5] = c / np.maximum(up, 1)
        f[:, 6] = depth
        f[:, 7] = np.array(place) / np.maximum(np.array(kids)[par], 1)
        f[:, 8] = np.array(kids)[par]
        f[:, 9] = np.array(kids)
        f[:, 10] = np.array(before) / total
        f[:, 11] = c / np.maximum(np.array(runs), 1)
        f[:, 12] = np.log1p(paras)
        f[:, 13] = np.log1p(heads)
        k = 14
        f[np.arange(n), k + np.array([_TAG.get(t, len(TAGS) - 1) for t in self.tag])] = 1
        k += len(TAGS)
        own_g, up_g = np.array(self.groups), np.array(above)
        for i in range(len(TOKENS)):
            f[:, k + 2 * i] = (own_g >> i) & 1
            f[:, k + 2 * i + 1] = (up_g >> i) & 1
        k += 2 * len(TOKENS)
        for i, bit in enumerate(_TAG_BIT.values()):
            f[:, k + i] = (up_g & bit) > 0
        k += len(_TAG_BIT)
        mine = own_g | np.array([_TAG_BIT.get(t, 0) for t in self.tag])
        for i, (g, bits) in enumerate(((mine, _APART), (mine, _MAIN), (up_g, _APART), (up_g, _MAIN))):
            f[:, k + i] = (g & bits) > 0
        return f

    def decode(self, reject: np.ndarray) -> str:
        """Blocks kept under the likeliest consistent choice."""
        r = np.clip(reject, 1e-6, 1 - 1e-6)
        keep, drop = (-np.log(1 - r)).tolist(), (-np.log(r)).tolist()
        p = self.parent
        for v in range(len(p) - 1, 0, -1):
            keep[p[v]] += min(keep[v], drop[v])
            drop[p[v]] += drop[v]
        kept, out = [True] * len(p), []  # the root is the whole page: rejecting it would be its children's choice
        for v in range(1, len(p)):
            kept[v] = kept[p[v]] and keep[v] <= drop[v]
            if kept[v] and self.text[v]:
                out.append(self.text[v])
        return "\n".join(out)


_TAG = {t: i for i, t in enumerate(TAGS)} | {h: TAGS.index("heading") for h in HEADINGS} | {x: TAGS.index("list") for x in ("ul", "ol", "dl", "menu")}
_TAG_BIT = {t: 1 << (len(TOKENS) + i) for i, t in enumerate(("nav", "header", "footer", "aside", "form", "article", "main", "button"))}
_MAIN = 1 << list(TOKENS).index("content") | _TAG_BIT["article"] | _TAG_BIT["main"]
_APART = ((1 << len(TOKENS)) - 1 | sum(_TAG_BIT.values())) & ~_MAIN


def _groups(attrs: str) -> int:
    out = 0
    for _, value in _ATTR.findall(attrs):
        for w in _SPLIT.split(value.lower()):
            if w in GROUP:
                out |= 1 << GROUP[w]
    return out


# --- training pages -----------------------------------------------------------

def _sentence(rng, words, low, high):
    w = [rng.choice(words) for _ in range(rng.randint(low, high))]
    return html.escape(" ".join(w), quote=False)


def _wrap(rng, tag, group, body):
    """An element, marked by its tag or by a token of the group."""
    if tag and rng.random() < 0.6:
        attr = f' class="{rng.choice(TOKENS[group].split())}"' if rng.random() < 0.3 else ""
        return f"<{tag}{attr}>{body}</{tag}>"
    token = rng.choice(TOKENS[group].split())
    if rng.random() < 0.4:
        token = rng.choice((f"site-{token}", f"{token}-box", f"{token} x{rng.randint(1, 9)}", f"{token}_area"))
    name = "id" if rng.random() < 0.25 else "class"
    tag = rng.choice(("div", "div", "div", "section"))
    return f'<{tag} {name}="{token}">{body}</{tag}>'


def _link_list(rng, words):
    items = "".join(f'<li><a href="/x">{_sentence(rng, words, 1, 4)}</a></li>' for _ in range(rng.randint(2, 9)))
    return f"<ul>{items}</ul>"


def _paragraphs(rng, words, most):
    return "".join(f"<p>{_sentence(rng, words, 3, 60)}.</p>" for _ in range(rng.randint(1, most)))


def _boilerplate(rng, words):
    kind = rng.choice(("menu", "head", "foot", "side", "notice", "advert", "form", "comment", "share"))
    if kind == "menu":
        return _wrap(rng, "nav", kind, _link_list(rng, words))
    if kind == "head":
        return _wrap(rng, "header", kind, f"<h2>{_sentence(rng, words, 1, 5)}</h2>" + (_link_list(rng, words) if rng.random() < 0.4 else ""))
    if kind == "foot":
        return _wrap(rng, "footer", kind, f"&copy; {_sentence(rng, words, 2, 25)}" + (_link_list(rng, words) if rng.random() < 0.3 else ""))
    if kind == "side":
        return _wrap(rng, "aside", kind, f"<h3>{_sentence(rng, words, 1, 4)}</h3>" + (_link_list(rng, words) if rng.random() < 0.6 else _paragraphs(rng, words, 3)))
    if kind == "notice":
        return _wrap(rng, None, kind, rng.choice(("{}", "<p>{}</p>")).format(_sentence(rng, words, 4, 40)) + ("<button>OK</button>" if rng.random() < 0.5 else ""))
    if kind == "advert":
        return _wrap(rng, None, kind, rng.choice(("{}", "<p>{}</p>", '<a href="/x">{}</a>')).format(_sentence(rng, words, 2, 40)))
    if kind == "form":
        return _wrap(rng, "form", kind, f"<label>{_sentence(rng, words, 1, 4)}</label><input><p>{_sentence(rng, words, 2, 12)}</p><button>{_sentence(rng, words, 1, 2)}</button>")
    if kind == "comment":
        body = "".join(f'<div class="comment"><b>{_sentence(rng, words, 1, 2)}</b><p>{_sentence(rng, words, 2, 50)}</p></div>' for _ in range(rng.randint(1, 6)))
        return _wrap(rng, None, kind, (f"<h3>{_sentence(rng, words, 1, 2)}</h3>" if rng.random() < 0.5 else "") + body)
    return _wrap(rng, None, kind, _link_list(rng, words) if rng.random() < 0.7 else f"<p>{_sentence(rng, words, 2, 8)}</p>")


MAIN = "\x02"  # starts every run of main text in a training page


def training_page(words: list[str], seed: int) -> str:
    """A page of known layout: runs of main text start with MAIN."""
    rng = random.Random(seed)
    body = [f"<h1>{MAIN}{_sentence(rng, words, 2, 12)}</h1>"] if rng.random() < 0.85 else []
    for _ in range(rng.choice((1, 1, 2, 3, 5, 8, 15, 30))):
        x = rng.random()
        s = f"{MAIN}{_sentence(rng, words, 1, 90)}."
        if x < 0.7:
            body.append(f"<p>{s}</p>" if rng.random() < 0.8 else f"<p><b>{s}<br>")
        elif x < 0.78:
            body.append("<ul>" + "".join(f"<li>{MAIN}{_sentence(rng, words, 1, 25)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
        elif x < 0.84:
            body.append(f"<h2>{MAIN}{_sentence(rng, words, 1, 8)}</h2><p>{s}</p>")
        elif x < 0.88:
            body.append(f"<blockquote><p>{s}</p></blockquote>")
        elif x < 0.91:
            body.append("<table>" + "".join(f"<tr><td>{MAIN}{_sentence(rng, words, 1, 4)}</td><td>{MAIN}{_sentence(rng, words, 1, 4)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>")
        elif x < 0.94:
            body.append(f"{s}<br>{MAIN}{_sentence(rng, words, 3, 30)}")
        else:
            body.append(f'<p>{s} <a href="/y">{_sentence(rng, words, 1, 3)}</a> {_sentence(rng, words, 1, 20)}</p>')
    for _ in range(rng.choice((0, 0, 0, 1, 2))):
        body.insert(rng.randint(0, len(body)), _boilerplate(rng, words))
    article = "".join(body)
    style = rng.random()
    if style < 0.45:
        article = f"<article>{article}</article>"
    elif style < 0.6:
        article = f"<main>{article}</main>"
    elif style < 0.85:
        article = f'<div {rng.choice(("class", "id"))}="{rng.choice(TOKENS["content"].split())}">{article}</div>'
    if rng.random() < 0.25:
        article = f'<main>{article}</main>' if rng.random() < 0.5 else f'<div class="wrapper">{article}</div>'
    before = "".join(_boilerplate(rng, words) for _ in range(rng.randint(0, 4)))
    after = "".join(_boilerplate(rng, words) for _ in range(rng.randint(0, 4)))
    return f"<!DOCTYPE html><html><head><title>x</title></head><body>{before}{article}{after}</body></html>"


def _train_rows(batches):
    for b in batches:
        xs, ys = [], []
        for source in b.column(0).to_pylist():
            page = Page(source or "")
            words = " ".join(t for t in page.text if t).split()[:3000] or ["a", "b"]
            for k in range(VARIANTS):
                made = Page(training_page(words, zlib.crc32((source or "").encode()) * VARIANTS + k))
                main = [1 if t and t.startswith(MAIN) else 0 for t in made.text]
                made.text = [t.replace(MAIN, "") if t else t for t in made.text]
                for v in range(len(main) - 1, 0, -1):
                    main[made.parent[v]] |= main[v]
                xs.append(made.features()[1:]), ys.append(1.0 - np.array(main[1:], float))
        if xs:
            x, y = np.concatenate(xs), np.concatenate(ys)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([rows, pa.array(y)], ["x", "label"])


class Trees:
    """The fitted ensemble as arrays: feature, threshold, children and value of every tree node."""

    def __init__(self, model):
        self.trees = [(_tree(t.rootNode()), w) for t, w in zip(model._java_obj.trees(), model.treeWeights)]

    def reject(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for (feature, limit, left, right, value), w in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                inner = np.flatnonzero(feature[at] >= 0)
                if not len(inner):
                    break
                n = at[inner]
                at[inner] = np.where(x[inner, feature[n]] <= limit[n], left[n], right[n])
            total += w * value[at]
        return 1 / (1 + np.exp(-2 * total))  # the loss is 2 log(1 + exp(-2 y F))


def _tree(root):
    rows = []

    def walk(node):
        at = len(rows)
        rows.append([-1, 0.0, 0, 0, node.prediction()])
        if node.subtreeDepth() > 0:
            split = node.split()
            rows[at][:2] = [split.featureIndex(), split.threshold()]
            rows[at][2] = walk(node.leftChild())
            rows[at][3] = walk(node.rightChild())
        return at
    walk(root)
    return tuple(np.array(c, t) for c, t in zip(zip(*rows), (int, float, int, int, float)))


def train(pages: DataFrame, sample: int = TRAIN_PAGES) -> Trees:
    """Trees fitted on training pages made from the words of about ``sample`` pages."""
    ready(pages)
    some = sampled(pages.select("html"), "html", sample).filter("length(html) > 0")
    rows = some.mapInArrow(_train_rows, "x array<double>, label double")
    rows = cut(rows.select(array_to_vector("x").alias("features"), "label").repartition(6))
    if rows.isEmpty():
        seed = pages.sparkSession.createDataFrame([("a b c d e f",)], "html string")
        rows = cut(seed.mapInArrow(_train_rows, "x array<double>, label double").select(array_to_vector("x").alias("features"), "label"))
    fitted = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.4, maxBins=32, seed=1, cacheNodeIds=False).fit(rows)
    return Trees(fitted)


def _extractor(sent, keep: list[str], names: list[str]):
    def run(batches):
        trees = sent.value
        for b in batches:
            source = b.column(b.schema.get_field_index("html"))
            a, size = 0, 0
            lengths = [len(x) if x else 0 for x in source.to_pylist()]
            for k in range(b.num_rows):
                size += lengths[k]
                if size < SLICE_CHARS and k + 1 < b.num_rows:
                    continue
                rows, a, size = b.slice(a, k + 1 - a), k + 1, 0
                pages = [Page(x or "") for x in rows.column(rows.schema.get_field_index("html")).to_pylist()]
                x = np.concatenate([p.features() for p in pages])
                r = trees.reject(x)
                end = np.cumsum([len(p.parent) for p in pages])
                texts = [p.decode(r[e - len(p.parent): e]) for p, e in zip(pages, end)]
                yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index(c)) for c in keep] + [pa.array(texts, pa.string())], names)
    return run


def extract_text(pages: DataFrame, trees: Trees | None = None, columns: list[str] | None = None, text: str = "text") -> DataFrame:
    """``columns`` of every row of ``pages(html)`` and its main ``text``.

    Character references are decoded, white space inside a block becomes one
    space, blocks are joined by a newline in page order.  A null, empty or
    markup-only page has the empty text.  The whole page is read, whatever its
    length.  Repeated rows are answered each; an empty table gives no rows.
    A column of ``pages`` called like the new one can't be kept.
    """
    spark = ready(pages)
    trees = trees or train(pages)
    columns = ["page_id", "url"] if columns is None else [c for c in columns if c != text]
    wide = pages.select(*dict.fromkeys([*columns, "html"]))
    schema = T.StructType([wide.schema[c] for c in columns] + [T.StructField(text, T.StringType())])
    return wide.mapInArrow(_extractor(spark.sparkContext.broadcast(trees), columns, [f.name for f in schema]), schema)
