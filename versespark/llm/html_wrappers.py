"""Main text of web pages by wrappers inferred for each host.

A wrapper is a union-free regular expression over the tokens of a host's pages: tags in order, text slots, optional
groups and repeated groups. A page's own expression folds neighbouring tags of one kind into a repeated group. Two
expressions are aligned level by level: what both have is matched in order, a mismatch becomes an optional group, kinds
that meet again a repeated one, and a text slot keeps its text as a constant as long as all pages agree on it, else it
becomes a data slot.

Alignment is associative enough to be a reduction: each task aligns the pages of a host that it reads, then partial
wrappers are aligned in two rounds, so a host with very many pages costs no task more than others. Wrappers are joined
to the pages by host; each page is matched against its wrapper, and the text of the wrapper's content slots is what is
kept. Content lies in the article element, or else in main, or else in an element named like content, or else in the body.
Where that element differs between pages, its data slots decide: in the first three, a block of text all of which is constant
on every page that has the element is template and dropped (a constant beside data in one block is part of its sentence),
unless it stands in an element of running text (heading, paragraph, quotation, list, table); in the body, each constant slot
is. An element that is the same on all pages tells nothing about its template and is kept whole.
So is a constant block among others of its kind (a paragraph between paragraphs), which a repeated group can't tell apart.
Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are never content.

Defined results: a null or empty html has the text ""; a null url is a host of its own; unclosed and stray tags are
closed or skipped; a page cut off within a tag ends before it; repeated rows are extracted each; other columns pass
through, but for a column of the result's name, which is replaced. Elements nested deeper than DEPTH become siblings, as
in browsers, but stay what they are in: noise in noise, content in content. No text is lost by it.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, staged
from .url_filter import url_parts

#: Wrappers may be broadcast up to so many hosts and characters.
BROADCAST_HOSTS, BROADCAST_CHARS = 100_000, 32 << 20
#: Rounds of alignment: partial wrappers of a host meet in so many groups first.
SALTS = 64
#: Levels of a page's tree, and the calls of the interpreter that alignment takes for each.
DEPTH, CALLS = 400, 8

# Tags of HTML by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template noframes".split())
SKIPPED = frozenset("head title script style noscript template iframe nav header footer aside form button select option datalist input textarea svg canvas object embed audio video menu dialog".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "summary"}
#: Opening one of these closes an open one of those, up to the container named last.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
}
#: Words of class, id and role that name what isn't content, and what is.
NOISE = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs header masthead footer comment comments disqus reply replies respond cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login share sharing social related recommended widget toolbar pagination pager contentinfo complementary search dialog alert".split())
CONTENT = frozenset("content article post entry story".split())
#: Elements of running text. What all pages of a host say in one may be a label of what follows, or a quotation: it stays.
RUNNING = frozenset("h1 h2 h3 h4 h5 h6 p blockquote q pre figure figcaption table ul ol dl li dt dd".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?P<close>[a-zA-Z][^\s/>]*)[^>]*(?P<closed>>|\Z)|<(?P<open>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?P<opened>>|\Z)", re.S)
ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
BLANKS = re.compile(r"\s+")


def label_of(tag: str, attrs: str) -> str:
    """What tells kinds of a tag apart: its name, and class, id and role without digits."""
    if "=" not in attrs:
        return tag
    named = [f"{m[1].lower()}={re.sub(r'[0-9]+', '#', ' '.join(sorted((m[2] or m[3] or m[4] or '').split())))}" for m in ATTR.finditer(attrs)]
    return " ".join([tag, *sorted(named)])


def parse(text: str) -> list:
    """The page as a tree: a node is [label, children], a text is a string; character references are decoded."""
    root: list = ["#root", []]
    stack = [("#root", root)]
    at, n = 0, len(text)

    def add(piece: str) -> None:
        if piece:
            stack[-1][1][1].append(entities.unescape(piece))

    def close(tags: set | frozenset, until: set) -> None:
        """Close the innermost open tag of `tags`, and what is open in it, if it lies within `until`."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                del stack[k:]
                return
            if stack[k][0] in until:
                return

    while at < n:
        lt = text.find("<", at)
        if lt < 0:
            add(text[at:])
            break
        m = TOKEN.match(text, lt)
        if not m:  # a bare "<"
            add(text[at : lt + 1])
            at = lt + 1
            continue
        add(text[at:lt])
        at = m.end()
        if m["cdata"] is not None:
            add(m["cdata"])
        elif m["close"]:
            if m["closed"]:
                tag = m["close"].lower()
                if tag == "p" or tag not in BLOCKS:
                    close({tag}, {"article", "section", "main", "div", "td", "body"} - {tag})
                else:
                    close({tag}, set())
        elif m["open"] and m["opened"]:
            tag, attrs = m["open"].lower(), m["attrs"]
            if tag in CLOSES:
                for _ in range(3):
                    close(*CLOSES[tag])
            if tag in ENDS_P:
                close({"p"}, {"article", "section", "main", "div", "td", "th", "li", "body", "table", "blockquote", "button"})
            node = [label_of(tag, attrs), []]
            if len(stack) > DEPTH:
                within = stack[-1][1][0]
                if len(stack) > DEPTH + 1 and (is_noise(within) or may_hold_content(within) and not is_noise(node[0])):
                    node[0] = within
                stack[DEPTH - 1][1][1].append(node)
            else:
                stack[-1][1][1].append(node)
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?|\Z", re.I).search(text, at)
                if tag not in SKIPPED:
                    node[1].append(text[at : end.start()])
                at = end.end()
            elif tag not in VOID and not attrs.endswith("/"):
                stack.append((tag, node))
    return root


# An item of an expression is [label, optional, repeated, constant, items]; a text slot has the label "#". A constant is
# the text that all pages have there (a long one as its opening and a hash of the whole), None where they differ; of an
# element that may hold the content, a hash of its text.


def own(node: list) -> list:
    """The expression of one page's node: its items, with neighbours of one kind folded into repeated groups."""
    return _own(node)[0]


def _own(node: list) -> tuple[list, str]:
    """The node's expression, and a hash of its text without noise ("" if it has none)."""
    items: list = []
    said: list[str] = []
    for child in node[1]:
        if isinstance(child, str):
            if child.isspace() or not child:
                continue
            words = BLANKS.sub(" ", child).strip()
            said.append(words)
            new = ["#", False, False, words if len(words) <= 64 else f"{words[:64]}… {_digest(words)}", []]
        else:
            sub, inner = _own(child)
            new = [child[0], False, False, inner if may_hold_content(child[0]) else None, sub]
            if inner and not is_noise(child[0]):
                said.append(inner)
        if items and items[-1][0] == new[0]:
            items[-1] = merged(items[-1], new, True)
        else:
            items.append(new)
    return items, _digest("\0".join(said)) if said else ""


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def merged(a: list, b: list, repeated: bool = False) -> list:
    return [a[0], a[1] or b[1], a[2] or b[2] or repeated, a[3] if a[3] == b[3] else None, aligned(a[4], b[4])]


def matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence of two lists of labels, as pairs of places.

    Row by row, a number has a bit for each place of `a` whose suffix gains nothing by it, so a row takes a few operations
    on long numbers, and memory is a bit for each pair of places."""
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    out = [(i, i) for i in range(lead)]
    x, y = a[lead:], b[lead:]
    if not x or not y:
        return out
    n, full = len(x), (1 << len(x)) - 1
    places: dict[str, int] = {}
    for i, label in enumerate(x):
        places[label] = places.get(label, 0) | 1 << (n - 1 - i)
    rows = [full] * (len(y) + 1)
    for j in range(len(y) - 1, -1, -1):
        v = rows[j + 1]
        hit = v & places.get(y[j], 0)
        rows[j] = ((v + hit) | (v - hit)) & full
    i = j = 0
    while i < n and j < len(y):
        if x[i] == y[j]:
            out.append((lead + i, lead + j))
            i, j = i + 1, j + 1
        elif rows[j] >> (n - 1 - i) & 1:  # the suffix from i on is no better than the one behind it
            i += 1
        else:
            j += 1
    return out


def aligned(a: list, b: list) -> list:
    """Two lists of items as one: matches are merged, mismatches become optional, and neighbours of one kind repeated."""
    out: list = []

    def put(item: list) -> None:
        if out and out[-1][0] == item[0]:
            out[-1] = merged(out[-1], item, True)
        else:
            out.append(item)

    i = j = 0
    for p, q in [*matches([x[0] for x in a], [x[0] for x in b]), (len(a), len(b))]:
        for item in [*a[i:p], *b[j:q]]:
            put([item[0], True, *item[2:]])
        if p < len(a):
            put(merged(a[p], b[q]))
        i, j = p + 1, q + 1
    return out


def expression(items: list) -> str:
    """A wrapper as a regular expression, to be read by people."""
    out = []
    for label, optional, repeated, constant, sub in items:
        if label == "#":
            body = constant if constant is not None else "#text"
        else:
            body = f"<{label}>{expression(sub)}</{label.split(' ')[0]}>"
        out.append(f"({body}){'*' if optional and repeated else '+' if repeated else '?'}" if optional or repeated else body)
    return "".join(out)


@lru_cache(10_000)
def is_noise(label: str) -> bool:
    tag, _, named = label.partition(" ")
    if tag in SKIPPED:
        return True
    if not named or tag in ("html", "body", "article", "main"):
        return False
    words = {w.lower() for w in WORD.findall(re.sub(r"(?:^| )(?:class|id|role)=", " ", named))}
    # the header of an article, unlike that of a page, holds its title
    return bool(words & NOISE - {"header"}) or ("header" in words and not words & CONTENT)


def is_content(label: str, rule: str) -> bool:
    tag, _, named = label.partition(" ")
    if rule == "main":
        return tag == "main" or "role=main" in named
    if rule == "named":
        return bool({w.lower() for w in WORD.findall(re.sub(r"(?:^| )(?:class|id|role)=", " ", named))} & CONTENT) and tag in ("div", "section", "td")
    return tag == rule


@lru_cache(10_000)
def may_hold_content(label: str) -> bool:
    return any(is_content(label, rule) for rule in ("article", "main", "named"))


class Wrapper:
    """A host's expression, ready to be matched, and how many different pages it was seen to stand for at least: 1 or 2."""

    def __init__(self, items: list, pages: int):
        self.items, self.pages = items, pages

    def text(self, page: str | None) -> str:
        root = parse(page or "")
        for rule in ("article", "main", "named", "body"):
            blocks: list[tuple[str, bool]] = []
            self._walk(root, self.items, rule, rule == "body", rule == "body" and self.pages > 1, blocks)
            out: list[str] = []
            line: list[str] = []
            data = False
            for piece, fixed in [*blocks, ("\0", False)]:
                if piece != "\0":
                    line.append(piece)
                    data = data or not fixed and not piece.isspace()
                    continue
                if data:
                    out.append(BLANKS.sub(" ", "".join(line)).strip())
                line, data = [], False
            if out:
                return "\n".join(out)
        return ""

    def _walk(self, node: list, items: list, rule: str, inside: bool, always: bool, out: list[tuple[str, bool]]) -> None:
        """Match the node's children with the items in order, and put down the text of slots of the content, and whether it is
        fixed; an edge of a block is "\\0". `always`: the element of content differs between pages and all of its kind have the
        node, so that a constant in it is one of the template."""
        labels: list[str] = []
        for c in node[1]:
            kind = "#" if isinstance(c, str) else c[0]
            if isinstance(c, str) and (c.isspace() or not c):
                continue
            if not labels or labels[-1] != kind:
                labels.append(kind)
        found = {}
        if inside or labels:
            found = dict(matches(labels, [x[0] for x in items]))
        k = -1
        last = None
        for c in node[1]:
            kind = "#" if isinstance(c, str) else c[0]
            if isinstance(c, str) and (c.isspace() or not c):
                if inside:
                    out.append((" ", False))
                continue
            if kind != last:
                k, last = k + 1, kind
            item = items[found[k]] if k in found else None
            if isinstance(c, str):
                # a text that all pages share belongs to the template
                fixed = always and item is not None and not item[1] and item[3] is not None
                if inside and not (fixed and rule == "body"):
                    out.append((c.replace("\0", " "), fixed))
                continue
            if is_noise(kind):
                if inside:
                    out.append(("\0", False))
                continue
            tag = kind.split(" ")[0]
            within = inside or is_content(kind, rule)
            edge = "\0" if tag in BLOCKS else " " if tag == "br" else ""
            if within and edge:
                out.append((edge, False))
            if inside or not within:
                shared = always and item is not None and not item[1] and (rule == "body" or tag not in RUNNING)
            else:  # an element of content starts; its constant is None if it differs
                shared = item is not None and item[3] is None
            self._walk(c, item[4] if item is not None else [], rule, within, shared, out)
            if within and edge:
                out.append((edge, False))


def _room() -> None:
    """Room for trees of DEPTH levels in a worker."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1000 + CALLS * DEPTH))


def _aligned_json(wrappers: list[str]) -> str:
    first, *rest = dict.fromkeys(wrappers)
    items = json.loads(first)
    for w in rest:
        items = aligned(items, json.loads(w))
    return json.dumps(items, ensure_ascii=False, separators=(",", ":"))


def infer_wrappers(pages: DataFrame, host: Column, html: str = "html") -> DataFrame:
    """host, wrapper (items as JSON), and the hash of the text that all pages of the host have (only), "" if they differ. Pages
    without a text outside of noise say nothing and don't count."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _room()
        known: dict[str, list] = {}
        for b in batches:
            for h, t in zip(b["host"], b["html"], strict=True):
                items, said = _own(parse(t or ""))
                if not said:
                    continue
                if h in known:
                    known[h][0] = aligned(known[h][0], items)
                    if said != known[h][1]:
                        known[h][1] = ""
                else:
                    known[h] = [items, said]
        yield pd.DataFrame([(h, json.dumps(w, ensure_ascii=False, separators=(",", ":")), only) for h, (w, only) in known.items()], columns=["host", "wrapper", "only"])

    def join(part: pd.DataFrame) -> pd.DataFrame:
        _room()
        part = part.sort_values("wrapper")
        only = part["only"].iloc[0] if part["only"].nunique() == 1 else ""
        return pd.DataFrame([(part["host"].iloc[0], _aligned_json(part["wrapper"].tolist()), only)], columns=["host", "wrapper", "only"])

    bounded_batches(pages.sparkSession, 200)
    schema = "host string, wrapper string, only string"
    w = pages.select(host.alias("host"), F.col(html).alias("html")).mapInPandas(partial, schema)
    w = staged(w.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))), "partial-wrappers")
    w = w.groupBy("host", "salt").applyInPandas(lambda p: join(p), schema)
    return w.groupBy("host").applyInPandas(lambda p: join(p), schema)


def extract(pages: DataFrame, url: str = "url", html: str = "html", text: str = "text") -> DataFrame:
    """`pages` with the main text."""
    host_of = url_parts(F.col(url))[0]
    wrappers = staged(infer_wrappers(pages, host_of, html), "wrappers")
    size = wrappers.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("wrapper")), F.lit(0)).alias("chars")).first()
    host, w, n = fresh(pages, "wrapper_host", "wrapper_items", "wrapper_pages")
    wrappers = wrappers.select(F.col("host").alias(host), F.col("wrapper").alias(w), F.when(F.col("only") == "", 2).otherwise(1).alias(n))
    if size["n"] <= BROADCAST_HOSTS and size["chars"] <= BROADCAST_CHARS:
        wrappers = F.broadcast(wrappers)

    @F.pandas_udf("string")
    def apply(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        _room()
        ready: dict[str, Wrapper] = {}
        for t, items, count in parts:
            out = []
            for page, i, c in zip(t, items, count, strict=True):
                if i not in ready:
                    if len(ready) > 2000:
                        ready.clear()
                    ready[i] = Wrapper(json.loads(i or "[]"), c)
                out.append(ready[i].text(page))
            yield pd.Series(out, dtype=object)

    d = pages.withColumn(host, host_of).join(wrappers, host, "left")
    return d.withColumn(text, apply(F.col(html), F.col(w), F.coalesce(n, F.lit(0)))).drop(host, w, n)
