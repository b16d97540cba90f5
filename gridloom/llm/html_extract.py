"""HTML main-text extraction with a site style tree.

The pages of a host are merged into one tree of style nodes: a node is a path of elements, each with its class and id
words, from the body; it is known by a number that follows from its parent's. For every node the pages that have it form two distributions, of presentations (the sequence of
child elements) and of contents (the text below). Each one's entropy, over the logarithm of the number of pages, tells
how far pages differ there; the larger one is the node's importance. A branch that is (nearly) the same on all pages of
a host says nothing about any one page, and is removed from each of them.

Hosts with few pages, and templates filled with ever new text, have no low entropies. So a node's presentation counts
too: elements and class names that stand for menus, headers, footers, sidebars, notices, adverts, forms and comments are
of no importance anywhere, and where a page marks its article, nothing outside of it is. A name counts as a whole: each of
its parts is such a word, or says where or in what it stands (site-footer, comment-list). Names with other parts (no-sidebar,
comments-open, share-prices) say nothing, nor do ids of headings, and of sections within an article only comments do. No
name removes an article or main element, or what the page's article or main element lies in. Names are evidence, and the tree
has the last word on them: a branch that holds most of the text of its host's pages is kept whatever its name (comments are
not: they are never the article), if its entropy does not speak against it.

Statistics are counted by (host, node, hash) with partial aggregation, so a host with a third of all pages is no hot
group; only the unimportant nodes of each host meet the pages again.

Defined results: a null, empty or textless html gives an empty text; a null or odd url is a host of its own; pages with
equal ids are kept apart; unclosed and stray tags are repaired as browsers do for paragraphs, lists and tables; a tag that the
page's end cuts off is markup and no text; a quote that is never closed ends with its word; pages of any length are read in
linear time; elements nested more than 512 deep stand beside each other; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridloom.session import ship, stored

#: A node is unimportant if the pages of its host that have it are so many at least, and its importance is below the bound.
LEAST_PAGES, LEAST_IMPORTANCE = 5, 0.2
#: What is named like an advert or the like is believed to be one, unless it holds more than this share of the text of its host's pages.
MOST_SHARE = 0.5

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg canvas object annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("head nav footer aside form button select option input menu dialog script style noscript template textarea title iframe svg canvas object".split())
DROPPED_WORDS = frozenset("ad ads advert advertisement advertising adverts adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login menu nav navbar navigation newsletter notice pager pagination popup promo promoted related replies reply search share sharing sidebar signup social sponsor sponsored subscribe widget".split())
#: Parts of names that say where or in what a thing stands: before the dropped words, and after them; and names with other parts.
BEFORE = frozenset("site page post entry article blog main primary secondary global top bottom header mobile desktop sticky fixed inline js".split())
AFTER = frozenset("area bar block body bottom box btn button buttons column container desktop field footer form group header heading icon icons inner input item items label link links list mobile outer panel placeholder row section slot title top unit wrap wrapper zone".split())
DROPPED_NAMES = frozenset("related-posts related-articles related-stories related-content promoted-content sponsored-content".split())
COMMENTS = frozenset("comment comments disqus replies reply".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog".split())
#: An element ends open ones of these kinds, up to the given bound.
ENDS = {"p": ({"p"}, {"td", "th", "article", "section", "div", "li", "blockquote"}), "li": ({"li", "p"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}), "tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

#: Elements nested deeper than this stand beside each other instead, as in browsers.
DEEPEST = 512
SPECIAL = re.compile(r"<(?=[!?a-zA-Z]|/.)", re.S)
TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
ATTRIBUTE = re.compile(r"[\s/]*+([^\s/>][^\s/>=]*+)?+(\s*+=\s*+)?+")
BARE_VALUE = re.compile(r"[^\s>]*+")
WORD = re.compile(r"[a-z]+")
NAME = re.compile(r"[a-z0-9_-]+")


def dropped_words(name: str) -> set[str]:
    """The words by which a class or id stands for something other than an article; none if it has other parts too."""
    parts = [w for w in WORD.findall(name) if len(w) > 1] if NAME.fullmatch(name) else []
    if name.replace("_", "-") in DROPPED_NAMES:
        return set(parts)
    at = [i for i, w in enumerate(parts) if w in DROPPED_WORDS]
    if not at or not all(w in DROPPED_WORDS or w in BEFORE and i < at[0] or w in AFTER and i > at[0] for i, w in enumerate(parts)):
        return set()
    return {parts[i] for i in at}


@lru_cache(100_000)
def look(tag: str, names: str, ids: str, role: str, hidden: bool) -> tuple[str, bool, bool, bool, bool]:
    """The name of an element in a style path, and whether its kind, its names anywhere, and its names outside of an article
    stand for something other than an article; and whether its names stand for comments."""
    words = sorted({*names.split(), *ids.split()})
    by_class = {w for x in names.split() for w in dropped_words(x)}
    by_id = {w for x in ids.split() for w in dropped_words(x)} if not re.fullmatch("h[1-6]", tag) else set()
    if tag in ("article", "main"):
        by_class, by_id = set(), set()
    return ".".join([tag, *(re.sub(r"\d+", "0", w) for w in words)]), tag in DROPPED or role in DROPPED_ROLES or hidden, bool(by_class or (by_id & COMMENTS if tag == "section" else by_id)), bool(by_class or by_id), bool((by_class | by_id) & COMMENTS)


def seen_as(tag: str, got: dict[str, str]) -> tuple[str, bool, bool, bool, bool]:
    style = got.get("style", "").replace(" ", "").lower()
    return look(tag, got.get("class", "").lower(), got.get("id", "").lower(), got.get("role", "").lower(), "hidden" in got or got.get("aria-hidden", "").lower() == "true" or "display:none" in style)


class Tokens:
    """Text and tags of a page in order, in time linear in its length: nothing is searched for again that was not found once."""

    def __init__(self, page: str):
        self.page, self.missing = page, {}

    def find(self, what: str, at: int) -> int:
        """Where `what` comes next, or -1."""
        if at >= self.missing.get(what, len(self.page) + 1):
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing[what] = at
        return found

    def after_raw(self, tag: str, at: int) -> int:
        """Where the text of a raw element that begins here has ended, or -1."""
        if at >= self.missing.get(f"/{tag}", len(self.page) + 1):
            return -1
        end = re.compile(rf"</{tag}\s*+>|<body\b" if tag == "head" else rf"</{tag}\s*+>", re.I).search(self.page, at)
        if not end:
            self.missing[f"/{tag}"] = at
            return -1
        return end.end() if end[0][1] == "/" else end.start()

    def tag(self, at: int) -> tuple[dict[str, str], bool, int]:
        """Attributes from here on, whether the tag closes itself, and where it has ended (the page's end if it does not)."""
        page, n, got = self.page, len(self.page), {}
        while at < n:
            m = ATTRIBUTE.match(page, at)
            at, name = m.end(), (m[1] or "").lower()
            value = ""
            if m[2]:
                quote = page[at : at + 1]
                end = self.find(quote, at + 1) if quote in ('"', "'") and quote else -1
                if end >= 0:
                    value, at = page[at + 1 : end], end + 1
                else:
                    bare = BARE_VALUE.match(page, at)
                    value, at = bare[0], bare.end()
            if name:
                got.setdefault(name, html.unescape(value) if "&" in value else value)
            if page[at : at + 1] == ">":
                return got, page[at - 1] == "/", at + 1
        return got, False, n


class Node:
    __slots__ = ("tag", "path", "up", "drop", "named", "talk", "inside", "shown", "gone")

    def __init__(self, tag: str, path: int, up: Node | None, drop: bool, inside: bool, named: bool = False, talk: bool = False):
        self.tag, self.path, self.up, self.drop, self.inside, self.named, self.talk, self.shown, self.gone = tag, path, up, drop, inside, named, talk, 0, False


def number(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


@lru_cache(200_000)
def step(path: int, name: str) -> int:
    """The number of the style path that goes on from a path to an element."""
    return number(f"{path}>{name}")


def then(a: int, b: int) -> int:
    """A number for a sequence, from that of its beginning and the next part."""
    return (a * 0x9E3779B97F4A7C15 + b + 1) & 0xFFFFFFFFFFFFFFFF


ROOT = number("body")


def parse(page: str) -> tuple[list[tuple[str, Node]], list[Node]]:
    """Blocks of text in page order with the nodes that they lie in, and all nodes, parents first."""
    root = Node("body", ROOT, None, False, False)
    stack, nodes, blocks, text = [root], [root], [], []
    owner = root  # of the text gathered: where its first words stand
    tokens, end, n = Tokens(page), 0, len(page)
    clear, spared = False, []  # whether an article lies in nothing dropped by its name; what other articles lie in

    def flush():
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                blocks.append((joined, owner))
            text.clear()

    def add(s: str):
        nonlocal owner, blank
        if s:
            if not text or blank and not s.isspace():
                owner, blank = stack[-1], s.isspace()
            text.append(s)

    blank = True
    while end < n:
        m = SPECIAL.search(page, end)
        if not m:
            add(page[end:])
            break
        add(page[end : m.start()])
        at = m.end()
        closing = page[at] == "/"
        name = TAG_NAME.match(page, at + closing)
        if not name:  # a comment or declaration
            mark, skip = ("-->", 1) if page.startswith("!--", at) else (">", 0)
            found = tokens.find(mark, at + skip)
            end = found + len(mark) if found >= 0 else n
            continue
        tag = name[0].lower()
        got, alone, end = tokens.tag(name.end())
        if end == n and page[n - 1] != ">":
            break  # the page ends within a tag
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if any(x.tag in BLOCK or x.drop or x.named for x in stack[i:]):
                        flush()
                    del stack[i:]
                    break
            else:
                if tag in BLOCK:
                    flush()
            continue
        if tag in ("html", "body"):
            flush()
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCK:
            flush()
        ends, bound = ENDS.get(tag, (("p",), ("td", "th", "article", "section", "div", "li", "blockquote")) if tag in BLOCK else ((), ()))
        if ends:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in bound:
                    break
                if stack[i].tag in ends:
                    flush()
                    del stack[i:]
        style, drop, named, named_outside, talk = seen_as(tag, got)
        up = stack[-1]
        inside = up.inside or tag in ("article", "main")
        node = Node(tag, step(up.path, style), up, up.drop or drop or tag == "header" and not inside, inside, named if inside else named_outside, talk)
        if node.drop and not up.drop or node.named:
            flush()
        if inside and not up.inside and not node.drop:
            above = [x for x in stack if x.named]
            if tag == "main":
                for x in above:
                    x.named = False
            clear |= tag == "main" or not above
            spared += above
        up.shown = then(up.shown, node.path)
        if tag in VOID or alone and tag not in BLOCK:
            continue
        if tag in RAW or tag == "head":
            found = tokens.after_raw(tag, end)
            end = found if found >= 0 else n if tag != "head" else end
            if tag == "head" and found < 0:
                stack.append(node)
            continue
        if len(stack) < DEEPEST:
            stack.append(node)
        nodes.append(node)
    flush()
    if not clear:
        for x in spared:
            x.named = False
    return blocks, nodes


def style_nodes(page: str) -> list[tuple[int, int, int, float, bool]]:
    """(node, presentation, content, share of the page's text, is it named like something else) of the style nodes that hold text, each once."""
    blocks, nodes = parse(page)
    shown: dict[int, int] = {}
    named: dict[int, bool] = {}
    for x in nodes:
        shown[x.path] = then(shown.get(x.path, 0), x.shown)
        named[x.path] = named.get(x.path, False) or x.named and not x.talk
    content: dict[int, int] = {}
    length: dict[int, int] = {}
    total = sum(len(t) for t, x in blocks if not x.drop)
    for text, x in blocks:
        value, paths = number(text), set()
        while x is not None:
            if x.path not in paths:
                paths.add(x.path)
                content[x.path] = then(content.get(x.path, 0), value)
                length[x.path] = length.get(x.path, 0) + len(text)
            x = x.up
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    return [(p, signed(shown[p]), signed(v), length[p] / total if total else 0.0, named[p]) for p, v in content.items()]


NOTHING = frozenset()


def main_text(page: str, unimportant: frozenset[int] = NOTHING, spared: frozenset[int] = NOTHING) -> str:
    """The text of the branches that are left: those of no importance by their kind or name go first, then those that the host's tree
    holds unimportant. spared: nodes whose names are not believed."""
    blocks, nodes = parse(page)
    for x in nodes:
        x.gone = x.drop or x.named and x.path not in spared or x.up is not None and x.up.gone
    kept = [x for x in blocks if not x[1].gone]
    if any(x.inside for _, x in kept):
        kept = [x for x in kept if x[1].inside]
    if unimportant:
        for x in nodes[1:]:
            x.gone = x.gone or x.path in unimportant or x.up.gone
        kept = [x for x in kept if not x[1].gone] or kept
    return "\n\n".join(t for t, _ in kept)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = LEAST_PAGES, least_importance: float = LEAST_IMPORTANCE, most_share: float = MOST_SHARE) -> DataFrame:
    """page_id, url, text of every page."""
    ship(pages.sparkSession)
    host = F.coalesce(F.lower(F.regexp_extract(url_col, r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))

    def nodes(batches):
        for b in batches:
            out = [(h, *x) for h, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if page for x in style_nodes(page)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ([],) * 6, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()))], names=["host", "node", "shown", "content", "share", "named"])

    seen = rows.select("host", "html").mapInArrow(nodes, "host string, node long, shown long, content long, share double, named boolean")
    tall = seen.select("host", "node", "share", "named", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("shown").alias("value")), F.struct(F.lit(1).alias("kind"), F.col("content").alias("value")))).alias("x")).select("host", "node", "share", "named", "x.kind", "x.value")
    counts = tall.groupBy("host", "node", "kind", "value").agg(F.count("*").alias("c"), F.sum("share").alias("share"), F.max("named").alias("named"))
    entropy = counts.groupBy("host", "node", "kind").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.ln("c")).alias("s"), F.sum("share").alias("share"), F.max("named").alias("named"))
    h = F.when(F.col("m") >= least_pages, (F.ln("m") - F.col("s") / F.col("m")) / F.ln("m")).otherwise(F.lit(1.0))
    entropy = entropy.select("host", "node", h.alias("h"), (F.col("share") / F.col("m")).alias("share"), "named")
    judged = entropy.groupBy("host", "node").agg(F.max("h").alias("importance"), F.max("share").alias("share"), F.max("named").alias("named"))
    low = F.col("importance") < least_importance
    spare = F.col("named") & (F.col("share") > most_share) & ~low
    judged = judged.where(low | spare).groupBy("host").agg(F.collect_list(F.when(low, F.col("node"))).alias("low"), F.collect_list(F.when(spare, F.col("node"))).alias("spared"))
    judged = stored(judged, "judged")

    def extract(batches):
        for b in batches:
            sets = [[frozenset(x) if x else NOTHING for x in b.column(i).to_pylist()] for i in (3, 4)]
            text = [main_text(page, *x) if page else "" for page, *x in zip(b.column(2).to_pylist(), *sets)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.join(judged, "host", "left").select("page_id", "url", "html", "low", "spared").mapInArrow(extract, f"page_id {kind}, url string, text string")
