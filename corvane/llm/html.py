"""Operator 6: main text of web pages by equivalence-class template deduction.

Pages of one host share a template. A page is a sequence of tokens: tags with the path they stand in (names and classes, without
digits), and text nodes with theirs. Tokens with the same occurrence vector over a host's pages (so often in this page, so often in
that) form an equivalence class; a class in at least half of the host's pages, and in MIN_PAGES of them, is a part of the
template. All tokens of the page take part. Vectors aren't gathered anywhere: a token's vector is represented by a sum of hashes of (page, count), so
classes come from two aggregations that combine on the map side, however many pages a host has. In a page, a class is valid if its tokens
(the first occurrence of each, the second of each and so on) come in the template's order and lie in one slot of every larger
class (they nest). What is not template is slots; their text is the page's data, and only data is extracted.

Main text is the data of one element of the template. For each element that occurs once in a page the data outside links that it holds is summed
up over the host; the deepest one with at least MOST of the host's is the main element. Tags and names break ties: menus, footers, asides,
forms and the like are no data; an article or main element with SOME of the data is preferred; elements named as adverts, comments and so on go while they
hold less than half of the main element's text. A page without the host's main element, or of a host without
template, is judged alone by the same rule.

Defined results: null html is an empty page; pages without url form a host of their own; repeated rows are extracted
each; a host with fewer than MIN_PAGES pages has no template, and then a page's own data and tags decide; a page that holds nothing but template text keeps it; ties go
to the element that comes first by its path's hash; pages of any length and depth are parsed whole, in time linear in both; an empty table gives an empty
result; broken markup is read as far as it goes; ``text`` and ``n_chars`` replace columns of these names.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.batches import bound_batches
from corvane.session import cut, table

MIN_PAGES, SHARE = 4, 0.5
#: Shares of a host's data that make an element the main one: any element, and one that is tagged as article or main.
MOST, SOME = 0.6, 0.3
#: Templates with more tokens than this over all hosts aren't broadcast; the join then is by host and salt.
BROADCAST_TOKENS, SALTS = 500_000, 16

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(title)\b[^>]*>[^<]*</title\s*>"
    r"|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<",
    re.S | re.I,
)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|itemprop|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math mi mn mo mrow msqrt mstyle msub msup mtext q rp rt ruby s samp semantics small span strike strong sub sup svg time tt u var wbr".split()
)
_OUT = frozenset("nav footer aside form head button dialog menu fieldset noscript template iframe svg object select textarea".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
#: What ends an svg element that isn't closed.
_BREAKS = frozenset("article aside blockquote body center div dl dt dd footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table ul".split())
#: Names of what isn't main text: by themselves, and only where an element has no other name. Place words may stand beside them.
_NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr masthead modal nav navbar navigation newsletter popup promo promoted sidebar signup sponsor sponsored".split()
)
_WEAK = frozenset("banner menu notice notices notification notifications related replies respond share sharing social subscribe toolbar widget widgets".split())
_PLACE = frozenset("area bar block bottom box bottom btn button buttons col column container content form global header icons inner item items left links list main message outer page policy primary right row secondary section site slot thread top unit wrap wrapper".split())
#: An open element of the kind on the left ends where one on the right begins.
_CLOSES = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "thead", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
_DIGITS = re.compile(r"[0-9]+")
_SPLIT = re.compile(r"[-_]+")


class Node(NamedTuple):
    """An element of a page."""

    parent: int
    path: int
    tag: str
    out: bool  # an element that holds no main text, or within one
    named: bool  # so named, or within one
    main: bool  # tagged as article or main
    link: bool


class Token(NamedTuple):
    kind: str  # '#' text, '<' a tag, '>' its end
    node: int
    key: int
    text: str  # of a tag what it puts between texts: a blank or nothing


class Page(NamedTuple):
    tokens: list[Token]
    nodes: list[Node]


@lru_cache(1 << 16)
def _hash(parent: int, name: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(name.encode("utf-8", "surrogatepass"), parent & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def _text_key(path: int, text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(("#" + " ".join(text.split())).encode("utf-8", "surrogatepass"), path & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


@lru_cache(1 << 12)
def named_as_noise(names: str) -> bool:
    """Whether class names or an id say that an element holds no main text."""
    weak, other = False, False
    for name in names.lower().split():
        parts = [x for x in _SPLIT.split(_DIGITS.sub("", name)) if x]
        rest = [x for x in parts if x not in _PLACE]
        if rest and all(x in _NOISE or x in _WEAK for x in rest):
            if any(x in _NOISE for x in rest):
                return True
            weak = True
        elif rest:
            other = True
    return weak and not other


def _attributes(tag: str, raw: str, in_main: bool) -> tuple[str, bool, bool, bool]:
    """Names for the path, and whether the element is out of the main text, is named so, and is tagged as main."""
    names, out, named, main = "", tag in _OUT or (tag == "header" and not in_main), False, tag in ("article", "main")
    if raw and not raw.isspace():
        for name, value in _ATTR.findall(raw):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id"):
                if tag not in ("html", "body"):
                    named |= named_as_noise(value)
                    if name == "class":
                        names = " ".join(sorted(_DIGITS.sub("", value).split()))
            elif name == "role":
                out |= value.lower() in _ROLES
                main |= value.lower() in ("main", "article")
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                out = True
            elif name == "style":
                out |= "display:none" in value.replace(" ", "").lower()
            elif name == "itemprop":
                main |= "articlebody" in value.lower()
    return names, out, named, main


def parse(source: str | None) -> Page:
    tokens: list[Token] = []
    nodes = [Node(-1, 0, "", False, False, False, False)]
    stack = [0]
    open_: Counter = Counter()  # tags on the stack

    def pop():
        open_[nodes[stack.pop()].tag] -= 1

    for m in _TOKEN.finditer(source or ""):
        whole = m.group()
        top = nodes[stack[-1]]
        if whole[0] != "<" or whole == "<":
            tokens.append(Token("#", stack[-1], 0 if whole.isspace() else _text_key(top.path, whole), whole))
            continue
        tag = m.group(4)
        if tag is None:
            if m.group(1) or m.group(2):
                tokens.append(Token("<", stack[-1], _hash(top.path, "<" + (m.group(1) or m.group(2)).lower()), " " if m.group(2) else ""))
            continue
        tag = tag.lower()
        space = "" if tag in _INLINE else " "
        if m.group(3):
            if open_[tag]:
                while nodes[stack[-1]].tag != tag:
                    pop()
                tokens.append(Token(">", stack[-1], _hash(nodes[stack[-1]].path, ">"), space))
                pop()
            else:
                tokens.append(Token(">", stack[-1], _hash(top.path, "/" + tag), space))
            continue
        if tag in _BREAKS and open_["svg"]:
            while open_["svg"]:
                pop()
        while (last := nodes[stack[-1]].tag) in _CLOSES and ((tag in _CLOSES[last]) if _CLOSES[last] else tag not in _INLINE and tag != "br"):
            pop()
        up = nodes[stack[-1]]
        if tag in _VOID or m.group(5).endswith("/"):
            tokens.append(Token("<", stack[-1], _hash(up.path, "<" + tag), space))
            continue
        names, out, named, main = _attributes(tag, m.group(5), up.main or any(open_[x] for x in ("article", "main")))
        nodes.append(Node(stack[-1], _hash(up.path, f"{tag} {names}"), tag, up.out or out, up.named or named, main, up.link or tag == "a"))
        stack.append(len(nodes) - 1)
        open_[tag] += 1
        tokens.append(Token("<", stack[-1], _hash(nodes[-1].path, "<"), space))
    return Page(tokens, nodes)


def keys_of(page: Page) -> list[tuple[int, int]]:
    """(key, place) of all tokens but white space."""
    return [(t.key, place) for place, t in enumerate(page.tokens) if t.kind != "#" or t.key]


def valid_template(keys: list[tuple[int, int]], classes: list[tuple[int, list[int]]]) -> set[int]:
    """Places of the page's template tokens. classes: (pages, keys in order), the largest first."""
    places: dict[int, list[int]] = {}
    for k, place in keys:
        places.setdefault(k, []).append(place)
    # slot of each place: the template tokens before it
    frame: list[int] = []
    for _, own in classes:
        times = {len(places.get(k, ())) for k in own}
        if len(times) > 1 or 0 in times:
            continue  # not in this page
        rounds = list(zip(*(places[k] for k in own)))
        if any(a >= b for at in rounds for a, b in zip(at, at[1:])):
            continue  # not in order
        if frame and len(own) > 1 and any(bisect_left(frame, at[0]) != bisect_left(frame, at[-1]) for at in rounds):
            continue  # spread over several slots
        frame = sorted([*frame, *(a for at in rounds for a in at)])
    return set(frame)


def _data(page: Page, fixed: set[int]) -> list[int]:
    """For each element, the characters of data outside links and what is no main text that it holds."""
    size = [0] * len(page.nodes)
    for place, t in enumerate(page.tokens):
        if t.kind == "#" and t.key and place not in fixed:
            node = page.nodes[t.node]
            if not node.out and not node.link:
                size[t.node] += len(t.text.strip())
    for k in range(len(page.nodes) - 1, 0, -1):
        size[page.nodes[k].parent] += size[k]
    return size


def candidates(page: Page, fixed: set[int]) -> list[tuple[int, int, bool, int]]:
    """(path, depth, tagged as main, characters of data) of the elements that occur once and hold some; the whole page is path 0."""
    once = Counter(n.path for n in page.nodes)
    depth = [0] * len(page.nodes)
    for k, n in enumerate(page.nodes[1:], 1):
        depth[k] = depth[n.parent] + 1
    return [(n.path, depth[k], n.main, size) for k, (n, size) in enumerate(zip(page.nodes, _data(page, fixed))) if size and (once[n.path] == 1) and n.tag not in ("p", "li", "ul", "ol", "b", "i", "em", "strong", "span", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "a")]


def main_element(found: list[tuple[int, int, bool, int]]) -> int:
    """The path of the main element among (path, depth, tagged, size)."""
    total = max((size for path, *_, size in found if path == 0), default=0)
    tagged = [x for x in found if x[2] and x[3] >= SOME * total]
    if tagged:
        return max(tagged, key=lambda x: (x[3], -x[1], x[0]))[0]
    return max((x for x in found if x[3] >= MOST * total), key=lambda x: (x[1], x[3], x[0]), default=(0,))[0]


def main_text(source: str | None, classes: list | None = None, path: int | None = None) -> str:
    """Main text of a page, by the template of its host and the path of the host's main element if there is one."""
    page = parse(source)
    fixed = valid_template(keys_of(page), classes) if classes else set()

    def extract(fixed: set[int]) -> str:
        size = _data(page, fixed)
        root = path
        if root is None or not any(n.path == root and s for n, s in zip(page.nodes, size)):
            root = main_element(candidates(page, fixed))
        inside = [n.path == root for n in page.nodes]
        for k, n in enumerate(page.nodes):
            inside[k] |= k > 0 and inside[n.parent]
        held = [(t, page.nodes[t.node]) for place, t in enumerate(page.tokens) if t.kind == "#" and t.key and place not in fixed and inside[t.node] and not page.nodes[t.node].out]
        named = sum(len(t.text) for t, n in held if n.named) * 2 < sum(len(t.text) for t, _ in held)
        parts = [
            t.text if t.kind != "#" or (not t.key or (place not in fixed and inside[t.node] and not page.nodes[t.node].out and not (named and page.nodes[t.node].named))) else ""
            for place, t in enumerate(page.tokens)
        ]
        return " ".join(entities.unescape("".join(parts)).split())

    return extract(fixed) or (extract(set()) if fixed else "")


def host_of(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def templates(pages: DataFrame, url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """host and classes: array of (pages, keys in order), the largest class first. Its tokens number at most the average page's over ``share`` a host."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for host, page, source in zip(b["host"], b["page"], b[html]):
                keys = keys_of(parse(source))
                first = {k: p for p, (k, _) in reversed(list(enumerate(keys)))}
                rows += [(host, k, _hash(page, str(n)), first[k]) for k, n in Counter(k for k, _ in keys).items()]
            yield pd.DataFrame(rows, columns=["host", "key", "vector", "place"])

    rows = pages.select(host_of(url).alias("host"), F.monotonically_increasing_id().alias("page"), F.col(html)).mapInPandas(count, "host string, key long, vector long, place int")
    # the wide sums can't overflow and don't depend on the order
    by = rows.groupBy("host", "key").agg(F.count("*").alias("pages"), F.sum(F.col("vector").cast("decimal(38,0)")).alias("vector"), F.avg("place").alias("place"))
    hosts = pages.select(host_of(url).alias("host")).groupBy("host").agg(F.count("*").alias("of")).filter(F.col("of") >= min_pages)
    part = by.filter(F.col("pages") >= min_pages).join(hosts, "host").filter(F.col("pages") >= share * F.col("of"))
    classes = part.groupBy("host", "vector", "pages").agg(F.array_sort(F.collect_list(F.struct("place", "key")))["key"].alias("keys"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("pages")).alias("less"), (-F.size("keys")).alias("fewer"), "pages", "keys")))
    return classes.groupBy("host").agg(order.alias("c")).select("host", F.transform("c", lambda c: F.struct(c["pages"].alias("pages"), c["keys"].alias("keys"))).alias("classes"))


def _classes(cell) -> list | None:
    return None if cell is None else [(x["pages"], list(x["keys"])) for x in cell]


def main_elements(rows: DataFrame, html: str) -> DataFrame:
    """__host and __path of each host's main element. rows: pages with __host and __classes."""

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for host, classes, source in zip(b["__host"], b["__classes"], b[html]):
                page = parse(source)
                fixed = valid_template(keys_of(page), _classes(classes))
                found += [(host, *x) for x in candidates(page, fixed)]
            yield pd.DataFrame(found, columns=["__host", "path", "depth", "main", "size"])

    each = rows.filter("__classes IS NOT NULL").select("__host", "__classes", html).mapInPandas(weigh, "__host string, path long, depth int, main boolean, size long")
    # read twice below, and pages are to be parsed once; a row for each element of a host's pages
    by = cut(each.groupBy("__host", "path").agg(F.min("depth").alias("depth"), F.max("main").alias("main"), F.sum("size").alias("size")))
    by = by.join(by.filter("path = 0").select("__host", F.col("size").alias("total")), "__host")
    some = F.max(F.when(F.col("main") & (F.col("size") >= SOME * F.col("total")), F.struct("size", -F.col("depth"), "path")))["path"]
    most = F.max(F.when(F.col("size") >= MOST * F.col("total"), F.struct("depth", "size", "path")))["path"]
    return by.groupBy("__host").agg(F.coalesce(some, most).alias("__path"))


def extract(pages: DataFrame, url: str = "url", html: str = "html", broadcast_tokens: int = BROADCAST_TOKENS, min_pages: int = MIN_PAGES) -> DataFrame:
    """Adds text and n_chars."""
    bound_batches(pages.sparkSession)
    made = cut(templates(pages, url, html, min_pages).withColumnsRenamed({"host": "__host", "classes": "__classes"}))
    tokens = made.agg(F.sum(F.aggregate("__classes", F.lit(0), lambda n, c: n + F.size(c["keys"])))).first()[0] or 0
    rest = [c for c in pages.columns if c not in ("text", "n_chars")]
    rows = pages.select(*[F.col(f"`{c}`") for c in rest], host_of(url).alias("__host"))

    def with_host(made: DataFrame) -> DataFrame:
        if tokens <= broadcast_tokens:
            return rows.join(F.broadcast(made), "__host", "left")
        salted = made.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return rows.withColumn("__salt", F.pmod(F.xxhash64(html), F.lit(SALTS)).cast("int")).join(salted, ["__host", "__salt"], "left")

    made = cut(made.join(main_elements(with_host(made), html), "__host", "left"))

    @F.pandas_udf("string")
    def run(sources: pd.Series, classes: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([main_text(s, _classes(c), None if pd.isna(p) else int(p)) for s, c, p in zip(sources, classes, paths.astype(object))], dtype=object)

    # a path has more digits than a float, which a column with nulls would become
    made = made.withColumn("__path", F.col("__path").cast("string"))
    return with_host(made).select(*[F.col(f"`{c}`") for c in rest], run(F.col(html), F.col("__classes"), F.col("__path")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars")
