"""Payload pages to data: blocks of JSON, meta tags, links, cards and lists, as expressions over a table of pages.

Only what needs balanced brackets or nested tags runs in Python, a batch of pages at a time (mapInArrow), with the standard
library's parsers.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache, partial, reduce
from html import unescape as unescape_all
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import holds_any, once
from ..functions.text import norm_text
from ..functions.urls import absolutize
from ..workers import ship

_SCRIPT = r"(?is)<script\b[^>]*\btype\s*=\s*[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script>"


def json_ld_blocks(body: Column) -> Column:
    """The texts of a page's JSON-LD scripts. The pattern is tried only where the type that it needs stands."""
    mark = F.lit("application/ld+json")
    with_ = F.contains(body, mark) | (F.contains(body, F.lit("+")) & F.contains(F.lower(body), mark))  # few pages are lower-cased
    return F.when(~with_, F.array().cast("array<string>")).otherwise(F.regexp_extract_all(body, F.lit(_SCRIPT), F.lit(1)))


def _listed(raw: Column) -> Column:
    """The JSON texts in a script: the elements of an array, objects that stand one after another, or the whole."""
    items = F.from_json(raw, "array<string>")
    split = F.transform(F.split(raw, r"\}\s*\{"), lambda p: F.concat(F.when(F.startswith(F.ltrim(p), F.lit("{")), "").otherwise("{"), p, F.when(F.endswith(F.rtrim(p), F.lit("}")), "").otherwise("}")))
    several = raw.rlike(r"\}\s*\{") & F.forall(split, lambda p: F.try_parse_json(p).isNotNull())  # valid JSON has no }{ but in texts
    return F.when(F.startswith(F.ltrim(raw), F.lit("[")), F.coalesce(items, F.array(raw))).when(several, split).otherwise(F.array(raw))


def page_nodes(body: Column) -> Column:
    """The JSON texts of all JSON-LD nodes of a page, in its order; what is no JSON is left out."""
    return F.filter(F.flatten(F.transform(json_ld_blocks(body), _listed)), lambda n: F.try_parse_json(n).isNotNull())


def first_node(body: Column, *types: str) -> Column:
    """The first node of a type on a page, among its nodes and one level down in their @graph; null without one."""
    none = F.array().cast("array<string>")
    # A key is spelled out, or with escapes; a node without either isn't read for it.
    graph = lambda n: F.when(holds_any(n, ("@graph", "\\u")), F.coalesce(F.from_json(F.get_json_object(n, "$['@graph']"), "array<string>"), none)).otherwise(none)
    every = F.flatten(F.transform(page_nodes(body), lambda n: F.concat(F.array(n), graph(n))))
    return F.get(F.filter(every, lambda n: _is_type(n, types)), F.lit(0))


def json_ld_nodes(pages: DataFrame, key: str = "url", body: str = "body") -> DataFrame:
    """key, pos, node (JSON text): the nodes of all JSON-LD scripts."""
    return pages.select(key, F.posexplode(page_nodes(F.col(body))).alias("pos", "node"))


def _is_type(node: Column, types: tuple[str, ...]) -> Column:
    wanted = F.array(*(F.lit(x.lower()) for x in types))
    names = lambda t: F.when(F.startswith(t, F.lit("[")), F.from_json(t, "array<string>")).otherwise(F.array(t))
    return F.coalesce(once(F.lower(F.get_json_object(node, "$['@type']")), lambda t: F.arrays_overlap(names(t), wanted)), F.lit(False))


def first_of_type(nodes: DataFrame, *types: str, key: str = "url") -> DataFrame:
    """key, node: the first node of a type on each page, among the nodes and one level down in @graph."""
    graph = F.from_json(F.get_json_object("node", "$['@graph']"), "array<string>")
    own = nodes.select(key, F.struct("pos", F.lit(-1).alias("g")).alias("p"), "node")
    below = nodes.select(key, "pos", F.posexplode(graph).alias("g", "node")).select(key, F.struct("pos", "g").alias("p"), "node")
    return own.unionByName(below).where(_is_type(F.col("node"), types)).groupBy(key).agg(F.min_by("node", "p").alias("node"))


def next_data(body: Column) -> Column:
    """The JSON text of the page's state script; null if there is none."""
    return F.nullif(F.regexp_extract(body, r'(?s)<script[^>]+id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1), F.lit(""))


def meta_tags(body: Column) -> Column:
    """map of name or property to content; the first of a name wins."""
    tags = F.regexp_extract_all(body, F.lit(r"(?is)(<meta\b[^>]*>)"), F.lit(1))
    single = lambda t, a: F.when(F.contains(t, F.lit("'")), F.regexp_extract(t, rf"(?is)\b{a}\s*=\s*'([^']*)'", 1)).otherwise("")
    attr = lambda t, a: F.concat(F.regexp_extract(t, rf'(?is)\b{a}\s*=\s*"([^"]*)"', 1), single(t, a))
    pairs = F.transform(tags, lambda t: F.struct(F.coalesce(F.nullif(attr(t, "name"), F.lit("")), F.nullif(attr(t, "property"), F.lit(""))).alias("key"), unescape(attr(t, "content")).alias("value")))
    # Tags are read once: a lambda works out anew for each element what it takes from outside, but for another lambda's variable.
    firsts = lambda keys, values: F.map_from_arrays(F.array_distinct(keys), F.transform(F.array_distinct(keys), lambda k: F.get(values, F.array_position(keys, k).cast("int") - 1)))
    return once(F.filter(pairs, lambda p: p["key"].isNotNull()), lambda named: firsts(named["key"], named["value"]))


def title(body: Column) -> Column:
    return F.btrim(unescape(F.regexp_extract(body, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def canonical(body: Column) -> Column:
    tag = F.regexp_extract(body, r"(?is)(<link\b[^>]*\brel\s*=\s*[\"']?canonical[^>]*>)", 1)
    return F.nullif(F.regexp_extract(tag, r"(?is)\bhref\s*=\s*[\"']([^\"']*)", 1), F.lit(""))


def unescape(s: Column) -> Column:
    """The usual character references as characters; they are looked for only in a text with an &."""

    def decoded(t: Column) -> Column:
        out = t
        # References by name.
        for a, b in (("&nbsp;", " "), ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
            out = F.replace(out, F.lit(a), F.lit(b))
        return F.when(F.contains(t, F.lit("&")), out).otherwise(t)

    return once(s, decoded)


def strip_tags(body: Column) -> Column:
    """Text without scripts, styles, comments and tags; references decoded, white space collapsed."""
    hiding = ("<s", "<S", "<!--")  # every match of the pattern holds one
    plain = once(body, lambda b: F.when(holds_any(b, hiding), F.regexp_replace(b, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")).otherwise(b))
    return F.btrim(F.regexp_replace(unescape(F.regexp_replace(plain, r"<[^>]*>", " ")), r"\s+", " "))


def links(pages: DataFrame, key: str = "url", body: str = "body", pattern: str | None = None) -> DataFrame:
    """key, link: the distinct absolute targets of a page's hrefs, optionally only those that match a pattern."""
    hrefs = F.regexp_extract_all(F.col(body), F.lit(r"(?is)<a\b[^>]*\bhref\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    found = pages.select(key, F.col("url").alias("_base"), F.explode(hrefs).alias("h")).select(key, absolutize(unescape(F.col("h")), F.col("_base")).alias("link"))
    found = found.where("link is not null")
    return (found.where(F.col("link").rlike(pattern)) if pattern else found).distinct()


def union_links(*sets: DataFrame) -> DataFrame:
    """link, hint: the distinct links of several tables (link, hint); of a link's hints the first table's that has one counts."""
    tagged = [d.select("link", F.struct(F.lit(k).alias("k"), "hint").alias("h")) for k, d in enumerate(sets)]
    return reduce(DataFrame.unionByName, tagged).groupBy("link").agg(F.min(F.when(F.col("h.hint").isNotNull(), F.col("h"))).alias("h")).select("link", F.col("h.hint").alias("hint"))


def sitemap_locs(pages: DataFrame, key: str = "url", body: str = "body") -> DataFrame:
    """key, loc: the entries of sitemaps."""
    return pages.select(key, F.explode(F.regexp_extract_all(F.col(body), F.lit(r"<loc>\s*([^<]+?)\s*</loc>"), F.lit(1))).alias("loc"))


def child_sitemaps(pages: DataFrame, name_pattern: str) -> DataFrame:
    """loc of the entries of those sitemaps that an index among the pages names, by pattern."""
    named = sitemap_locs(pages).where(F.col("loc").rlike(name_pattern)).select(F.col("loc").alias("url")).distinct()
    return sitemap_locs(pages.join(named, "url", "left_semi")).select("loc").distinct()


def numbered_objects(body: Column) -> Column:
    """The JSON objects under a response's numeric keys, by key order."""
    entries = F.map_entries(F.from_json(body, "map<string,string>"))
    found = F.filter(entries, lambda e: e["key"].rlike(r"^\d+$") & F.startswith(e["value"], F.lit("{")))
    return F.transform(F.array_sort(F.transform(found, lambda e: F.struct(e["key"].try_cast("int").alias("k"), e["value"].alias("v")))), lambda x: x["v"])


def catalogue_blocks(body: Column, marker: str) -> Column:
    """A script cut at each marker; what stands before the first is left out."""
    parts = F.split(body, f"(?={re.escape(marker)})")
    return F.filter(parts, lambda p: F.startswith(p, F.lit(marker)))


def decoded_link(coded: Column, otherwise: Column) -> Column:
    """The URL in a base64 text; else another."""
    return once(F.decode(F.try_to_binary(coded, F.lit("base64")), "UTF-8"), lambda clear: F.when(clear.rlike(r"(?i)^https?://"), clear).otherwise(otherwise))


# What needs a scanner -------------------------------------------------------------------------------------------------


_DECODE = json.JSONDecoder().raw_decode
_OPENING = re.compile(r"(?:[{\[\s:]|\"[^\"{}\[\]]*\")+")
_CODED = {"&q;": '"', "&l;": "<", "&g;": ">", "&a;": "&"}  # fixed values; & last, as what it makes isn't a code


def coded_state(page: str | None, key: str) -> list[str]:
    """The object after a key in a state blob whose quotes and brackets are coded as in _CODED."""
    plain = (page or "").partition(f"{key}&q;:")[2]
    for code, char in _CODED.items():
        plain = plain.replace(code, char)
    try:
        return [plain[: _DECODE(plain)[1]]] if plain.startswith("{") else []
    except (ValueError, RecursionError):  # cut off, or nested deeper than the decoder goes
        return []


def _holders(value: object, key: str) -> Iterator[dict]:
    """The objects inside a parsed value that hold a text under a key, outer ones first."""
    ahead = [value]
    while ahead:
        x = ahead.pop()
        if isinstance(x, dict):
            if isinstance(x.get(key), str) and x[key]:
                yield x
            x = list(x.values())
        if isinstance(x, list):
            ahead.extend(reversed(x))


def streamed_objects(page: str | None, id_key: str) -> list[str]:
    """Objects that hold an id key in a page's streamed chunks, distinct by id."""
    chunks = []
    for m in re.finditer(r'self\.__next_f\.push\(\[1,(?=")', page or ""):
        try:
            chunks.append(_DECODE(page, m.end())[0])
        except ValueError:
            continue
    flight, found, at = "".join(chunks), {}, 0
    while (at := flight.find("{", at)) >= 0:
        try:
            value, at = _DECODE(flight, at)
        except ValueError:
            at += 1
            continue
        except RecursionError:  # nested deeper than the decoder goes: on behind this run of brackets
            at = _OPENING.match(flight, at).end()
            continue
        for x in _holders(value, id_key):
            found.setdefault(x[id_key], x)
    return [json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in found.values()]


#: What most pages are made of: text, end tags, start tags with attributes in double quotes and without references; the last group is anything else.
_TOKEN = re.compile(r'([^<]+)|</([a-z][a-z0-9]*)>|<([a-z][a-z0-9]*)((?:[ \n\t]+[a-z][a-z0-9-]*="[^"&]*")*)[ \n\t]*(/?)>|(<)')
_ATTRIBUTE = re.compile(r'([a-z][a-z0-9-]*)="([^"]*)"')
# Elements whose content is no markup, for the parser of this Python, and of others.
_RAW = frozenset(HTMLParser.CDATA_CONTENT_ELEMENTS)
_RAW_TOO = frozenset("textarea title plaintext iframe noembed noframes noscript xmp".split()) - _RAW


def _read_plain(parser: HTMLParser, page: str) -> bool:
    """Give a page's tokens to the parser's handlers as its feed() does, but several times faster; false where the page holds
    something else than _TOKEN's, for which the parser itself is needed, from the start."""
    raw = None
    for m in _TOKEN.finditer(page):
        kind = m.lastindex
        if kind == 1:
            text = m[1]
            parser.handle_data(unescape_all(text) if raw is None and "&" in text else text)
        elif kind == 2:
            if raw is not None and m[2] != raw:
                return False
            raw = None
            parser.handle_endtag(m[2])
        elif kind == 5 and raw is None and m[3] not in _RAW_TOO:
            tag, attrs = m[3], m[4]
            parser.handle_starttag(tag, _ATTRIBUTE.findall(attrs) if attrs else [])
            if m[5]:
                parser.handle_endtag(tag)
            elif tag in _RAW:
                raw = tag
        else:
            return False
    return raw is None


def _parsed(make: Callable[[], HTMLParser], page: str | None) -> HTMLParser:
    """A parser that has read a page."""
    parser = make()
    if not _read_plain(parser, page or ""):
        parser = make()
        parser.feed(page)
        parser.close()
    return parser


class _Cards(HTMLParser):
    """Elements of a class as maps: their attributes, and the text of each classed element inside."""

    def __init__(self, card_class: str):
        super().__init__(convert_charrefs=True)
        self.card_class, self.cards = card_class, []
        self.card, self.depth, self.open = None, 0, []

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def handle_starttag(self, tag, attrs):
        if self.card is None and not attrs:
            return
        named = {k: v or "" for k, v in attrs}
        classes = named["class"].split() if "class" in named else ()
        if self.card is None and self.card_class in classes:
            self.card, self.depth, self.open = {f"@{k}": v for k, v in named.items()}, 0, []
        if self.card is not None:
            if tag == "a" and named.get("href"):
                self.card.setdefault("href", named["href"])
            for k, v in named.items():
                if k.startswith("data-"):
                    self.card.setdefault(k, v)
            if tag not in self.VOID:
                self.depth += 1
                self.open.append((tag, classes, []))

    def handle_data(self, data):
        if self.card is not None:
            for _, _, parts in self.open:
                parts.append(data)

    def handle_endtag(self, tag):
        if self.card is None or tag in self.VOID:
            return
        if not self.open or self.open[-1][0] != tag and not any(t == tag for t, _, _ in self.open):
            return
        while self.open:
            t, classes, parts = self.open.pop()
            for c in classes:
                self.card.setdefault(f".{c}", " ".join("".join(parts).split()))
            if t == tag:
                break
        if not self.open:
            self.cards.append(self.card)
            self.card = None


def cards(page: str | None, card_class: str) -> list[dict[str, str]]:
    return _parsed(partial(_Cards, card_class), page).cards


class _Items(HTMLParser):
    """Texts of list items, table rows and definition pairs."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.parts, self.depth = [], [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("li", "tr", "dl"):
            self.parts, self.depth = [], 1
        elif self.depth and tag in ("span", "strong", "b", "td", "th", "dt", "dd", "div", "p"):
            self.parts.append("\x00")

    def handle_endtag(self, tag):
        if tag in ("li", "tr", "dl") and self.depth:
            self.items.append("".join(self.parts))
            self.parts, self.depth = [], 0
        elif self.depth:
            self.parts.append("\x00")

    def handle_data(self, data):
        if self.depth:
            self.parts.append(data)


_norm_label = lru_cache(4096)(norm_text)  # a site has few labels


def labelled_values(page: str | None) -> dict[str, str]:
    """Normalised label to value of items such as "Label: value" or <b>Label</b> value; the first of a label wins."""
    out: dict[str, str] = {}
    for item in _parsed(_Items, page).items:
        text = " ".join(item.replace("\x00", " ").split())
        label, mark, value = text.partition(":")
        if not mark:
            parts = [" ".join(p.split()) for p in item.split("\x00") if p.split()]
            label, value = (parts[0], " ".join(parts[1:])) if len(parts) > 1 else ("", "")
        if (name := _norm_label(label)) and (value := value.strip()):
            out.setdefault(name, value)
    return out


#: Pages whose finds a worker holds at a time; Arrow's batches are of 10,000 rows however long these are.
SLICE = 128


def map_items(pages: DataFrame, f: Callable[[str | None], list], kind: str, carry: tuple[str, ...] = ("url", "city")) -> DataFrame:
    """carry... and items (an array of a type): what f finds in each page's body, a row a page, whatever its url."""
    names = [*carry, "items"]
    at_body = carry.index("body") if "body" in carry else len(carry)
    sent = pages.withColumn("body", F.col("body").cast("string")).select(*dict.fromkeys((*carry, "body")))
    schema = ", ".join(f"`{c}` {sent.schema[c].dataType.simpleString()}" for c in carry) + f", items array<{kind}>"
    item_type = {"string": pa.string(), "map<string,string>": pa.map_(pa.string(), pa.string())}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                found = [[list(x.items()) if isinstance(x, dict) else x for x in f(body)] for body in batch.column(at_body).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(found, pa.list_(item_type))], names)

    ship(pages.sparkSession)
    return sent.mapInArrow(run, schema)


def map_pages(pages: DataFrame, f: Callable[[str | None], list], kind: str, carry: tuple[str, ...] = ("url", "city")) -> DataFrame:
    """carry..., pos and item (of a type) for each thing that f finds in a page's body."""
    return map_items(pages, f, kind, carry).select(*carry, F.posexplode("items").alias("pos", "item"))


def zipped(pages: DataFrame, other: Column, carry: tuple[str, ...] = ("url", "city")) -> DataFrame:
    """carry..., item and ld: each of a page's items (an array) with the element of another array at its place, if any."""
    both = F.explode(F.arrays_zip(F.col("items").alias("item"), other.alias("ld")))
    return pages.select(*carry, both.alias("z")).select(*carry, "z.item", "z.ld").where("item is not null")
