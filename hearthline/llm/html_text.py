"""HTML extraction by two-pass block rules.

A page is cut into blocks at block-level tags. Pass one labels each block good or bad from its stop-word density, its length
and its link density; short blocks that these do not decide stay open. In pass two an open block takes the label of the
nearest decided block around it. What stands in navigation, header, footer, sidebar, script and similar containers, or
in one whose class or id says advert, notice, menu, comments and so on, is boilerplate whatever its words are, and so is what stands in a form,
unless the form wraps the page: then only its fields and buttons are. A content
container (article, main and the like) vouches for its blocks only if it holds most of what the block rules call good; and where
stop words say nothing (another language, code), length and links decide alone.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

# Tags of HTML by their role, names of containers, and frequent function words of English, German, French and Spanish.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul title caption".split()
)
SKIP_TAGS = frozenset("head script style noscript template iframe svg math canvas object audio video select textarea button label nav footer aside dialog menu".split())
RAW_TAGS = frozenset("script style textarea title noscript iframe".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILERPLATE = re.compile(
    r"ads?\d*|ad(?:sense|sbygoogle|space|slot|box)\w*|advert\w*|sponsor\w*|promo\w*|banners?|cookies?|cookie\w+|consent|gdpr|notices?|alerts?|popup|modal|newsletter|subscribe|signup|login|sidebar\d*|aside|widgets?|menus?|menubar|nav|navbar|navigation|breadcrumbs?|toolbar|topbar|masthead|footer|foot|copyright|legal|share|sharing|sharebar|social|related|recommended|recommendations|comments?|commentlist|respond|replies|disqus\w*|pagination|pager|privacy|contentinfo|complementary|dialog|tags|search"
)
MAIN = re.compile(r"article|articlebody|post|entry|story|content|main")
#: A compound name goes by its last part; these last parts leave it to the first.
HOLDERS = frozenset("area bar block body box button buttons column container content form group header icons inner item items links list panel posts row section slot stories articles thread unit widget wrap wrapper zone".split())
#: Names that begin so tell of something elsewhere; names that end so are cards and captions of content, not content.
MODIFIERS = frozenset("with without no has have hide show is not after before".split())
PARTIAL = frozenset("card cards list grid teaser teasers meta header footer nav item items preview thumb thumbnail excerpt carousel slider".split())
STOP_WORDS = frozenset(
    (
        "a about after all also an and are as at be been but by can did do for from had has have he her his how i if in into is it its more no not of on one or out she so some than that the their them then there they this to up was we were what when which who will with would you "
        "aber alle als am an auch auf aus bei bin bis da das dem den der des die doch ein eine einem einen einer er es für hat hatte ich ihr im in ist ja kann mit nach nicht noch nun nur ob oder sein sich sie sind so über um und uns von vor war was wenn wie wird zu zum zur "
        "au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais me même ne nous on ou où par pas pour qu que qui sa se ses son sur tu un une vous y à "
        "al como con de del donde el ella en entre era es esta este fue ha hay la las le lo los mas más me mi muy no nos o para pero por que se si sin sobre su sus también un una y ya"
    ).split()
)

HREF = re.compile(r"(?<![\w-])href\s*=\s*(?:\"\s*[^\"\s]|'\s*[^'\s]|[^\s\"'>])", re.I)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WORD = re.compile(r"\w+")
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_STOP = re.compile(r"[>=]")
_SPACE = re.compile(r"\s*")


class Block(NamedTuple):
    """links: characters inside links. skipped: by its tags; named: by a container's name; main: in a content container; form: the
    number of the form around it (0: none)."""

    text: str
    links: int
    skipped: bool
    named: bool
    main: bool
    form: int
    heading: bool


class Rules:
    """Thresholds of the block rules. known: the stop-word density from which a page is in a language whose stop words are known."""

    def __init__(self, max_link_density: float = 0.33, length_low: int = 70, length_high: int = 200, stop_low: float = 0.10, stop_high: float = 0.20, known: float = 0.05):
        self.max_link_density, self.length_low, self.length_high = max_link_density, length_low, length_high
        self.stop_low, self.stop_high, self.known = stop_low, stop_high, known

    def linked(self, b: Block) -> bool:
        return b.links > self.max_link_density * len(b.text)

    def label(self, b: Block, main: bool, density: float | None) -> int:
        """1 good, -1 bad, 0 open. main: a content container that is trusted vouches for it. density: of stop words, if they are known."""
        n = len(b.text)
        if self.linked(b):
            return -1
        if main:
            return 1 if n >= self.length_low or (density or 0) >= self.stop_high else 0
        density = self.stop_high if density is None else density
        if n < self.length_low:
            return 0 if b.links == 0 else -1
        if density >= self.stop_high:
            return 1 if n >= self.length_high else 0
        return 0 if density >= self.stop_low else -1


def stop_counts(text: str) -> tuple[int, int]:
    """Stop words, and all words."""
    found = WORD.findall(text.lower())
    return sum(map(STOP_WORDS.__contains__, found)), len(found)


def named(label: str, names: re.Pattern) -> bool:
    """Whether one of the class tokens is such a name: as a whole, by its last part, or by its first before a part of HOLDERS."""
    for token in label.split():
        parts = re.split(r"[_-]+", token.strip("_-"))
        if parts[0] in MODIFIERS:
            continue
        if names.fullmatch(token) or names.fullmatch(parts[-1]) or (parts[-1] in HOLDERS and names.fullmatch(parts[0])):
            return True
    return False


def main_named(label: str) -> bool:
    """Whether a class token names a content container: no card, header or footer of one."""
    return any(t.rstrip("_-") and re.split(r"[_-]+", t.strip("_-"))[-1] not in PARTIAL and named(t, MAIN) for t in label.split())


class _Page:
    """Scanning places in a page, in linear time: what has been looked for in vain isn't looked for again."""

    def __init__(self, page: str):
        self.page, self.dead = page, set()

    def find(self, what: str, at: int) -> int:
        k = -1 if what in self.dead else self.page.find(what, at)
        if k < 0:
            self.dead.add(what)
        return k

    def tag_end(self, at: int) -> int:
        """The place of the > that ends a tag; quotes count where a value begins. -1: there is none."""
        while True:
            m = _STOP.search(self.page, at) if "stop" not in self.dead else None
            if m is None:
                self.dead.add("stop")
                return -1
            if m[0] == ">":
                return m.start()
            at = _SPACE.match(self.page, m.end()).end()
            quote = self.page[at : at + 1]
            if quote and quote in "\"'":
                over = self.find(quote, at + 1)
                at = over + 1 if over >= 0 else at + 1

    def close_tag(self, tag: str, at: int) -> int:
        """The place after the end tag of a raw element; -1: there is none."""
        if f"</{tag}" in self.dead:
            return -1
        m = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(self.page, at)
        if m is None:
            self.dead.add(f"</{tag}")
            return -1
        return m.end()


def blocks(page: str) -> list[Block]:
    """The blocks of a page in its order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool, int]] = []  # open containers: tag, skipped, named, main, form
    parts: list[str] = []
    link_chars = at = forms = 0
    link_depth = -1  # containers around the open link; -1: there is none
    heading = False
    scan = _Page(page)

    def text(piece: str) -> None:
        nonlocal link_chars
        parts.append(piece)
        if link_depth >= 0:
            link_chars += len(piece.strip())

    def close() -> None:
        nonlocal link_chars
        joined = " ".join(html.unescape("".join(parts)).split())
        if joined:
            out.append(Block(joined, link_chars, *(stack[-1][1:] if stack else (False, False, False, 0)), heading))
        parts.clear()
        link_chars = 0

    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            text(page[at:])
            break
        if start > at:
            text(page[at:start])
        after = page[start + 1 : start + 2]
        if after in ("!", "?"):
            if page.startswith("<!--", start):
                over, size = scan.find("-->", start + 4), 3
            elif page.startswith("<![CDATA[", start):
                over, size = scan.find("]]>", start), 3
            else:
                over, size = scan.find(">", start), 1
            at = over + size if over >= 0 else len(page)
            continue
        ending = after == "/"
        name = _NAME.match(page, start + 1 + ending)
        if name is None:  # no tag
            text("<")
            at = start + 1
            continue
        over = scan.tag_end(name.end())
        if over < 0:  # a tag that never ends
            break
        tag, attributes = name[0].lower(), page[name.end() : over]
        at = over + 1
        if ending:
            if tag == "a":
                link_depth = -1
            if tag in BLOCK_TAGS or tag in SKIP_TAGS:
                close()
                if tag in HEADINGS:
                    heading = False
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                if len(stack) < link_depth:  # a link ends with the container that it began in
                    link_depth = -1
            continue
        if tag == "a":  # one without a target is an anchor, and any ends the one before
            link_depth = len(stack) if HREF.search(attributes) else -1
        elif tag == "br":
            parts.append("\n")
        elif tag in BLOCK_TAGS or tag in SKIP_TAGS:
            close()
            if tag in HEADINGS:
                heading = True
            elif tag in ("p", "li") and stack and stack[-1][0] == tag:  # a paragraph ends the one before
                stack.pop()
                if len(stack) < link_depth:
                    link_depth = -1
            if tag in RAW_TAGS:  # nothing inside is text; without an end tag, a self-closed one is empty
                over = scan.close_tag(tag, at)
                at = over if over >= 0 else at if attributes.endswith("/") else len(page)
                continue
            if tag in VOID_TAGS:
                continue
            _, skipped, by_name, main, form = stack[-1] if stack else ("", False, False, False, 0)
            names = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in ATTRIBUTE.finditer(attributes)} if attributes else {}
            label = f"{names.get('class', '')} {names.get('id', '')} {names.get('role', '')}".lower()
            skipped |= tag in SKIP_TAGS or "hidden" in names or names.get("aria-hidden") == "true" or bool(HIDDEN.search(names.get("style", "")))
            if tag == "form":
                skipped |= form > 0  # a form inside a form
                forms += 1
                form = form or forms
            if tag not in ("html", "body", "main", "article") and label.strip():
                by_name |= named(label, BOILERPLATE)
            if tag in MAIN_TAGS or names.get("itemprop") == "articleBody" or (not skipped and not by_name and tag != "body" and main_named(label)):
                main = True
            if not main and (tag == "header" or any(t.endswith("header") for t in label.split())):  # an article's own header holds its title
                skipped = True
            stack.append((tag, skipped, by_name, main, form))
    close()
    return out


def _spread(found: list[Block], labels: list[int], main: bool, low: int) -> list[int]:
    """Pass two: each open block takes the label of the nearest decided one; inside a container only its own blocks count."""
    before, last = [-1] * len(found), -1
    for k, x in enumerate(labels):
        last = k if x else last
        before[k] = last
    final, after = list(labels), -1
    for k in range(len(found) - 1, -1, -1):
        after = k if labels[k] else after
        if labels[k]:
            continue
        left, right = before[k], after
        if found[k].main:
            left = left if left >= 0 and found[left].main else -1
            right = right if right >= 0 and found[right].main else -1
        if left < 0 and right < 0:
            final[k] = 1 if main and found[k].main else -1
        elif left < 0 or right >= 0 and (found[k].heading or right - k < k - left):  # a heading goes with what follows it
            final[k] = labels[right]
        elif right - k == k - left and len(found[k].text) >= low:  # as near to both: one of some length is good if either is
            final[k] = max(labels[left], labels[right])
        else:  # a shorter one continues what stands before it
            final[k] = labels[left]
    return final


def _longest_run(found: list[Block], usable: list[bool]) -> list[int]:
    """1 for the run of usable blocks with the most characters, the first of equal ones; else -1."""
    best, run, chars, most = range(0), 0, 0, 0
    for k, ok in enumerate([*usable, False]):
        if ok:
            chars += len(found[k].text)
        else:
            if chars > most:
                best, most = range(run, k), chars
            run, chars = k + 1, 0
    return [1 if k in best else -1 for k in range(len(found))]


def judge_forms(found: list[Block], rules: Rules) -> list[Block]:
    """The blocks with those of forms skipped, but for a form that wraps the page: one with more than half of all text in blocks of some length."""
    solid: dict[int, int] = {}
    for b in found:
        if not (b.skipped or b.named or rules.linked(b)) and len(b.text) >= rules.length_low:
            solid[b.form] = solid.get(b.form, 0) + len(b.text)
    wraps = {f for f, n in solid.items() if 2 * n > sum(solid.values())}
    return [b._replace(skipped=True) if b.form and b.form not in wraps else b for b in found]


def choose(found: list[Block], rules: Rules) -> list[int]:
    """1 for each block of the article, -1 for each other. What stands in boilerplate containers is no neighbour either."""
    found = judge_forms(found, rules)
    own = [k for k, b in enumerate(found) if not (b.skipped or b.named)]
    out = [-1] * len(found)
    for k, x in zip(own, _choose([found[k] for k in own], rules), strict=True):
        out[k] = x
    if 1 not in out:  # nothing but blocks in containers with boilerplate names
        out = _longest_run(found, [not (b.skipped or rules.linked(b)) and len(b.text) >= rules.length_low for b in found])
    return out


def _choose(found: list[Block], rules: Rules) -> list[int]:
    live = [b for b in found if not rules.linked(b)]
    counts = [(0, 1) if rules.linked(b) else stop_counts(b.text) for b in found]
    known = sum(s for s, _ in counts) >= rules.known * sum(n for _, n in counts)
    density = [s / max(1, n) if known else None for s, n in counts]
    plain = [rules.label(b, False, d) for b, d in zip(found, density, strict=True)]
    inside = sum(len(b.text) for b in live if b.main)
    outside = sum(len(b.text) for b, x in zip(found, plain, strict=True) if x == 1 and not b.main)
    if inside and inside >= outside:  # a container with most of the good text is trusted, and what lies outside it is boilerplate
        labels = [rules.label(b, True, d) if b.main else -1 for b, d in zip(found, density, strict=True)]
        if 1 not in labels:
            labels = [1 if x == 0 else x for x in labels]
        return _spread(found, labels, True, rules.length_low)
    if 1 not in plain:  # open blocks of some length stand for good ones
        plain = [1 if x == 0 and len(b.text) >= rules.length_low else x for b, x in zip(found, plain, strict=True)]
    return _spread(found, plain, False, rules.length_low) if 1 in plain else _longest_run(found, [not b.links for b in found])


def main_text(page: str | None, rules: Rules | None = None) -> str:
    """The article of one page: its good blocks joined by newlines; empty for a null or empty page or one of menus alone.

    A page in which no block is good or open gives its longest run of blocks without links.
    """
    if not page:
        return ""
    found = blocks(page)
    return "\n".join(b.text for b, x in zip(found, choose(found, rules or Rules()), strict=True) if x == 1)


def extract_main_text(pages: DataFrame, rules: Rules | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page, extracted from its whole html.

    Null or empty html gives an empty text, html without markup its words. Tags that never end, and raw elements without an end
    tag, take the rest of the page with them, as in browsers. page_id and url are carried as they
    are, nulls and repeated rows included; other columns of the input, whatever their names, are left out. Work is one pass
    over each row, so there is nothing to shuffle or to skew but a page's own length.
    """
    rules = rules or Rules()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x.as_py(), rules) for x in batch.column(2)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    plain = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_arrow(plain, run, "page_id bigint, url string, text string, n_chars bigint")
