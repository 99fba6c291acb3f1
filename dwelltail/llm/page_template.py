"""Main text of web pages by deduced templates.

All pages of a host are read as token sequences: tags with their path, and text blocks with theirs. Tokens with the same
occurrence vector (how often each page has them) form an equivalence class. A vector is never built: a token's
class is known by sums over the pages of its count times the page's random weights, which are added up in the tasks and
merged. Classes with enough tokens on enough of the host's pages make the template; on each page only those classes
count whose tokens keep their order and nest in the gaps of the larger classes. What lies between
template tokens are slots. A slot is content unless an element around it is one of menus, headers, footers, sidebars,
notices, adverts, forms or comments by its tag or name (a whole class or id; names, forms and dialogs do not count where the element holds the page's main
element, nor a main element's header with the h1), or, where the page marks no main element, unless the
host's text at that path is mostly links. Template text is dropped, outside a main element
and inside it; only headings and what stands in the main element itself stay there, because an article may well repeat.

Defined results: NULL and empty html give the empty text; a NULL url or one without a host is one host of its own; hosts
with few pages have no template, and their slots are judged by path alone; equal pages get equal texts; an
empty table gives no rows; columns of the input named like an added one are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwelltail.llm.common import text_blocks, without
from dwelltail.session import attach, cut

#: Share of a host's pages, and pages at least, on which a template class must occur.
SUPPORT = 0.5
LEAST_PAGES = 3
#: Tokens that a class has at least.
LEAST_TOKENS = 2
#: Share of link text above which a slot of a page without a main element is a menu.
LINK_SHARE = 0.5
#: Tokens that a task adds up before it passes them on.
HELD_TOKENS = 100_000

# Elements by what they mean in HTML.
RAW = frozenset("script style noscript template iframe object svg math canvas audio video textarea select head title".split())
#: Raw elements whose content is no markup: without a closing tag they reach to the end of the page.
PLAIN = frozenset("script style textarea title".split())
#: What stands in a head; any other tag ends it.
HEAD = frozenset("base link meta script style noscript template title object bgsound basefont head html".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
LOOSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot option pre caption".split())
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SIDE = frozenset("nav header footer aside button menu".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary alert alertdialog menu menubar".split())
#: Side elements that may as well wrap a whole page, judged like side names.
WRAPS = frozenset("form fieldset dialog".split())
WRAP_ROLES = frozenset("form search dialog".split())
SIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline consent cookie cookies copyright footer form header login "
    "masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted recommended related reply "
    "respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget disclaimer".split()
)
#: Words that say nothing of an element's meaning beside a side name.
NEUTRAL = frozenset(
    "site page box list block area section item items bar button buttons slot unit top bottom left right primary secondary side posts articles links".split()
)
SIDE_PARTS = ("comment", "sidebar", "advert", "cookie", "newsletter", "breadcrumb", "disqus")

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>|</?[a-zA-Z][^>]*+\Z",
    re.S,
)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PIECE = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")


def is_side_name(name: str) -> bool:
    """Whether all words of one class or id, but for neutral ones, are side names."""
    words = [w.lower() for w in _PIECE.findall(name)]
    known = [w in SIDE_NAMES or any(p in w for p in SIDE_PARTS) for w in words]
    return any(known) and all(k or w in NEUTRAL for k, w in zip(known, words))


def names_of(attributes: str) -> tuple[set[str], str, bool]:
    """Words of class and id, the role, and whether a class or id is a side name."""
    words, role, odd = set(), "", False
    for kind, *values in _NAMED.findall(attributes):
        value = "".join(values)
        if kind.lower() == "role":
            role = value.strip().lower()
        else:
            words.update(w.lower() for w in _PIECE.findall(value))
            odd = odd or any(map(is_side_name, value.split()))
    return words, role, odd


class Block:
    """A text block: its path, its text, the length of its link text, where it stands, and whether it is a heading or the main element's own."""

    __slots__ = ("path", "parts", "links", "main", "side", "at", "own", "named")

    def __init__(self, path: str, main: bool, side: bool, at: int, own: bool):
        self.path, self.parts, self.links, self.main, self.side, self.at, self.own = path, [], 0, main, side, at, own

    def text(self) -> str:
        return " ".join(entities.unescape("".join(self.parts)).split())


def end_of(tag: str, attributes: str, html: str, place: int, unclosed: set[str]) -> int:
    """Where a raw element that begins before ``place`` ends; without a closing tag its content is read as any other.

    ``unclosed`` keeps the tags that no closing one follows, which are then not looked for again.
    """
    if tag == "head":
        for match in _TAG.finditer(html, place):
            if match.start() < place:  # inside a raw element of the head
                continue
            if html[place : match.start()].strip():  # text ends a head
                return place
            inner = (match.group(2) or match.group(5) or "").lower()
            closing = match.group(1) or match.group(4)
            if inner == "head" and closing:
                return match.end()
            if inner and inner not in HEAD or inner == "html" and closing:
                return match.start()
            place = match.end()
            if inner in RAW and inner != "head" and not closing:
                place = end_of(inner, match.group(3) or match.group(6) or "", html, place, unclosed)
        return place
    if tag in ("svg", "math") and attributes.rstrip().endswith("/"):
        return place
    closed = None if tag in unclosed else re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, place)
    if closed is None:
        unclosed.add(tag)
    return closed.end() if closed else len(html) if tag in PLAIN else place


def read_page(html: str) -> tuple[list[str], list[Block]]:
    """Tag tokens in page order, and the text blocks with the number of tag tokens before them."""
    tags: list[str] = []
    blocks: list[Block] = []
    # tag, path, inside a main element, inside a side element by tag or role, role main, innermost element with a side name
    stack: list[tuple[str, str, bool, bool, bool, int]] = []
    outer: list[int] = []  # per element with a side name the next one around it
    heart, heading, title = None, None, None  # where the page's first main element, first h1 and first h1 in a main element stand among them
    headers: set[int] = set()  # those that are headers of a main element
    leaf, links, current, place = "", 0, None, 0
    unclosed: set[str] = set()

    def add(text: str) -> None:
        nonlocal current
        if current is None:
            if not text.strip():
                return
            path, main, side = stack[-1][1:4] if stack else ("", False, False)
            own = leaf in HEADINGS or main and bool(stack) and (stack[-1][0] in MAIN or stack[-1][4])
            current = Block(f"{path}/{leaf}", main, side, len(tags), own)
            current.named = stack[-1][5] if stack else -1
            blocks.append(current)
        current.parts.append(text)
        if links:
            current.links += len(text)

    for match in _TAG.finditer(html):
        start = match.start()
        if start < place:  # inside a raw element
            continue
        if start > place:
            add(html[place:start])
        place = match.end()
        closing, tag, attributes = match.group(1, 2, 3) if match.group(2) else match.group(4, 5, 6)
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW and not closing:
            place = end_of(tag, attributes, html, place, unclosed)
            continue
        if tag == "a":
            links = max(0, links + (-1 if closing else 1))
        if tag in VOID:
            if tag not in INLINE:
                current = None
            continue
        words, role, odd = names_of(attributes) if attributes and not closing else ((), "", False)
        odd = odd and tag not in ("html", "body", "main") and tag not in HEADINGS and role != "main"
        # an article among the comments is no main element; the header of a main element stays if it has the h1
        central = tag in MAIN and not odd or role == "main"
        top = tag == "header" and bool(stack) and stack[-1][2] and role not in SIDE_ROLES
        sure = (tag in SIDE and not top) or role in SIDE_ROLES
        odd = odd or top or not central and (tag in WRAPS or role in WRAP_ROLES)
        side = sure or odd
        if closing:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None:
                del stack[depth:]
                current, leaf = None, ""
                tags.append(f"{stack[-1][1] if stack else ''}/{tag}>")
            elif tag not in INLINE:
                current, leaf = None, ""
            continue
        if tag in INLINE and not side:
            continue
        current, leaf, links = None, tag if tag in LOOSE else "", links if tag in LOOSE or tag in INLINE else 0
        named = stack[-1][5] if stack else -1
        if tag == "h1" and not (stack and stack[-1][3]):
            heading = named if heading is None else heading
            if title is None and stack and stack[-1][2]:
                title = named
        if tag in LOOSE and not side:
            tags.append(f"{stack[-1][1] if stack else ''}/{tag}")
            continue
        path, main, inside = stack[-1][1:4] if stack else ("", False, False)
        label = ".".join([tag, *sorted(words)])
        main = main or central
        if heart is None and central and not (inside or sure):
            heart = named
        if odd and not sure:
            outer.append(named)
            named = len(outer) - 1
            if top:
                headers.add(named)
        stack.append((tag, f"{path}/{label}", main, inside or sure, role == "main", named))
        tags.append(f"{path}/{label}")
    if place < len(html):
        add(html[place:])
    kept = title if title in headers else None  # the header right around the h1
    settle(blocks, outer, heading if heart is None else heart, heart is not None, kept)
    return tags, blocks


def settle(blocks: list[Block], outer: list[int], heart: int | None, marked: bool, header: int | None = None) -> None:
    """Side blocks by name: not where the element holds the page's main element (else its h1, or most of its text), or is the main element's ``header``."""
    if not outer:
        return
    holds = [i == header for i in range(len(outer))]
    while heart is not None and heart >= 0:
        holds[heart] = True
        heart = outer[heart]
    chars = [0] * len(outer)
    total = 0
    for block in blocks:
        if not block.side:
            size = sum(map(len, block.parts))
            total += size
            if block.named >= 0:
                chars[block.named] += size
    for i in range(len(outer) - 1, -1, -1):
        if outer[i] >= 0:
            chars[outer[i]] += chars[i]
    sides: list[bool] = []
    for i, around in enumerate(outer):
        kept = holds[i] or not marked and 2 * chars[i] > total
        sides.append(not kept or around >= 0 and sides[around])
    for block in blocks:
        block.side = block.side or block.named >= 0 and sides[block.named]


def number_of(*parts: str) -> int:
    return int.from_bytes(blake2b("\x00".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def tokens_of(tags: list[str], blocks: list[Block]) -> list[int]:
    """Numbers of all tokens in page order: tags, and text blocks with their text."""
    tokens, at = [], 0
    for block in blocks:
        tokens += [number_of(t) for t in tags[at : block.at]]
        at = block.at
        tokens.append(number_of(block.path, block.text()))
    return tokens + [number_of(t) for t in tags[at:]]


#: What is added up per (host, token): pages, occurrences, two weighted sums, and the sum of first places.
TOKEN_SUMS = ("pages", "times", "sum_a", "sum_b", "places", "chars", "link_chars")
ALL_PAGES = 0


def _summed(batches):
    held: dict = {}

    def rows():
        keys = list(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([k[2] for k in keys], pa.int32())]
            + [pa.array([held[k][i] for k in keys], pa.int64()) for i in range(len(TOKEN_SUMS))],
            names=["_host", "token", "kind", *TOKEN_SUMS],
        )
        held.clear()

    def put(key, *values):
        sums = held.get(key)
        if sums is None:
            held[key] = list(values)
        else:
            for i, value in enumerate(values):
                sums[i] += value

    for block in text_blocks(batches, "_html"):
        for host, html in zip(block.column("_host").to_pylist(), block.column("_html").to_pylist()):
            tags, blocks = read_page(html or "")
            draw = blake2b((html or "").encode("utf-8", "surrogatepass"), digest_size=6).digest()
            a, b = int.from_bytes(draw[:3], "little"), int.from_bytes(draw[3:], "little")
            tokens = tokens_of(tags, blocks)
            first: dict[int, int] = {}
            for place, token in enumerate(tokens):
                first.setdefault(token, place)
            put((host, ALL_PAGES, 0), 1, 0, 0, 0, 0, 0, 0)
            for token, times in Counter(tokens).items():
                put((host, token, 1), 1, times, times * a, times * b, first[token], 0, 0)
            slots: dict = defaultdict(lambda: [0, 0])
            for one in blocks:
                slot = slots[number_of(one.path)]
                slot[0] += sum(map(len, one.parts))
                slot[1] += one.links
            for slot, (chars, links) in slots.items():
                put((host, slot, 2), 1, 0, 0, 0, 0, chars, links)
        if len(held) > HELD_TOKENS:
            yield from rows()
    yield from rows()


def templates(pages: DataFrame) -> DataFrame:
    """Per ``_host``: the template's tokens with class and order, and its paths: kind 2 where their text is mostly links, else 3."""
    schema = "_host string, token long, kind int, " + ", ".join(f"{c} long" for c in TOKEN_SUMS)
    summed = pages.select("_host", "_html").mapInArrow(_summed, schema)
    merged = summed.groupBy("_host", "token", "kind").agg(*[F.sum(c).alias(c) for c in TOKEN_SUMS])
    # Only tokens and paths on at least half of the pages meet per host: no more than twice those of a page.
    kept = cut(merged.filter((F.col("kind") == 0) | (F.col("pages") >= LEAST_PAGES)))
    totals = kept.filter("kind = 0").select(F.col("_host").alias("_h"), F.col("pages").alias("_all"))
    known = attach(kept.filter("kind > 0").withColumn("_h", F.col("_host")), totals, ["_h"]).drop("_h")
    shared = known.filter(F.col("pages") >= SUPPORT * F.col("_all"))
    links = F.col("link_chars") > LINK_SHARE * F.col("chars")
    vector = F.struct("pages", "times", "sum_a", "sum_b")
    entry = F.struct(F.when((F.col("kind") == 2) & ~links, 3).otherwise(F.col("kind")).alias("kind"), F.col("token"), F.xxhash64(vector).alias("vector"), (F.col("places") / F.col("pages")).alias("place"))
    return shared.groupBy("_host").agg(F.sort_array(F.collect_list(entry)).alias("_template"))


def usable(classes: dict[int, list[tuple[float, int]]], tokens: list[int]) -> set[int]:
    """Template tokens of the classes that keep their order on this page and nest in the larger ones."""
    first: dict[int, int] = {}
    for place, token in enumerate(tokens):
        first.setdefault(token, place)
    accepted: list[list[int]] = []
    result: set[int] = set()
    for members in sorted(classes.values(), key=lambda m: (-len(m), m)):
        if len(members) < LEAST_TOKENS:
            continue
        places = [first.get(token) for _, token in sorted(members)]
        if None in places or any(a > b for a, b in zip(places, places[1:])):
            continue
        # nested: seen from a class already accepted, all of it lies in one gap, or the other way round
        crosses = any(
            any(o > places[0] and o < places[-1] for o in outer) and not (outer[0] > places[0] and outer[-1] < places[-1])
            and any(p > outer[0] and p < outer[-1] for p in places) and len(outer) < len(places)
            for outer in accepted
        )
        if not crosses:
            accepted.append(places)
            result.update(token for _, token in members)
    return result


def main_text(html: str | None, template: list) -> tuple[str, int, int]:
    """Main text of a page, the template tokens found on it, and its content slots."""
    tags, blocks = read_page(html or "")
    classes: dict[int, list] = defaultdict(list)
    menus, others = set(), set()
    for entry in template or ():
        if entry["kind"] == 1:
            classes[entry["vector"]].append((entry["place"], entry["token"]))
        else:
            (menus if entry["kind"] == 2 else others).add(entry["token"])
    tokens = tokens_of(tags, blocks) if classes else []
    fixed = usable(classes, tokens) if classes else set()
    marked = any(b.main and not b.side for b in blocks)
    if not marked:  # a path that few of the host's pages have is judged by this page
        own: dict = defaultdict(lambda: [0, 0])
        for block in blocks:
            slot = own[number_of(block.path)]
            slot[0] += sum(map(len, block.parts))
            slot[1] += block.links
        menus.update(slot for slot, (chars, links) in own.items() if slot not in others and links > LINK_SHARE * chars)
    texts = []
    for block in blocks:
        if block.side or marked and not block.main:
            continue
        text = block.text()
        if marked and not block.own and number_of(block.path, text) in fixed:
            continue
        if not marked and (number_of(block.path) in menus or number_of(block.path, text) in fixed):
            continue
        if text:
            texts.append(text)
    return " ".join(texts), sum(t in fixed for t in tokens), len(texts)


ADDED = ("text", "n_chars", "n_template", "n_slots")


def extract(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``pages`` without html, with ``text``, ``n_chars``, and the template tokens and content slots of the page."""
    kept = [c for c in without(pages, ADDED) if c != html]
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    named = pages.select(*kept, host.alias("_host"), F.col(html).alias("_html"))
    joined = attach(named, templates(named), ["_host"], "left")

    def extracted(batches):
        for block in text_blocks(batches, "_html"):
            found = [main_text(h, t) for h, t in zip(block.column("_html").to_pylist(), block.column("_template").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [block.column(c) for c in kept]
                + [pa.array([f[0] for f in found], pa.string()), pa.array([len(f[0]) for f in found], pa.int64())]
                + [pa.array([f[i] for f in found], pa.int64()) for i in (1, 2)],
                names=[*kept, *ADDED],
            )

    schema = pages.select(*kept, F.lit("").alias("text"), *[F.lit(0).cast("long").alias(c) for c in ADDED[1:]]).schema
    return joined.mapInArrow(extracted, schema)
