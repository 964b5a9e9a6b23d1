"""HTML main-text extraction by wrappers, union-free regular expressions inferred from pages of one host.

The token stream of a page is folded: runs of like elements, and runs of like
groups of elements, become repeated groups. The wrapper of a host starts as one
folded page and is aligned with the others, one after the other: elements that
only one side has become optional, neighbours that turn out alike become
repeated, and texts that differ become slots. Texts that stay the same on all
pages are part of the template.

The wrapper tells where the main text lies: in its article or main element, or
else in the smallest element that holds most of the slots' text. On every page
the text at that place is taken as a whole, without the parts that are
navigation, adverts, notices, forms, comments and the like, and, outside an
article element, without the template's own texts.

A wrapper is inferred from all pages of a host: each task aligns those it reads,
and the tasks' wrappers of a host are aligned with each other, level by level.
Every page is extracted. A page that does not fit its wrapper, or a host
without one, is extracted by a wrapper of the page alone.

Defined results: a null or empty html gives an empty text; a null url or one
without host belongs to the host ''; repeated rows are extracted like others;
other columns are ignored. A task holds the wrappers of ``HELD`` hosts at most,
and aligns about ``FEW`` wrappers of a host at a time.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_small

#: Hosts whose wrappers a task holds before it passes them on, and wrappers of a host that one task aligns.
HELD, FEW = 500, 32
#: The share of an element's slot text that a part must hold to be the place of the main text.
MOST = 0.7
#: Children that are aligned one by one, and lengths of groups that repeat.
ALIGNED, GROUP = 400, 4

# Elements of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template svg iframe xmp math".split())
#: Elements that are closed when one of the second kind opens inside the same parent.
CLOSED_BY = {
    "p": set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"},
    "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"},
    "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"},
}
SCOPE = set("table ul ol dl select article section aside nav main div body html".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
ASIDE = set("nav footer aside form script style noscript template svg math iframe button select option input textarea dialog menu head title object canvas audio video xmp".split())
ASIDE_NAMES = set(
    "nav navbar navigation menu menubar sidebar footer ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices comment comments commentlist disqus respond reply replies social share sharing related recommended "
    "recommendations breadcrumb breadcrumbs pagination pager subscribe subscription newsletter signup popup modal overlay widget widgets toolbar skip "
    "masthead topbar login search".split()
)
#: Words that may stand beside these in a name without making it the name of content.
NEUTRAL = set(
    "area articles bar block body bottom bottoms box btn button buttons center col column container content footer form frame group header inline inner item items left "
    "link links list main outer page panel post posts right row section site slot small text title top unit wrap wrapper".split()
)
ASIDE_ROLES = set("navigation banner contentinfo complementary search dialog alert menu menubar form".split())

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME = re.compile(r"[a-z]+|[0-9]+")
BLANK = re.compile(r"\s+")


@dataclass
class Node:
    tag: str
    key: str
    aside: bool = False
    main: bool = False
    children: list = field(default_factory=list)


def _element(tag: str, raw: str, inside: bool) -> Node:
    a = {m[0].lower(): m[1] or m[2] or m[3] for m in ATTRIBUTE.findall(raw)} if raw.strip(" /\n\t") else {}
    names = f"{a.get('class', '')} {a.get('id', '')}".split()
    key = tag + "".join(f".{n}" for n in sorted(set(names)) if not any(c.isdigit() for c in n))
    parts = {p for n in names for p in NAME.findall(n.lower())} | {n.lower() for n in names}
    if inside:  # within an article only names that say nothing else, so that a section on related work stays
        named = any(set(NAME.findall(n.lower())) & ASIDE_NAMES and set(NAME.findall(n.lower())) <= ASIDE_NAMES | NEUTRAL for n in names)
    else:
        named = bool(parts & ASIDE_NAMES)
    role = a.get("role", "").lower()
    hidden = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
    main = tag in ("article", "main") or role in ("main", "article") or a.get("itemprop") == "articleBody"
    # a header within an article is the article's own
    off = tag in ASIDE or role in ASIDE_ROLES or hidden or named or (not inside and (tag == "header" or "header" in parts))
    return Node(tag, key, off and tag not in ("html", "body", "article", "main"), main and not off)


def parse(page: str) -> Node:
    """The element tree of a page; end tags that are left out are supplied."""
    root = Node("", "")
    open_, at = [root], 0

    def text(raw: str) -> None:
        if raw:
            open_[-1].children.append(entities.unescape(raw) if "&" in raw else raw)

    while True:
        m = TOKEN.search(page, at)
        if not m:
            text(page[at:])
            return root
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag == tag:
                    del open_[k:]
                    break
                if open_[k].tag in SCOPE and tag not in SCOPE:
                    break
            continue
        for k in range(len(open_) - 1, 0, -1):
            if tag in CLOSED_BY.get(open_[k].tag, ()):
                del open_[k:]
                break
            if open_[k].tag in SCOPE and open_[k].tag not in CLOSED_BY:
                break
        node = _element(tag, m[3], any(n.main for n in open_))
        open_[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*(?:>|$)", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not m[3].endswith("/"):
            open_.append(node)


# -- wrappers ---------------------------------------------------------------


@dataclass
class Part:
    """An element, a group of elements (key '()') or a text (key '#') of a wrapper."""

    key: str
    optional: bool = False
    repeated: bool = False
    aside: bool = False
    main: bool = False
    tag: str = ""
    text: str | None = None  # of a text: the template's, or None for a slot
    chars: int = 0  # of texts
    parts: list[Part] = field(default_factory=list)

    def plain(self) -> list:
        """Lists and values, for JSON."""
        return [self.key, self.optional, self.repeated, self.aside, self.main, self.tag, self.text, self.chars, [p.plain() for p in self.parts]]

    @classmethod
    def of(cls, plain: list) -> Part:
        return cls(*plain[:-1], [cls.of(p) for p in plain[-1]])

    def expression(self) -> str:
        """The wrapper as a regular expression over tags, constants and #slots."""
        if self.key == "#":
            body = "#slot" if self.text is None else json.dumps(self.text[:40], ensure_ascii=False)
        else:
            inner = " ".join([p.expression() for p in self.parts])
            body = f"({inner})" if self.key == "()" else f"<{self.key}>{inner}</{self.tag}>"
        return f"({body})" + ("*" if self.optional else "+") if self.repeated else f"({body})?" if self.optional else body


def _alike(p: Part) -> str:
    """What two parts must have in common to be aligned; a group is told by its members."""
    return "(" + ",".join(map(_alike, p.parts)) + ")" if p.key == "()" else p.key


def fold(node: Node) -> Part:
    parts = []
    for c in node.children:
        if isinstance(c, Node):
            parts.append(fold(c))
        elif c.strip():
            t = BLANK.sub(" ", c).strip()
            parts.append(Part("#", text=t, chars=len(t)))
    return Part(node.key, aside=node.aside, main=node.main, tag=node.tag, parts=_repeats(parts))


def _repeats(parts: list[Part]) -> list[Part]:
    """Like neighbours, and then like groups of neighbours, become one repeated part."""
    for width in range(1, GROUP + 1):
        out: list[Part] = []
        for p in parts:
            out.append(p)
            if len(out) < 2 * width:
                continue
            old, new = out[-2 * width : -width], out[-width:]
            if [_alike(x) for x in old] != [_alike(x) for x in new] or all(x.key == "#" for x in new):
                if not (width > 1 and len(out) > width and out[-width - 1].key == "()" and [_alike(x) for x in out[-width - 1].parts] == [_alike(x) for x in new]):
                    continue
                group = out[-width - 1]
                out[-width - 1 :] = [Part("()", group.optional, True, parts=[align(a, b) for a, b in zip(group.parts, new, strict=True)])]
                continue
            merged = [align(a, b) for a, b in zip(old, new, strict=True)]
            if width == 1:
                merged[0].repeated = True
                out[-2:] = merged
            else:
                out[-2 * width :] = [Part("()", repeated=True, parts=merged)]
        parts = out
    return parts


def _steps(left: list[str], right: list[str]) -> Iterator[tuple[str, int, int, int, int]]:
    """Opcodes over windows of ALIGNED parts, each of which begins behind the last match of the one before."""
    at, to = 0, 0
    while at < len(left) or to < len(right):
        steps = SequenceMatcher(None, left[at : at + ALIGNED], right[to : to + ALIGNED], autojunk=False).get_opcodes()
        more = at + ALIGNED < len(left) or to + ALIGNED < len(right)
        if more and steps[-1][0] != "equal" and len(steps) > 1:
            steps.pop()
        yield from ((what, at + i, at + j, to + k, to + m) for what, i, j, k, m in steps)
        at, to = at + steps[-1][2], to + steps[-1][4]


def align(a: Part, b: Part) -> Part:
    """The least union-free expression of this form for what either side stands for."""
    both = Part(a.key, a.optional or b.optional, a.repeated or b.repeated, a.aside or b.aside, a.main or b.main, a.tag)
    both.chars = a.chars + b.chars
    if a.key == "#":
        both.text = a.text if a.text == b.text else None
        return both
    left, right = ([_alike(p) for p in x.parts] for x in (a, b))
    if left == right:
        both.parts = [align(p, q) for p, q in zip(a.parts, b.parts, strict=True)]
        return both
    for what, i, j, k, m in _steps(left, right):
        if what == "equal":
            both.parts += [align(p, q) for p, q in zip(a.parts[i:j], b.parts[k:m], strict=True)]
            continue
        for p in [*a.parts[i:j], *b.parts[k:m]]:
            p.optional = True
            both.parts.append(p)
    both.parts = _repeats(both.parts)
    return both


def infer(pages: list[str]) -> Part:
    wrapper = fold(parse(pages[0]))
    for page in pages[1:]:
        wrapper = align(wrapper, fold(parse(page)))
    return wrapper


def _weights(part: Part, n: int, sizes: dict[int, int], linked: bool = False, optional: bool = False, single: bool = True) -> int:
    """Characters in slots and, if ``single``, optional parts (with one page, in all texts), neither aside nor in links."""
    optional = optional or part.optional
    if part.aside:
        total = 0
    elif part.key == "#":
        total = 0 if linked or (n > 1 and part.text is not None and not (optional and single)) else part.chars
    else:
        total = sum([_weights(p, n, sizes, linked or part.tag == "a", optional, single) for p in part.parts])
    sizes[id(part)] = total
    return total


@dataclass
class Place:
    """Where the main text lies: the keys from the root, and the template's texts there that are left out."""

    path: list[str]
    template: list[str]


def _constants(part: Part) -> Iterator[str]:
    """Texts that all pages have; a part that some page lacks is optional, and its texts are of the pages."""
    if part.optional:
        return
    if part.key == "#" and part.text is not None and not part.repeated:
        yield part.text
    for p in part.parts:
        yield from _constants(p)


def _members(part: Part) -> Iterator[Part]:
    """The element's children, those in groups among them."""
    for p in part.parts:
        yield from _members(p) if p.key == "()" else [p]


def locate(wrapper: Part, n: int) -> Place:
    """Find the place of the main text in a wrapper of ``n`` pages."""
    sizes: dict[int, int] = {}
    slots: dict[int, int] = {}
    _weights(wrapper, n, sizes)
    _weights(wrapper, n, slots, single=False)

    def mains(part: Part, path: list[str]) -> Iterator[tuple[int, list[str], Part]]:
        for p in _members(part):
            if p.aside or p.key == "#":
                continue
            inner = list(mains(p, [*path, p.key]))
            if p.main:
                yield from [x for x in inner if x[0] >= MOST * sum(_all(p))] or [(sum(_all(p)), [*path, p.key], p)]
            else:
                yield from inner

    def _all(part: Part) -> Iterator[int]:
        for p in part.parts:
            if p.key == "#":
                yield p.chars
            elif not p.aside:
                yield from _all(p)

    found = max(mains(wrapper, []), key=lambda x: x[0], default=None)
    if found and found[0]:
        return Place(found[1], [])
    part, path = wrapper, []
    while True:
        step = [p for p in _members(part) if p.key != "#" and p.tag not in INLINE and not (p.tag == "p" or re.fullmatch("h[1-6]", p.tag))]
        step = [p for p in step if sizes[id(p)] and sizes[id(p)] >= MOST * sizes[id(part)] and not (p.repeated and len(step) > 1)]
        # a part that some page lacks is entered only if pages that have it differ there
        step = [p for p in step if not p.optional or (slots[id(p)] and slots[id(p)] >= MOST * slots[id(part)])]
        if not step:
            return Place(path, sorted(set(_constants(part))) if n > 1 else [])
        part = step[0]
        path.append(part.key)


# -- extraction -------------------------------------------------------------


def _collect(node: Node, out: list[str], template: set[str]) -> None:
    for c in node.children:
        if isinstance(c, str):
            if not template or BLANK.sub(" ", c).strip() not in template:
                out.append(c)
        elif not c.aside:
            block = c.tag not in INLINE
            if block:
                out.append(" ")
            _collect(c, out, template)
            if block:
                out.append(" ")


def _at(node: Node, path: list[str]) -> Iterator[Node]:
    if not path:
        yield node
        return
    for c in node.children:
        if isinstance(c, Node) and c.key == path[0]:
            yield from _at(c, path[1:])


def _text(root: Node, place: Place) -> str:
    out: list[str] = []
    for node in _at(root, place.path):
        _collect(node, out, set(place.template))
        out.append(" ")
    return BLANK.sub(" ", "".join(out)).strip()


def extract(page: str | None, place: Place | None) -> str:
    if not page:
        return ""
    root = parse(page)
    return (place and _text(root, place)) or _text(root, locate(fold(root), 1))


# -- tables -----------------------------------------------------------------


def host(url):
    """Lower-case host of a url column, '' where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


WRAPPERS = pa.schema([("host", pa.string()), ("at", pa.int64()), ("n", pa.int64()), ("wrapper", pa.string())])


def _of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wrappers of the pages of a task, by host, numbered by task and place."""
    held: dict[str, list] = {}
    at = TaskContext.get().partitionId() << 32

    def passed() -> pa.RecordBatch:
        nonlocal at
        rows = [{"host": h, "at": at + k, "n": n, "wrapper": json.dumps(w.plain())} for k, (h, (n, w)) in enumerate(held.items())]
        at += len(rows)
        held.clear()
        return pa.RecordBatch.from_pylist(rows, WRAPPERS)

    for b in batches:
        for name, page in zip(b["host"], b["html"], strict=True):
            folded, name = fold(parse(page.as_py())), name.as_py()
            n, wrapper = held.get(name, (0, None))
            held[name] = [n + 1, folded if wrapper is None else align(wrapper, folded)]
            if len(held) >= HELD:
                yield passed()
    yield passed()


def _aligned(rows: pa.Table) -> pa.Table:
    """One wrapper for the wrappers of a host, in the order of their numbers."""
    rows = rows.sort_by("at")
    wrapper = None
    for w in rows["wrapper"]:
        part = Part.of(json.loads(w.as_py()))
        wrapper = part if wrapper is None else align(wrapper, part)
    row = {"host": rows["host"][0].as_py(), "at": rows["at"][0].as_py(), "n": sum(rows["n"].to_pylist()), "wrapper": json.dumps(wrapper.plain())}
    return pa.Table.from_pylist([row], WRAPPERS)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        places, expressions = [], []
        for n, w in zip(b["n"], b["wrapper"], strict=True):
            wrapper = Part.of(json.loads(w.as_py()))
            place = locate(wrapper, n.as_py())
            places.append(json.dumps([place.path, place.template]))
            expressions.append(wrapper.expression())
        yield pa.RecordBatch.from_arrays([b["host"], pa.array(places, pa.string()), pa.array(expressions, pa.string())], ["host", "place", "expression"])


def host_wrappers(pages: DataFrame) -> DataFrame:
    """host, place, expression: the wrapper of every host, from all its pages."""
    columns = "host string, at long, n long, wrapper string"
    rows = pages.select(host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).where("html <> ''")
    found = cut(rows.mapInArrow(_of_task, columns))
    while True:
        most = found.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        groups = ["host"] if most <= 2 * FEW else ["host", F.pmod(F.xxhash64("at"), F.lit(most // FEW))]
        found = found.groupBy(*groups).applyInArrow((lambda _, t: _aligned(t)) if len(groups) > 1 else _aligned, columns)
        if most <= 2 * FEW:
            return found.mapInArrow(_placed, "host string, place string, expression string")
        found = cut(found)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places: dict[str, Place] = {}
    for b in batches:
        texts = []
        for page, place in zip(b["html"], b["place"], strict=True):
            p = place.as_py()
            if p is not None and p not in places:
                if len(places) > 10_000:
                    places.clear()
                places[p] = Place(*json.loads(p))
            texts.append(extract(page.as_py(), places.get(p)))
        yield pa.RecordBatch.from_arrays(
            [b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    wrappers = cut(host_wrappers(pages).select("host", "place"))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    ).withColumn("host", host(F.col("url")))
    rows = join_small(rows, wrappers, ["host"], "left")
    return rows.select("page_id", "url", "html", "place").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
