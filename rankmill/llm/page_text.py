"""Main text of list pages: wrappers inferred per list, as union-free regular expressions over token streams.

A page becomes a stream of tags and texts, read as a tree. The content of an
element is a union-free expression over its children: a sequence of items, each
optional or not, and repeated groups `( ... )+`; texts are slots. Two expressions
are aligned item by item: what only one has becomes optional, what goes back to
an earlier item makes the items from there on a repeated group, and texts that
differ become slots. Every child (tag and classes) thus stands once in an
expression, so a wrapper is bounded by a template, not by the number of its pages,
and it can be inferred from partial wrappers in any grouping.

The wrapper tells template from text: what stands at one place on every page of a
list is the template's. The article's region is found by its element, or, where a
page has none, as the place with most text in slots, from the first to the last of them.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: elements whose content is no markup
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: elements inside a line of text; everything else begins and ends a block
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr img picture source audio video track map area embed param object input".split()
)
#: a start tag closes these open elements, up to the element that holds them
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
DROPPED = {"head", "nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "svg", "math", "canvas", "fieldset", "datalist", *RAW}
#: words in class, id or role that name what isn't the article
DROPPED_NAMES = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot adunit adbox adbanner sponsor sponsored promo promotion promoted banner "
    "navigation navbar nav sidenav menu breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar header siteheader "
    "cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay paywall "
    "comment comments commentlist respond responses discussion disqus replies reply feedback "
    "share sharing social related recommended recommendations newsletter subscribe subscription signup login "
    "search pagination pager skip complementary contentinfo".split()
)
#: names of parts that hold articles of their own; any other named element that holds an article is a page's frame
HOLD_OTHERS = set(
    "comment comments commentlist respond discussion disqus replies reply related recommended recommendations "
    "sponsored promoted ad ads advert adverts".split()
)
KEPT_TAGS = {"html", "body", "article", "main"}
#: only these can be dropped by a name: headings, paragraphs, list items, cells, quotes and figures never are
CONTAINERS = set("div section header span ul ol dl table center details ins".split())
#: words that name one thing only, so one of them is enough inside an article; the others need a second word beside them
SURE_NAMES = set(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot adunit adbox adbanner sponsored "
    "comments commentlist disqus breadcrumb breadcrumbs navbar navigation sidebar masthead pagination pager newsletter "
    "cookie cookies gdpr paywall".split()
)


class Element:
    __slots__ = ("tag", "sign", "dropped", "frame", "kids")

    def __init__(self, tag: str, sign: str, dropped: bool, frame: bool = False):
        self.tag, self.sign, self.dropped = tag, sign, dropped
        self.frame = frame  # dropped by its name or as a form, but not where it holds the article
        self.kids: list[Element | str] = []  # blocks of text are strings


def _attributes(text: str) -> dict[str, str]:
    found = ATTRIBUTE.findall(text)
    return {name.lower(): html.unescape(a or b or c) for name, a, b, c in reversed(found)}


def _says_more(name: str) -> bool:
    """A class of several words, one of them of what isn't the article: `social-share`, not `social`."""
    words = [w for w in re.split(r"[^a-z]+", name) if w]
    return len(words) > 1 and any(w in DROPPED_NAMES for w in words)


def _element(tag: str, attributes: str, inside_article: bool) -> Element:
    values = _attributes(attributes) if attributes.strip(" /\t\n") else {}
    classes = values.get("class", "").lower().split()
    sign = ".".join([tag, *sorted(c for c in classes if c.isascii() and not any(x.isdigit() for x in c))[:4]])
    named = " ".join([*classes, values.get("id", "").lower(), values.get("role", "").lower()])
    names = set(re.split(r"[^a-z]+", named))
    by_name = tag in CONTAINERS or tag not in KEPT_TAGS and "-" in tag or "comment" in names and tag == "article"
    if by_name and inside_article:
        by_name = bool(names & SURE_NAMES) or "comment" in names and tag == "article" or any(map(_says_more, classes))
    dropped = tag in DROPPED or by_name and bool(names & DROPPED_NAMES)
    if tag == "header" or "header" in names and tag in CONTAINERS:
        # an article's own head is part of it
        dropped = not inside_article or by_name and bool(names & (DROPPED_NAMES - {"header"}))
    return Element(tag, sign, dropped, (tag not in DROPPED or tag == "form") and not names & HOLD_OTHERS)


def parse(page: str | None) -> Element:
    """The page as a tree of block elements, of any depth; inline elements leave no trace but their text."""
    page = page or ""
    root = Element("", "", False)
    stack, text, at = [root], [], 0
    opened: Counter[str] = Counter()  # open elements by tag

    def flush() -> None:
        block = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if block:
            stack[-1].kids.append(block)

    def close(k: int) -> None:
        flush()
        opened.subtract(e.tag for e in stack[k:])
        del stack[k:]

    while at < len(page):
        token = TOKEN.search(page, at)
        if token is None:
            text.append(page[at:])
            break
        text.append(page[at : token.start()])
        at = token.end()
        ending, tag, attributes, stop = token.group(1, 2, 3, 4) if token[2] else token.group(5, 6, 7, 8)
        if not tag:
            if token[0].startswith("<![CDATA["):
                text.append(html.escape(token[0][9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        if stop != ">":
            break  # a tag that the end of the page cuts off
        if ending:
            if tag in INLINE:
                continue
            if tag in ("br", "hr"):
                text.append(" ")
                continue
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0) if opened[tag] else 0
            if k:
                close(k)
            else:
                flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.IGNORECASE).search(page, at)
            at = end.end()
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in INLINE:
            continue
        flush()
        if tag in VOID:
            continue
        closed, limit = CLOSES.get(tag, ((), ()))
        if stack[-1].tag == "p" and tag not in closed:
            close(len(stack) - 1)
        for k in range(len(stack) - 1, 0, -1) if any(opened[t] for t in closed) else ():
            if stack[k].tag in limit:
                break
            if stack[k].tag in closed:
                close(k)
        element = _element(tag, attributes, bool(opened["article"] or opened["main"]))
        if tag in ("article", "main") and not element.dropped and not opened["article"]:
            for e in stack:
                e.dropped &= not e.frame
        stack[-1].kids.append(element)
        stack.append(element)
        opened[tag] += 1
    flush()
    return root


def text_mark(block: str) -> int:
    data = block.encode()
    return zlib.crc32(data) << 24 ^ zlib.adler32(data)


class Wrapper:
    """Expression of one element's content.

    n: pages that have the element; order: the items, each a list of one child, or
    of several for a repeated group; texts: marks of the texts that all pages have here.
    """

    __slots__ = ("n", "repeated", "order", "kids", "texts")

    def __init__(self, n: int = 0, repeated: bool = False, order=None, kids=None, texts=None):
        self.n, self.repeated = n, repeated
        self.order: list[list[str]] = order or []
        self.kids: dict[str, Wrapper] = kids or {}
        self.texts: set[int] = texts or set()

    @staticmethod
    def of_page(element: Element) -> Wrapper:
        below = [element]  # parents before their children; no recursion, as a page may be nested to any depth
        for e in below:
            below += [k for k in e.kids if isinstance(k, Element)]
        made: dict[int, Wrapper] = {}
        for e in reversed(below):
            w = made[id(e)] = Wrapper(1, texts={text_mark(k) for k in e.kids if isinstance(k, str)})
            signs = []
            for kid in e.kids:
                if isinstance(kid, Element):
                    signs.append(kid.sign)
                    sub = made.pop(id(kid))
                    if kid.sign in w.kids:
                        w.kids[kid.sign].join(sub, same_page=True)
                        w.kids[kid.sign].repeated = True
                    else:
                        w.kids[kid.sign] = sub
            w.follow(signs)
        return made[id(element)]

    def follow(self, signs: list[str]) -> None:
        """Aligns the order of items with one more sequence of children."""
        at = -1
        for sign in signs:
            here = next((i for i, group in enumerate(self.order) if sign in group), None)
            if here is None:
                at += 1
                self.order.insert(at, [sign])
            elif here >= at:
                at = here
            else:  # back to an earlier item: everything from there on repeats as a group
                group = [s for g in self.order[here : at + 1] for s in g]
                self.order[here : at + 1] = [group]
                at = here

    def join(self, other: Wrapper, same_page: bool = False) -> Wrapper:
        """Takes in the expression of other pages, or of another sibling of this page."""
        pairs = [(self, other)]
        while pairs:
            one, two = pairs.pop()
            if same_page:
                one.texts |= two.texts
            else:
                one.texts = one.texts & two.texts if one.n and two.n else one.texts | two.texts
                one.n += two.n
            one.repeated |= two.repeated
            one.follow([s for group in two.order for s in (group * 2 if len(group) > 1 else group)])
            for sign, kid in two.kids.items():
                if sign in one.kids:
                    pairs.append((one.kids[sign], kid))
                else:
                    one.kids[sign] = kid
        return self

    def _all(self) -> list[Wrapper]:
        """This one and all below it, parents before their children, level by level."""
        below = [self]
        for w in below:
            below += [w.kids[s] for s in sorted(w.kids)]
        return below

    def plain(self) -> list:
        """A flat list: all wrappers as in _all, each with the signs of its children."""
        return [[w.n, int(w.repeated), w.order, sorted(w.texts), sorted(w.kids)] for w in self._all()]

    @staticmethod
    def of_plain(x: list) -> Wrapper:
        made = [Wrapper(n, bool(repeated), order, texts=set(texts)) for n, repeated, order, texts, _ in x]
        rest = iter(made[1:])
        for w, row in zip(made, x):
            w.kids = {sign: next(rest) for sign in row[4]}
        return made[0]

    def dumps(self) -> str:
        return json.dumps(self.plain(), separators=(",", ":"))

    @staticmethod
    def loads(text: str) -> Wrapper:
        return Wrapper.of_plain(json.loads(text))

    def expression(self) -> str:
        """The regular expression in words, for people: `?` optional, `+` repeated, `#` a slot."""
        known: dict[int, str] = {}
        for w in reversed(self._all()):
            items = []
            for group in w.order:
                inner = " ".join(
                    f"<{s}>{known.pop(id(w.kids[s]))}</{s}>" + ("+" if w.kids[s].repeated else "") + ("?" if w.kids[s].n < w.n else "")
                    for s in group
                )
                items.append(f"({inner})+" if len(group) > 1 else inner)
            known[id(w)] = " ".join(["#", *items])
        return known[id(self)]


def _sub(wrapper: Wrapper | None, kid: Element) -> Wrapper | None:
    return wrapper.kids.get(kid.sign) if wrapper is not None else None


def _fixed(wrapper: Wrapper | None, pages: int) -> set[int]:
    """Marks of the texts that the template has directly in an element."""
    return wrapper.texts if wrapper is not None and pages > 1 and wrapper.n == pages else set()


def _blocks(element: Element, wrapper: Wrapper | None, pages: int) -> Iterator[tuple[str, bool]]:
    """Texts in order, without dropped elements, and whether the template has them."""
    todo = [(iter(element.kids), wrapper, _fixed(wrapper, pages))]
    while todo:
        kids, wrapper, fixed = todo[-1]
        for kid in kids:
            if isinstance(kid, str):
                yield kid, bool(fixed) and text_mark(kid) in fixed
            elif not kid.dropped:
                sub = _sub(wrapper, kid)
                todo.append((iter(kid.kids), sub, _fixed(sub, pages)))
                break
        else:
            todo.pop()


def _regions(element: Element, wrapper: Wrapper | None, tags: tuple[str, ...]) -> Iterator[tuple[Element, Wrapper | None]]:
    """Outermost elements with one of the tags that nothing dropped surrounds."""
    todo = [(element, wrapper)]
    while todo:
        element, wrapper = todo.pop()
        if element.tag in tags:
            yield element, wrapper
        else:
            kids = [k for k in element.kids if isinstance(k, Element) and not k.dropped]
            todo += [(k, _sub(wrapper, k)) for k in reversed(kids)]


def _weights(element: Element, wrapper: Wrapper | None, pages: int) -> dict[int, int]:
    """Length of the text in slots of every element that isn't dropped, by its id()."""
    below, weights = [(element, wrapper)], {}
    for e, w in below:
        below += [(k, _sub(w, k)) for k in e.kids if isinstance(k, Element) and not k.dropped]
    for e, w in reversed(below):
        fixed = _fixed(w, pages)
        own = sum(len(k) for k in e.kids if isinstance(k, str) and not (fixed and text_mark(k) in fixed))
        weights[id(e)] = own + sum(weights[id(k)] for k in e.kids if isinstance(k, Element) and not k.dropped)
    return weights


def _densest(element: Element, wrapper: Wrapper | None, pages: int) -> tuple[Element, Wrapper | None]:
    """Down from an element to the smallest one that still holds most of its text in slots, but not past a heading."""
    weights = _weights(element, wrapper, pages)
    while not any(isinstance(k, Element) and k.tag in ("h1", "h2") for k in element.kids):
        kids = [k for k in element.kids if isinstance(k, Element) and not k.dropped]
        best = max(kids, key=lambda k: weights[id(k)], default=None)
        if best is None:
            return element, wrapper
        if best.tag in ("p", "li", "td", "h1", "h2", "blockquote") or weights[id(best)] * 10 < weights[id(element)] * 7:
            return element, wrapper
        element, wrapper = best, _sub(wrapper, best)
    return element, wrapper


def main_text(root: Element, wrapper: Wrapper | None) -> str:
    """The article's blocks, joined by line ends.

    Nothing inside an article or main element is dropped because other pages repeat
    it. Without one, the region goes from the first to the last text in a slot.
    """
    pages = wrapper.n if wrapper is not None else 0
    found = list(_regions(root, wrapper, ("article",))) or list(_regions(root, wrapper, ("main",)))
    tagged = bool(found)
    if not found:
        found = [_densest(root, wrapper, pages)]
    blocks = [b for element, sub in found for b in _blocks(element, sub, pages)]
    slots = [i for i, (_, fixed) in enumerate(blocks) if not fixed]
    if slots and not tagged:  # a list of copies of one page has no slots
        blocks = blocks[slots[0] : slots[-1] + 1]
    return "\n".join(text for text, _ in blocks)


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """list_key, wrapper: one per list, from all its pages.

    Each task folds the pages of a list into one wrapper, these are joined in two
    steps by (list, part) and list: a list with most pages is never in one task.
    """
    schema = pa.schema([("list_key", pa.string()), ("part", pa.int32()), ("wrapper", pa.string())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        wrappers: dict[str, Wrapper] = {}
        for batch in batches:
            for key, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                wrappers.setdefault(key or "", Wrapper()).join(Wrapper.of_page(parse(page)))
        part = TaskContext.get().partitionId() % 64
        keys = list(wrappers)
        for i in range(0, len(keys), 1000):
            some = keys[i : i + 1000]
            yield pa.RecordBatch.from_pydict(
                {"list_key": some, "part": [part] * len(some), "wrapper": [wrappers[k].dumps() for k in some]}, schema=schema
            )

    def join(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = Wrapper()
        for batch in batches:
            for text in batch.column(2).to_pylist():
                whole.join(Wrapper.loads(text))
        yield pa.RecordBatch.from_pydict({"list_key": [key[0].as_py()], "part": [0], "wrapper": [whole.dumps()]}, schema=schema)

    columns = "list_key string, part int, wrapper string"
    partial = pages.select("list_key", "html").mapInArrow(fold, columns)
    for by in (["list_key", "part"], ["list_key"]):
        partial = partial.groupBy(*by).applyInArrow(join, columns)
    return partial.select("list_key", "wrapper")


def extract_main_text(pages: DataFrame) -> DataFrame:
    """Main text of every list page.

    pages: `list_key`, `page_id` (integer), `url`, `html`, as list_pages has them;
    other columns are not read. Returns per row page_id, url, text, n_chars (code
    points). A null list is the list without a name, a null or empty page has no
    text. Repeated rows stay, an empty table gives an empty result. White space in
    a block becomes one space, blocks are joined by a line end.
    """
    rows = pages.select(
        F.coalesce(F.col("list_key").cast("string"), F.lit("")).alias("list_key"),
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    )
    wrappers = infer_wrappers(rows)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kept = None, None
        for batch in batches:
            texts = []
            for page, wrapper in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if wrapper != known:
                    known, kept = wrapper, Wrapper.loads(wrapper) if wrapper else None
                texts.append(main_text(parse(page), kept))
            columns = [batch.column(0), batch.column(1).cast(pa.string()), pa.array(texts, type=pa.string()), pa.array(map(len, texts), type=pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    joined = rows.join(wrappers, "list_key", "left").select("page_id", "url", "html", "wrapper")
    return joined.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
