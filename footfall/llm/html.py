"""Main text of web pages by equivalence-class template deduction.

A page is read as tokens: opening tags with the path of their enclosing elements (as a chained hash), and text
blocks with theirs. Over all pages of a host, each token has a vector of how often it occurs
on each page. Tokens that share a vector are an equivalence class; vectors are compared by a
fingerprint (the exclusive or of hashes of page and count), which partial aggregation can build, so no
host's pages are ever gathered. A class is valid if it stands on at least half of the
host's pages and its elements nest: the parent of each lies in a class with as wide a
support. Pages without any token (null, empty, nothing but comments) are not counted, and a
class on a single page repeats nothing. Valid classes nest by path. What lies between their
tokens are slots.

The article slot is the innermost valid element, once a page on at least half of them, that still holds most of the host's text outside
menus and the like; of several, one named ``article`` or ``main``. Within it, elements that are
by name no article text (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles, comments) are left out; a name around the slot does not count. So is a text block
of a valid class, wherever it occurs, unless it stands in an article element.

Defined results: null or empty html gives the empty text; a null url is a host of its own; a
page without any article element gives the text outside the excluded elements; repeated rows
count as pages of their own; equally good slots are told apart by depth and id; extra columns are
ignored; an empty table gives an empty result. A page is parsed in time linear in its length, and
held whole in a worker.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm import textops as T
from footfall.llm.common import cut, table

#: Template rows (one for a host that differs from the default) that are broadcast at most.
BROADCAST_HOSTS = 20_000

#: One token at a place. Every alternative but a tag ends by itself, and a tag gives nothing back.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|select|svg|iframe|object|canvas|math)\b(?:[^'\"<>]++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^'\"<>]++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^<>]*+>?|[^<]++",
    re.S | re.I,
)
_MARK = re.compile(r"[\"'<>]")
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Elements within a line: they part no words.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold no article text, by tag and by a word of their class, id or role.
_OUT_TAGS = frozenset("head title nav header footer aside form button menu dialog fieldset".split())
_OUT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar side menu nav navbar navigation"
    " breadcrumb breadcrumbs header masthead footer comment comments reply replies respond disqus share sharing social related recommended newsletter subscribe subscription signup login search widget toolbar pagination pager".split()
)
_SPLIT = re.compile(r"[^a-z0-9]+")
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_MAIN = ("article", "main")
#: Elements that make up an article, and are no slot for one.
_WITHIN = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote figure figcaption".split())


class Block:
    """A stretch of text between block tags: id of its element, depth of the innermost element that a name rules out (0: none), whether it lies in an article element, and whether in the slot looked for."""

    __slots__ = ("inside", "main", "out", "path", "text")

    def __init__(self, path: int, text: str, out: int, main: bool, inside: bool):
        self.path, self.text, self.out, self.main, self.inside = path, text, out, main, inside


class Element:
    """An open element: id of its path (a hash of its parent's and its own step), and what holds for the text in it."""

    __slots__ = ("barred", "chars", "inside", "main", "name", "named", "out", "parent", "path", "within")

    def __init__(self, name: str, path: int, parent: int, named: bool, out: int, main: bool, barred: bool, within: bool, inside: bool):
        self.name, self.path, self.parent, self.named, self.out = name, path, parent, named, out
        self.main, self.barred, self.within, self.inside, self.chars = main, barred, within, inside, 0


def _ends(page: str) -> dict[int, int]:
    """Where a tag that is open in front of a mark (quote or angle) ends, by the mark's place; found from the last to the first in one pass."""
    marks = [(m.start(), m.group()) for m in _MARK.finditer(page)]
    ends: dict[int, int] = {}
    after, quote = -1, {'"': None, "'": None}  # where the mark behind leads, and what follows the next quote of a kind
    for at, mark in reversed(marks):
        if mark in quote:
            here = quote[mark] if quote[mark] is not None else -1
            quote[mark] = after
        else:
            here = at if mark == ">" else -1
        ends[at] = after = here
    return ends


def _tokens(page: str) -> Iterator[tuple[str | None, str, str, str, str]]:
    """Raw element, slash, name, attributes and text of each token, in time linear in the page.

    A tag that is never closed is text. Only the first of these is searched for its end character by character; from
    then on the ends of all tags are known from one pass.
    """
    at, size, ends, marks = 0, len(page), None, None
    while at < size:
        if ends is not None and page[at] == "<" and (tag := _TAG.match(page, at)):
            mark = _MARK.search(page, tag.end())
            if mark is None or ends[mark.start()] < 0:
                yield None, "", "", "", "<"
                at += 1
                continue
        m = _TOKEN.match(page, at)
        if m is None:  # a tag without an end, or an angle that opens none
            if ends is None and _TAG.match(page, at):
                ends = _ends(page)
            yield None, "", "", "", "<"
            at += 1
            continue
        raw, slash, name, rest = m.groups()
        yield raw, slash or "", name or "", rest or "", "" if raw or name or m.group()[0] == "<" else m.group()
        at = m.end()


def parse(page: str, slot: int = 0) -> tuple[dict[int, list], list[Block]]:
    """Elements by id (times, characters of text, parent, depth, article or main, no slot by name), and the text blocks in page order."""
    opened = [Element("", 0, 0, False, 0, False, False, False, False)]
    many: Counter[str] = Counter()
    tags: dict[int, list] = {}
    blocks: list[Block] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            run.clear()
            if text:
                e = opened[-1]
                e.chars += len(text)
                blocks.append(Block(e.path, text, e.out, e.within, e.inside))

    def pop() -> None:
        e = opened.pop()
        many[e.name] -= 1
        tags[e.path][1] += e.chars
        if not e.named:  # text counts for each element that holds it with nothing ruled out between them
            opened[-1].chars += e.chars

    def close(to: int) -> None:
        flush()
        while len(opened) > to:
            pop()

    def open_(name: str, words: tuple[str, ...], named: bool, stays: bool = True) -> None:
        above = opened[-1]
        path, main, depth = _hash(f"{above.path}/{name}" + "".join("." + w for w in words)), name in _MAIN, len(opened)
        barred = above.barred or named
        tags.setdefault(path, [0, 0, above.path, depth, main, barred or name in _WITHIN])[0] += 1
        if stays:
            many[name] += 1
            opened.append(Element(name, path, above.path, named, depth if named else above.out, main, barred, above.within or main, above.inside or path == slot))

    for raw, slash, name, rest, text in _tokens(page):
        if raw:
            if raw.lower() not in ("svg", "math"):
                open_(raw.lower(), (), False, stays=False)
            continue
        if not name:
            if text:
                run.append(text)
            continue
        name = name.lower()
        if name in _INLINE:
            if not slash and name != "wbr":
                words = _words(rest) if rest else ()
                if any(w in _OUT_NAMES for w in words):
                    flush()
                    open_(name, words, True)
            elif slash and opened[-1].name == name:
                close(len(opened) - 1)
            continue
        flush()
        if slash:
            if many[name] > 0:
                while opened[-1].name != name:
                    pop()
                pop()
            continue
        shut = _CLOSES.get(name, frozenset())
        while len(opened) > 1 and (opened[-1].name in shut or (opened[-1].name == "p" and name in _ENDS_P)):
            pop()
        words = _words(rest) if rest else ()
        open_(name, words, _names_out(name, words), stays=name not in _VOID and not rest.endswith("/"))
    close(1)
    return tags, blocks


def _names_out(name: str, words: tuple[str, ...]) -> bool:
    """Whether an element holds no article text by its tag or a word of its class, id or role."""
    return name in _OUT_TAGS or (name not in ("html", "body", "article", "main") and any(w in _OUT_NAMES for w in words))


def _words(attributes: str) -> tuple[str, ...]:
    """Words of class, id and role; digits are dropped, as they number elements."""
    out: list[str] = []
    for m in _NAMED.finditer(attributes):
        out += [w for w in _SPLIT.split((m[2] or m[3] or m[4] or "").lower()) if w and not w.isdigit()]
    return tuple(out)


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) - (1 << 63)


def host_of(url: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


#: Kinds of counted tokens: elements, text blocks, and one token for each page that has any.
ELEMENT, TEXT, PAGE = 0, 1, 2
_COUNTED = ["host", "token", "kind", "parent", "depth", "main", "barred", "pages", "ones", "sig", "chars"]


def occurrences(pages: DataFrame) -> DataFrame:
    """Tokens of every host that stand on two pages or more, and one row (kind PAGE) for the host's pages.

    For each: pages that have it, pages that have it once, fingerprint of its vector, and text in characters.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[tuple, list] = {}
            for host, key, page in zip(b.column("host").to_pylist(), b.column("key").to_pylist(), b.column("html").to_pylist(), strict=True):
                tags, blocks = parse(page)
                if not tags and not blocks:
                    continue
                found = [(token, ELEMENT, above, depth, main, barred, n, chars) for token, (n, chars, above, depth, main, barred) in tags.items()]
                found += [(token, TEXT, 0, 0, False, False, n, 0) for token, n in Counter(_block(x) for x in blocks).items()]
                for token, kind, above, depth, main, barred, n, chars in [*found, (0, PAGE, 0, 0, False, False, 1, 0)]:
                    row = seen.setdefault((host, token, kind, above, depth, main, barred), [0, 0, 0, 0])
                    row[0] += 1
                    row[1] += n == 1
                    row[2] ^= _hash(f"{key} {n}")
                    row[3] += chars
            if seen:
                keys, rows = list(zip(*seen, strict=True)), list(zip(*seen.values(), strict=True))
                kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip([*keys, *rows], kinds, strict=True)], names=_COUNTED)

    rows = pages.select("host", "key", "html").mapInArrow(T.lean(own), "host string, token long, kind int, parent long, depth int, main boolean, barred boolean, pages long, ones long, sig long, chars long")
    fixed = [F.max(c).alias(c) for c in ("parent", "depth", "main", "barred")]
    total = rows.groupBy("host", "kind", "token").agg(*fixed, F.sum("pages").alias("pages"), F.sum("ones").alias("ones"), F.bit_xor("sig").alias("sig"), F.sum("chars").alias("chars"))
    return total.filter((F.col("pages") > 1) | (F.col("kind") == PAGE)).select(*_COUNTED)


def _block(b: Block) -> int:
    return _hash(f"#{b.path}#{b.text}")


def deduce(tokens: list[dict], pages: int) -> tuple[int, int, list[int]]:
    """Article slot (0 for none) and its depth, and template text blocks, from the tokens on two pages or more of a host."""
    wide = [t for t in tokens if 2 * t["pages"] >= pages and t["pages"] > 1]
    classes: dict[int, list[dict]] = {}
    for t in wide:
        classes.setdefault(t["sig"], []).append(t)
    placed = {t["token"] for t in wide if t["kind"] == ELEMENT} | {0}
    nested = [own for own in classes.values() if all(t["kind"] == TEXT or t["parent"] in placed for t in own)]
    valid = [t for own in nested for t in own]
    blocks = sorted(t["token"] for t in valid if t["kind"] == TEXT)
    elements = [t for t in valid if t["kind"] == ELEMENT and t["chars"] and 2 * t["ones"] >= pages]
    plain = [t for t in elements if not t["barred"]]
    # names do not reach into an article: one within a named element is taken where none stands outside
    named = [t for t in elements if t["main"] and t["barred"]]
    total = max((t["chars"] for t in plain), default=0)
    if named and max(t["chars"] for t in named) > total and not any(t["main"] for t in plain):
        plain, total = named, max(t["chars"] for t in named)
    inner = [t for t in plain if 10 * t["chars"] >= 7 * total]
    best = max(inner, key=lambda t: (t["main"], t["depth"], t["token"]), default=None)
    return (best["token"], best["depth"], blocks) if best else (0, 0, blocks)


def templates(pages: DataFrame) -> DataFrame:
    """host, slot with its depth, and template blocks of the hosts that have any."""
    tokens = cut(occurrences(pages))
    sizes = tokens.filter(F.col("kind") == PAGE).select(F.col("host").alias("s_host"), F.col("pages").alias("of"))
    # on at least half of a host's pages: at most twice the tokens of a page, however many pages
    wide = tokens.filter(F.col("kind") != PAGE).join(sizes, F.col("host") == F.col("s_host")).filter(2 * F.col("pages") >= F.col("of")).drop("s_host")

    def own(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        slot, depth, blocks = deduce(rows, rows[0]["of"])
        keep = bool(slot or blocks)
        return pa.table({"t_host": pa.array([rows[0]["host"]] * keep, pa.string()), "slot": pa.array([slot] * keep, pa.int64()), "depth": pa.array([depth] * keep, pa.int32()), "blocks": pa.array([blocks] * keep, pa.list_(pa.int64()))})

    return wide.groupBy("host").applyInArrow(T.lean_group(own), "t_host string, slot long, depth int, blocks array<long>")


def main_text(page: str | None, slot: int = 0, depth: int = 0, template: frozenset = frozenset()) -> str:
    """The article's blocks, joined by one space."""
    if not page:
        return ""
    _, blocks = parse(page, slot)
    kept = [b for b in blocks if not b.out]
    inside = []
    if slot:
        inside = [b for b in blocks if b.inside and b.out <= depth]
        # an article that holds most of the slot's text narrows it
        main = [b for b in inside if b.main]
        if 10 * sum(len(b.text) for b in main) >= 7 * sum(len(b.text) for b in inside):
            inside = main
    inside = inside or [b for b in kept if b.main]
    if template:
        inside = [b for b in inside if b.main or _block(b) not in template]
    return " ".join(b.text for b in (inside or ([] if any(x.main for x in blocks) else kept)))


def extract(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url and text of every row."""
    src = pages.select(F.col(page).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"), host_of(url).alias("host"))
    src = src.withColumn("key", F.xxhash64("page_id", "url", "html").cast("string"))
    found = cut(templates(src))
    n = found.count()
    side = F.broadcast(found) if n <= BROADCAST_HOSTS else found
    both = src.join(side, F.col("host") == F.col("t_host"), "left").select("page_id", "url", "html", "slot", "depth", "blocks")
    kind = src.schema["page_id"].dataType.simpleString()

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h, s or 0, d or 0, frozenset(t or ())) for h, s, d, t in zip(*(b.column(c).to_pylist() for c in ("html", "slot", "depth", "blocks")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return both.mapInArrow(T.lean(own), f"page_id {kind}, url string, text string")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
