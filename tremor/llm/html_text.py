"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags.  The first pass decides a block by its place
(menus, headers, footers, sidebars, forms and the like, or a container so named, are never main
text), its link density, and for the rest its length and its density of stop words.  The last
decides only where it knows the language: a long block is main text if most of its letters aren't
Latin ones, or if the page's long blocks together have hardly any listed stop word.  Short
blocks stay open.  In the second pass an open block takes the label of its nearest decided
neighbours: of both if they agree, else of the nearer one (not main text if none is); if only
one side has any, of that; on a page where nothing is decided it is main text.  Blocks that only their
place decides end the text, but don't vote; a long block that merely lacks stop words votes for nothing
and is main text between main text.  An open block
inside an article or main element is main text, for what else such elements hold is marked.  Headings go
with the first decided block after them.

Character references are decoded as browsers do, white space inside a block becomes one space,
blocks are trimmed, empty ones go, and the rest are joined by one line feed in page order.
Null and empty pages give an empty text; a null page_id or url stays null; repeated rows are
each extracted; broken markup is read as far as it goes (an unclosed tag at the end is
dropped); further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import hands, mapped, record

# Element names of HTML by their role.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul""".split())
HIDDEN = frozenset("script style noscript template textarea title svg math iframe object select option button canvas head audio video".split())
RAW = frozenset("script style textarea title noscript iframe".split())
ASIDE = frozenset("nav footer aside form menu dialog fieldset search".split())
MAIN = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# What a head may hold: anything else ends it, for its own end tag may be left out.
IN_HEAD = frozenset("base head html link meta noscript script style template title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# A new one of these ends an open one.
ENDS_ITSELF = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = BLOCKS - {"html", "body", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "dt", "dd", "legend", "summary", "title", "figcaption"}

# Parts of class and id names that mark what is not main text, unless a name begins by saying that an element has it or not.
MARKED = re.compile(r"(?!has[-_]|no[-_]|with[-_]|without[-_])(?:[a-z0-9]+[-_]+)*(?:ads?|advert\w*|banner|breadcrumbs?|comments?|commentlist|cookies?|consent|disqus|footer|"
                    r"header|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|pager|pagination|popup|promo\w*|related|replies|respond|share|sharing|"
                    r"sidebar|signup|skip|social|sponsor\w*|subscribe|toolbar|widgets?)(?:[-_]+[a-z0-9]+)*")
# Parts of a name that say how a page is laid out: beside them the others name a layout, not a part of the page,
# or a container whose article is main text all the same.
LAYOUT = frozenset("layout template theme".split())
AROUND = frozenset("col column columns grid left page right row two three with wrap wrapper".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

# Frequent words of the languages that the stop-word rule knows.
STOPS = frozenset("""a an and are as at be been but by for from had has have he her his i if in is it its not of on or our she so that the their they this to was we were
which will with you
au aux avec ce ces dans de des du elle en est et eux il ils je la le les leur lui mais ne nous on ou par pas pour qu que qui sa se ses son sur un une vous
aber als am an auch auf aus bei bin bis da das dem den der des die du ein eine einer er es für hat ich im in ist mit nach nicht noch nur oder sich sie sind so um und von vor
war wie wir zu zum zur
al como con de del el en es esta este la las lo los más no o para pero por que se si sin sobre su sus un una y
che di e gli il non per una""".split())

LINKED = 0.5          # link density from which a block is not main text
LONG = 70             # characters of a block that is decided
VERY_LONG = 200
STOP_LOW, STOP_HIGH = 0.10, 0.25

_OPENER = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z]|/)")
_NAME = re.compile(r"[^\s/>]+")
_STOP = re.compile(r">|=\s*([\"'])")
_COMMENT_END = re.compile(r"--!?>")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_HREF = re.compile(r"(?<![\w-])href\s*=", re.I)
_PARTS = re.compile(r"[-_]+")
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    linked: int
    place: str  # "aside", "around", "main" or ""
    heading: bool
    main: bool | None = None


def _place(name: str, attributes: str, outer: str) -> str:
    """What the content of an element is for: inherited, unless the element says otherwise."""
    if outer == "hidden" or (outer == "aside" and name != "main") or (outer == "around" and name not in MAIN):
        return "hidden" if name in HIDDEN else outer
    if name in HIDDEN:
        return "hidden"
    found = {}
    if attributes:
        found = {k.lower(): (v or "").strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""):
        return "hidden"
    if name in ASIDE or (name == "header" and outer != "main") or found.get("role") in ROLES:
        return "aside"
    if name in ("html", "body"):
        return outer
    if name in MAIN or found.get("role") == "main":
        return "aside" if name == "article" and "comment" in found.get("class", "") else "main"
    if name in HEADINGS or (name == "header" and outer == "main"):
        return outer
    return _named(f"{found.get('class', '')} {found.get('id', '')}".split()) or outer


def _named(names: list[str]) -> str:
    """The place that class and id names give: ``aside``, or ``around`` if an article inside is main text all the same."""
    places = set()
    for name in filter(MARKED.fullmatch, names):
        parts = set(_PARTS.split(name))
        if not parts & LAYOUT:
            places.add("around" if parts & AROUND else "aside")
    return "aside" if "aside" in places else "around" if places else ""


def tags(page: str):
    """Text and tags in order: ``(text, name, closes, attributes)``, the name None after the last text.

    Each character is looked at a bounded number of times, however broken the markup is.
    """
    at, end = 0, len(page)
    last_quote = {q: page.rfind(q) for q in "\"'"}
    while at < end:
        m = _OPENER.search(page, at)
        if m is None:
            break
        before = page[at:m.start()]
        if m[0] == "<!--":
            stop = _COMMENT_END.search(page, m.end() - 2)
            at = stop.end() if stop else end
            yield before, "", False, ""
            continue
        stop = m.end()
        while True:  # the end of the tag, over quoted values
            found = _STOP.search(page, stop)
            if found is None:
                stop = -1
                break
            if found[1] is None:
                stop = found.start()
                break
            stop = page.find(found[1], found.end()) + 1 if found.end() <= last_quote[found[1]] else 0
            if not stop:
                stop = page.find(">", found.end())
                break
        if stop < 0:
            yield before, None, False, ""
            return
        at = stop + 1
        if not m[0][-1].isalpha():
            yield before, "", False, ""
            continue
        name = _NAME.match(page, m.end() - 1)
        yield before, name[0].lower(), m[0][1] == "/", page[name.end():stop]
        if name[0].lower() in RAW and m[0][1] != "/":
            # Its content is no markup: go on after its end tag.
            close = re.compile(rf"</{name[0]}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
    yield page[at:], None, False, ""


def blocks(page: str) -> list[Block]:
    """The page's visible blocks in order."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []  # open block elements, and inline ones that matter, with their places
    open_: Counter = Counter()
    parts: list[str] = []
    linked: list[str] = []
    in_link, place = False, ""

    def close() -> None:
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(Block(text, len(_SPACE.sub(" ", html.unescape("".join(linked))).strip()), place, any(open_[h] for h in HEADINGS)))
        parts.clear()
        linked.clear()

    def pop_to(depth: int) -> None:
        nonlocal place
        while len(stack) > depth:
            open_[stack.pop()[0]] -= 1
        place = stack[-1][1] if stack else ""

    for text, name, closes, attributes in tags(page):
        if open_["head"] and stack[-1][0] == "head" and text.strip():
            pop_to(len(stack) - 1)
        if text and place != "hidden":
            parts.append(text)
            if in_link:
                linked.append(text)
        if not name or name in RAW:
            if name in BLOCKS:
                close()
            continue
        block = name in BLOCKS
        if block:
            close()
        if name == "a":
            in_link = not closes and _HREF.search(attributes) is not None
        elif block and not closes:
            in_link = False
        if open_["head"] and not closes and name not in IN_HEAD:
            pop_to(next(i for i, (n, _) in enumerate(stack) if n == "head"))
        if closes:
            if open_[name]:
                depth = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name)
                pop_to(depth)
            continue
        if name in VOID:
            if name == "br" and place != "hidden":
                parts.append(" ")
            continue
        if block:
            ends = ENDS_ITSELF.get(name, set()) | ({"p"} if name in ENDS_P else set())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    pop_to(i)
                    break
                if stack[i][0] in BLOCKS:
                    break
        inner = _place(name, attributes, place)
        if name in HIDDEN and attributes.endswith("/"):
            continue
        if block or inner != place or open_[name]:
            if inner != place:
                close()
            stack.append((name, inner))
            open_[name] += 1
            place = inner
    close()
    return out


def _outside(block: Block) -> bool:
    return block.place in ("aside", "around") or block.linked > LINKED * len(block.text)


def _stops(text: str) -> tuple[int, int]:
    """Stop words and words."""
    words = [w.strip(".,;:!?\"'()").lower() for w in text.split()]
    return sum(w in STOPS for w in words), len(words)


def _latin(text: str) -> bool:
    """Whether most letters are Latin ones."""
    letters = [c for c in text if c.isalpha()]
    return 2 * sum(c < "\u0250" or "\u1e00" <= c <= "\u1eff" for c in letters) >= len(letters)


def known_language(found: list[Block]) -> bool:
    """Whether the long Latin blocks that may be main text hold listed stop words as a listed language does."""
    counts = [_stops(b.text) for b in found if len(b.text) >= LONG and not b.heading and not _outside(b) and _latin(b.text)]
    return sum(c[0] for c in counts) >= STOP_LOW * sum(c[1] for c in counts)


def decide(block: Block, known: bool = True) -> bool | None:
    """The first pass: main text, not main text, or open.  ``known`` tells whether the page's language has stop words here."""
    length = len(block.text)
    if _outside(block):
        return False
    if block.heading or length < LONG:
        return None
    if block.place == "main":
        return True  # long, few links, and in the element that is meant to hold the text
    if not known or not _latin(block.text):
        return True  # long, few links, and no stop word to be expected
    stops, words = _stops(block.text)
    density = stops / words
    if density >= STOP_HIGH or (density >= STOP_LOW and length >= VERY_LONG):
        return True
    return None if density >= STOP_LOW else False


def _nearest(decided: list[bool]) -> tuple[list[int | None], list[int | None]]:
    """For each place, the last decided one before it and the first after it."""
    sides = []
    for places in (range(len(decided)), range(len(decided) - 1, -1, -1)):
        side, last = [None] * len(decided), None
        for i in places:
            side[i] = last
            last = i if decided[i] else last
        sides.append(side)
    return sides[0], sides[1]


def label(found: list[Block]) -> None:
    """Both passes; sets ``main`` of every block."""
    known = known_language(found)
    first = [decide(b, known) for b in found]
    # A long block that only lacks stop words decides nothing; between main text on both sides it is main text.
    doubtful = [d is False and not _outside(b) for d, b in zip(first, found, strict=True)]
    first = [None if x else d for d, x in zip(first, doubtful, strict=True)]
    # Neighbours are the nearest that their own text or links decide; what a container marks only ends there.
    before, after = _nearest([d is not None and b.place not in ("aside", "around") for d, b in zip(first, found, strict=True)])
    for i, b in enumerate(found):
        if first[i] is not None:
            b.main = first[i]
        elif b.place == "main":
            b.main = True
        elif doubtful[i]:
            b.main = None not in (before[i], after[i]) and bool(first[before[i]] and first[after[i]])
        elif b.heading:
            b.main = bool(after[i] is not None and first[after[i]])
        else:
            left, right = before[i], after[i]
            if left is None and right is None:
                b.main = True  # nothing on the page is decided
            elif left is None or right is None:
                b.main = bool(first[right if left is None else left])
            elif first[left] == first[right]:
                b.main = bool(first[left])
            else:
                b.main = bool(first[left] and i - left < right - i) or bool(first[right] and right - i < i - left)


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    label(found)
    return "\n".join(b.text for b in found if b.main)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for batch in hands(batches, "html"):
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield record(schema, page_id=batch.column("page_id"), url=batch.column("url"), text=texts, n_chars=[len(t) for t in texts])

    return mapped(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")
