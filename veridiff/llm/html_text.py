"""Main text of web pages by two-pass block rules.

A page is cut into blocks (what stands between block-level tags).  The first pass decides each block by itself: menus,
headers, footers, sidebars, notices, adverts, forms and reader comments that markup declares (element, role, class or id) and
blocks of links are bad, long blocks dense in stop words are good, the rest, mostly short blocks, is ambiguous.  Where most
long blocks lack stop words (other languages, code, tables) these say nothing, and length decides; so it does between prose.
Containers such as ``article`` count where the prose that the first pass found stands in them: then all outside is furniture.
In the second pass ambiguous blocks take the label of the nearest decided one; in an article, of one of its own.

A class or id names boilerplate by its first or last word, unless it tells what else the page has (has-sidebar).  Headings are
never named so, and inside an article neither are paragraphs nor ids of its parts, save for a few sure words.  If nothing is
left of a page, articles inside containers that only their names (or a form) made boilerplate are its text.

Whole pages are read.  Null or empty html gives an empty text; broken markup is read as browsers do: open tags close with
their parents, a tag that the page's end cuts off is dropped.  Repeated rows are extracted each; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidy

LINKED = 0.5  # from this share of linked characters on a block is a menu
DENSE = 0.18  # from this share of stop words on a block is prose
SHORT = 60  # shorter blocks are ambiguous

#: Frequent function words.
STOP_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he i this are or his from at which but have an had they you were their one all we can her has there been if more when will would who so no",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec on ou mais comme son sa ses cette aux nous elle été leur être y ont d l",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta",
}
_STOPS = {k: frozenset(v.split()) for k, v in STOP_WORDS.items()}
_ANY_STOPS = frozenset().union(*_STOPS.values())

#: Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIP = frozenset("head script style noscript template iframe object svg math canvas audio video select textarea button title map".split())
RAW = frozenset("script style textarea title iframe noscript template".split())
BOILER = frozenset("nav footer aside form dialog menu fieldset".split())
MAIN = frozenset("article main".split())
LISTS = frozenset("li ul ol dl td".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
ROLES = frozenset("navigation banner complementary contentinfo search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of class and id attributes that name boilerplate, and those that name the article.
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense adslot banner sponsor sponsored promo promotion nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar aside rail footer foot header masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login signin register comment comments commentlist disqus reply replies respond discussion share sharing social related recommended recommendations similar pagination pager tags tagcloud widget widgets copyright legal disclaimer search searchbox skip".split()
)
SURE_WORDS = frozenset("adsense breadcrumb breadcrumbs commentlist comments cookie cookies disqus gdpr navbar newsletter pagination respond sidebar".split())
OPEN_WORDS = frozenset("alert disclaimer discussion legal notice notices search".split())  # also name parts of articles
MODIFIERS = frozenset("has have with without no not is".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
PROSE = frozenset("p pre blockquote figcaption caption legend summary".split())
MAIN_WORDS = frozenset("article articlebody content maincontent post postcontent entry entrycontent story storybody body main text prose".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_PARTS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORDS = re.compile(r"[^\W\d_]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_STRONG = re.compile(r"\b(?:role\s*=\s*[\"']?main|itemprop\s*=\s*[\"']?articlebody)\b", re.I)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW}


@dataclass
class Block:
    text: str
    linked: int
    boiler: bool
    main: int  # number of the article-like container, 0 for none
    listed: bool = False  # stands in a list or table cell
    label: str = ""
    late: str = ""  # label of the second pass
    wrapped: bool = False  # boilerplate only by names of containers around its article


def _names(value: str) -> set[str]:
    """Words of a class or id, and their neighbours joined (side-bar, sideBar)."""
    out: set[str] = set()
    for name in value.split():
        parts = _PARTS.findall(_CAMEL.sub("-", name).lower())
        out.update(parts)
        out.update(a + b for a, b in zip(parts, parts[1:]))
    return out


def _heads(value: str) -> set[str]:
    """First and last words of the names in a class or id, of one word or two joined; none of has-sidebar and the like."""
    out: set[str] = set()
    for name in value.split():
        parts = _PARTS.findall(_CAMEL.sub("-", name).lower())
        if parts and not MODIFIERS & set(parts[:-1]):
            out |= {parts[0], parts[-1], "".join(parts[:2]), "".join(parts[-2:])}
    return out


def _boiler_name(tag: str, a: dict[str, str], inside_main: bool) -> bool:
    """Whether class or id name an element as boilerplate."""
    if tag in ("body", "html") or tag in HEADINGS or tag in PROSE and inside_main:
        return False
    by_class, by_id = _heads(a.get("class", "")), _heads(a.get("id", ""))
    if inside_main:
        by_class -= OPEN_WORDS | {"header"}  # an article's own header holds its title
        return bool(by_class & BOILER_WORDS or by_id & SURE_WORDS)
    words = by_class | by_id
    return bool((words - OPEN_WORDS if tag in PROSE else words) & BOILER_WORDS)


def _role(tag: str, attrs: str, inside_main: bool) -> str:
    """'skip', 'boiler', 'named' (boilerplate by name only), 'main' or '' for an element."""
    if tag in SKIP:
        return "skip"
    if tag in BOILER - {"form"} or tag == "header" and not inside_main:
        return "boiler"
    role = "main" if tag in MAIN else ""
    if attrs.strip():
        a = {k.lower(): x or y or z for k, x, y, z in _ATTR.findall(attrs)}
        if _HIDDEN.search(a.get("style", "")) or a.get("aria-hidden", "").lower() == "true" or re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attrs)):
            return "skip"
        if a.get("role", "").lower() in ROLES:
            return "boiler"
        if not role and _boiler_name(tag, a, inside_main):
            return "named"
        names = _names(f"{a.get('class', '')} {a.get('id', '')}")
        if a.get("role", "").lower() == "main" or a.get("itemprop", "").lower() == "articlebody" or tag in ("div", "section", "td") and names & MAIN_WORDS:
            role = "main"
    return "named" if tag == "form" and not role else role


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, str, int]] = []  # element, role, number of the container
    buffer: list[str] = []
    linked = 0
    anchors = mains = 0

    def state() -> tuple[bool, bool, int, bool]:
        skip = boiler = strict = False
        main = 0
        for _, role, number in stack:
            skip |= role == "skip"
            boiler |= role in ("boiler", "named")
            strict |= role == "boiler" or role == "named" and main > 0
            main = number or main
        return skip, boiler, main, boiler and not strict and main > 0

    skip, boiler, main, wrapped = False, False, 0, False

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                out.append(Block(text, linked, boiler, main, any(t in LISTS for t, _, _ in stack), wrapped=wrapped))
        linked = 0

    def put(text: str) -> None:
        nonlocal linked
        if not skip and text:
            text = _html.unescape(text) if "&" in text else text
            buffer.append(text)
            if anchors:
                linked += len("".join(text.split()))

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            put(page[at:])
            break
        if m.start() > at:
            put(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                anchors = max(0, anchors - 1)
            if tag == "br":
                buffer.append(" ")
            elif tag in BLOCK or tag in SKIP:
                if tag in BLOCK:
                    flush()
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                skip, boiler, main, wrapped = state()
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else n
            continue
        if tag == "a":
            anchors += 1
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag in ("img", "wbr", "input"):
                pass
            continue
        if tag in BLOCK or tag in SKIP:
            if tag in BLOCK:
                flush()
                anchors = anchors if tag not in MAIN else 0
            if tag in MAIN and not any(r == "main" for _, r, _ in stack):
                # an article does not stand in a menu or header: those were left open
                stack = [x for x in stack if x[1] not in ("boiler", "named", "skip")]
            if tag == "body":
                stack = [x for x in stack if x[0] != "head"]
            if tag in ("p", "li", "tr", "td", "th", "dt", "dd") and stack and stack[-1][0] == tag:
                stack.pop()
            role = _role(tag, m[3], main > 0 or any(r == "main" for _, r, _ in stack))
            if role == "main":
                if tag not in MAIN and _STRONG.search(m[3]) and not any(r == "main" for _, r, _ in stack):
                    stack = [x for x in stack if x[1] not in ("boiler", "named")]
                mains += 1
            stack.append((tag, role, mains if role == "main" else 0))
            skip, boiler, main, wrapped = state()
    flush()
    return out


def classify(found: list[Block], lang: str = "") -> list[Block]:
    """Both passes; labels become 'good' or 'bad'."""
    _passes(found, lang)
    if all(b.label == "bad" for b in found) and any(b.wrapped for b in found):
        for b in found:
            b.boiler &= not b.wrapped
        _passes(found, lang)
    return found


def _passes(found: list[Block], lang: str) -> None:
    stops = _STOPS.get(lang[:2].lower(), _ANY_STOPS)
    for b in found:
        b.label = _decide(b, stops)
    _unread(found)
    inside = _place(found)
    _inherit(found, inside)


def _decide(b: Block, stops: frozenset[str]) -> str:
    """First pass, each block by itself: link density, length, stop-word density; '' is ambiguous."""
    if b.boiler or b.linked >= LINKED * max(1, len("".join(b.text.split()))) and (b.listed or not b.main):
        return "bad"  # a linked heading or paragraph of an article is no menu
    if len(b.text) < SHORT:
        return ""
    words = _WORDS.findall(b.text.lower())
    return "good" if sum(w in stops for w in words) >= DENSE * max(1, len(words)) else ""


def _unread(found: list[Block]) -> None:
    """Where most long text lacks stop words they say nothing, and length decides; so it does between blocks of prose."""
    long = [b for b in found if b.label != "bad" and len(b.text) >= SHORT]
    informative = 2 * sum(len(b.text) for b in long if b.label) >= sum(len(b.text) for b in long)
    good = [k for k, b in enumerate(found) if b.label == "good"]
    for k, b in enumerate(found):
        if not b.label and len(b.text) >= SHORT and (not informative or good and good[0] < k < good[-1]):
            b.label = "good"


def _place(found: list[Block]) -> bool:
    """Whether containers hold the text: the decided prose must stand in them.  What is outside is then furniture; teasers and
    containers without prose count as plain blocks."""
    good: dict[int, int] = {}
    for b in found:
        if b.label == "good":
            good[b.main] = good.get(b.main, 0) + len(b.text)
    outside, held = good.pop(0, 0), sorted({b.main for b in found if b.main and not b.boiler})
    prose = sum(good.values())
    inside = bool(held) and (outside <= prose or len(held) == 1 and prose > 0)
    for b in found:
        if inside and not b.main:
            b.label = "bad"
    return inside


def _inherit(found: list[Block], inside: bool) -> None:
    """Second pass: ambiguous blocks take the label of the nearest decided one, good ones first at equal distance.  In an
    article only its own blocks count, and not the adverts and the like that stand between them."""
    decided = [(k, b) for k, b in enumerate(found) if b.label]
    for k, b in enumerate(found):
        if not b.label:
            near = [(abs(k - j), x.label != "good", x.label) for j, x in decided if not inside or x.main == b.main and not x.boiler]
            late = "good" if inside or b.main or len(b.text) >= SHORT else "bad"
            b.late = min(near)[2] if near else late
    for b in found:
        b.label = b.label or b.late


_LANG = re.compile(r"<html[^>]*\blang\s*=\s*[\"']?([a-zA-Z]+)", re.I)


def main_text(page: str | None) -> str:
    if not page:
        return ""
    m = _LANG.search(page)
    return " ".join(b.text for b in classify(blocks(page), m[1] if m else "") if b.label == "good")


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` with text and n_chars (code points) of every row."""
    small_batches(pages.sparkSession)
    rows = pages.select(*keep, F.col(html).alias("_html"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    return rows.mapInArrow(tidy(run), schema)
