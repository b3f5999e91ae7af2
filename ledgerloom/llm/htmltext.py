"""HTML main text by block rules in two passes.

A page is cut into blocks at block-level tags. The first pass decides what it can from a block's own
features and the containers around it: furniture (menus, headers, footers, sidebars, notices, adverts,
forms, comments), its share of linked characters, its share of stop words and its length; the thresholds are lower
inside the page's article and higher outside of it. A form or "header" that holds most of the page's text is no furniture, and of
scripts without known stop words length and links decide. Short blocks without a telling container are left open. The
second pass gives an open block the label of its nearest decided neighbours: both content, or one content and the
other at least not furniture. A short block inside the article is content unless it stands between the article's furniture.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

#: Frequent function words of the supported languages.
STOP_WORDS = frozenset(
    (
        "the of and to in is it that for on with as was at by be this are from or an have not his her they which you were their has had but all when there been one who will more no if out so what up "
        "de la le et les des en un une du est dans que qui pour par sur au avec ce il plus ne pas se son sont aux ou mais comme nous vous leur elle cette être "
        "el los las y del se por con una para su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien "
        "der die und das von zu mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde"
    ).split()
)
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
#: Tags whose content is no text of the page.
DROPPED = "script|style|noscript|template|svg|iframe|object|textarea|math|canvas"
FURNITURE_TAGS = frozenset("nav footer aside form menu select button dialog fieldset head title header".split())
FURNITURE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|banner|breadcrumbs?|comments?|comment-\w+|cookies?|consent|disclaimer|footer|form|header|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|pagination|popup|promo|promoted|related|respond|share|sharing|sidebar|signup|social|sponsor|sponsored|subscribe|subscription|toolbar|widget)s?(?:[\s_-]|$)",
    re.I,
)
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
COMMENT = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)", re.S)
#: What stands in a tag: a quoted value may hold anything, what is not quoted no other tag's beginning. So a scan that fails ends at the next tag.
INSIDE = r"""(?:[^<>"']|"[^"]*"|'[^']*')*"""
RAW = re.compile(rf"<({DROPPED})\b{INSIDE}>.*?(?:</\1\s*>|$)", re.S | re.I)
TAG = re.compile(rf"<(/?)([a-zA-Z][^\s/<>]*)({INSIDE})>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
NAMED = re.compile(r"\b(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
ROLE = re.compile(r"\brole\s*=\s*[\"']?([\w-]+)", re.I)
HIDDEN = re.compile(r"\bhidden\b|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
#: Characters under which a block is short; shares of stop words and of linked characters that decide.
SHORT, STOP_LOW, STOP_HIGH, LINKED = 70, 0.10, 0.20, 0.5
#: Wrappers that may hold a whole page, and the share of the page's text from which they are taken to.
WRAPPERS, MOST = re.compile(r"(?:^|[\s_-])(?:form|header)s?(?:[\s_-]|$)", re.I), 0.6
#: The last character of the Latin alphabets; words of others are not among the stop words.
LATIN = "\u024f"


class Block:
    __slots__ = ("text", "linked", "furniture", "article", "wrapper", "label")

    def __init__(self, text: str, linked: int, furniture: bool, article: bool, wrapper: int = 0):
        """wrapper: the number of the form or header that alone makes the block furniture, or 0."""
        self.text, self.linked, self.furniture, self.article, self.wrapper, self.label = text, linked, furniture, article, wrapper, ""


def furniture(tag: str, attrs: str, in_article: bool) -> bool:
    """Whether an element holds page furniture. An article's own header is content."""
    if tag in FURNITURE_TAGS and not (tag == "header" and in_article):
        return True
    if not attrs:
        return False
    if (role := ROLE.search(attrs)) and role[1].lower() in FURNITURE_ROLES and not (role[1].lower() == "banner" and in_article):
        return True
    if tag not in ("article", "main", "body", "html") and any(FURNITURE_NAMES.search(a or b or c) for a, b, c in NAMED.findall(attrs)):
        return True
    return bool(HIDDEN.search(attrs))


def may_wrap(tag: str, attrs: str) -> bool:
    """Whether furniture is so by its name as a form or header only, and may hold a whole page."""
    names = [a or b or c for a, b, c in NAMED.findall(attrs)]
    if tag != "form" and (tag in FURNITURE_TAGS or not any(map(WRAPPERS.search, names))):
        return False
    rest = [WRAPPERS.sub(" ", WRAPPERS.sub(" ", x)) for x in names]
    return not any(map(FURNITURE_NAMES.search, rest)) and not furniture("div", NAMED.sub(" ", attrs), False)


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, with the containers' evidence."""
    page = RAW.sub(" ", COMMENT.sub("", page))
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, int]] = []  # open element, furniture, article, wrapper
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked, anchors, at, wrappers = 0, 0, 0, 0
    last = page.rfind(">") + 1  # no tag ends behind it

    def close() -> None:
        nonlocal parts, linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, linked, *(stack[-1][1:] if stack else (False, False))))
        parts, linked = [], 0

    for m in TAG.finditer(page, 0, last):
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            linked += len(piece.strip()) if anchors else 0
        at = m.end()
        end, tag, attrs = (m[1], m[2].lower(), m[3]) if m[2] else (m[4], m[5].lower(), m[6])
        if tag == "a":
            anchors = max(0, anchors - 1) if end else anchors + 1
            continue
        if tag in BLOCKS:
            close()
        if tag in VOID or attrs.endswith("/") and attrs[-2:-1] in ("", " ", "\t", "\n", "'", '"'):
            continue
        if end:
            if not opened[tag]:
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag not in BLOCKS:  # inline furniture is a block of its own
                        close()
                    opened.subtract(x[0] for x in stack[i:])
                    del stack[i:]
                    break
        elif tag in BLOCKS and tag != "p" or furniture(tag, attrs, False):
            if tag not in BLOCKS:
                close()
            over, inside, wrapper = stack[-1][1:] if stack else (False, False, 0)
            own = furniture(tag, attrs, inside)
            if own and not over and may_wrap(tag, attrs):
                wrappers += 1
                wrapper = wrappers
            elif own:
                wrapper = 0
            stack.append((tag, over or own, inside or tag in ("article", "main"), wrapper))
            opened[tag] += 1
    if at < len(page):
        parts.append(page[at:])
    close()
    return out


def classify(found: list[Block]) -> None:
    """Set every block's label to content or furniture."""
    held: Counter[int] = Counter()
    for b in found:
        held[b.wrapper] += len(b.text) - b.linked
    page = max(1, sum(held.values()))
    for b in found:
        if b.wrapper and held[b.wrapper] > MOST * page:
            b.furniture = False
    has_article = any(b.article and not b.furniture for b in found)
    for b in found:
        words = b.text.split()
        stops = sum(w.strip(".,;:!?\"'()").lower() in STOP_WORDS for w in words) / max(1, len(words))
        if stops < STOP_LOW and 2 * sum(c > LATIN for c in b.text) > len(b.text):
            stops = STOP_HIGH  # no word of these scripts is known: length and links decide
        outside = has_article and not b.article
        if b.furniture or b.linked > LINKED * len(b.text) or "©" in b.text and not b.article:
            b.label = "furniture"
        elif b.article:
            b.label = "content" if len(b.text) >= SHORT and stops >= STOP_LOW else "held"
        elif len(b.text) < (2 * SHORT if outside else SHORT):
            b.label = "open"
        elif stops >= STOP_HIGH:
            b.label = "content"
        elif stops >= STOP_LOW:
            b.label = "likely"
        else:
            b.label = "furniture"
    before, after = nearest(found), nearest(found[::-1])[::-1]
    for b, near in zip(found, zip(before, after)):
        if b.label in ("open", "likely", "held"):
            around = set(near)
            if b.label == "held":
                b.label = "content" if around != {"furniture"} else "furniture"
            elif b.label == "likely":
                b.label = "content" if around != {"furniture"} else "furniture"
            else:
                b.label = "content" if "content" in around and "furniture" not in around else "furniture"


def nearest(found: list[Block]) -> list[str]:
    """The last decided label before each block; edge if there is none. A held block does not look beyond its article."""
    out, label, inside = [], "edge", "edge"
    for b in found:
        out.append(inside if b.label == "held" else label)
        decided = b.label in ("content", "furniture")
        label = b.label if decided else label
        inside = "edge" if not b.article else b.label if decided else inside
    return out


def main_text(page: str | None) -> str:
    """The content blocks of one page, joined by empty lines."""
    found = blocks(page or "")
    classify(found)
    return "\n\n".join(b.text for b in found if b.label == "content")


def extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, "html"):
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """Per row of pages: page_id, url, text (the main text, empty if there is none) and n_chars (its code points).

    Null and empty html, and pages without a main text, give an empty text; null page_ids and urls stay null. Row for row: repeated
    rows have equal values. Columns of pages but page_id, url and html are not read. A page's time grows with its length alone.
    """
    found = pages.select("page_id", "url", "html").mapInArrow(extract_batches, "page_id long, url string, text string")
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
