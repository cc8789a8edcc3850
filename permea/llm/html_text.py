"""Main text of HTML pages by the line-block distribution.

Markup is stripped to lines (one per block, and one empty line for any run of
tags between two), the text lengths are summed over sliding windows of
``WINDOW`` lines, and the text between a surge (a window rises over the
threshold) and the following dive (the windows fall to nothing) is kept.  A
surge needs ``THRESHOLD`` characters in a window; on a page where no window has
as many, its densest windows are the surges; there and inside articles the text
before a surge, too, is kept back to a dive.  Lines inside menus, headers, footers, sidebars, notices,
adverts, forms and reader comments, and the text of links, have no length; class
names tell such places only on containers, not on paragraphs, headings, entries,
cells or inline elements.  On a page that declares an article, only its lines
have length, and short blocks between kept ones are kept.

Defined cases: NULL or empty html and pages without main text give an empty
text; broken or cut markup is read as far as it goes; every page row gives one
row, repeated or not; very long pages are read whole.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from permea.llm.common import slices

WINDOW = 3
THRESHOLD = 86

#: Elements whose content is never text of the page.
_HIDDEN = "script|style|head|noscript|template|svg|math|iframe|object|canvas|audio|video|textarea|select|title"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<({_HIDDEN})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)",
    re.S | re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q "
                    "rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_SIDE = frozenset("nav footer aside form button menu dialog fieldset input option".split())
_ROLE = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SIDE_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|nav\w*|menu\w*|"
    r"breadcrumbs?|side-?bar|aside|footer|header|masthead|comments?|commentlist|disqus|respond|replies|reply|related|"
    r"recommended|share|sharing|social|newsletter|subscribe|signup|login|search|popup|modal|overlay|widget|toolbar|"
    r"pagination|complementary|contentinfo)(?:$|[\s_-])", re.I)
#: Elements of one block of text: their names say nothing about a part of the page.
_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th tbody thead tfoot caption blockquote pre figure figcaption address "
                   "body html article main".split())
#: Names of wrappers that only tell what stands beside the text.
_BESIDE = re.compile(r"(?:^|(?<=\s))(?:has|with|without|no)[_-][\w-]*", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """(text, length that counts, inside an article) of each line of a page."""
    out: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    state = {"linked": 0, "text": 0}
    article = link = 0
    side = ""  # name of the side element we are in, and how deep
    depth, named = 0, False

    def text(raw: str) -> None:
        if raw:
            raw = _html.unescape(raw) if "&" in raw else raw
            if not side:
                parts.append(raw)
                n = len("".join(raw.split()))
                state["text"] += n
                state["linked"] += n if link else 0

    def end_line() -> None:
        if parts:
            words = " ".join("".join(parts).split())
            parts.clear()
            linked = state["linked"] * 2 > state["text"] and not article
            out.append((words, 0 if linked else len(words), article > 0))
            state["linked"] = state["text"] = 0
        elif not out or out[-1][0] or out[-1][2] != (article > 0):
            out.append(("", 0, article > 0))

    at = 0
    for m in _TOKEN.finditer(page):
        text(page[at:m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name, close = name.lower(), m[2] == "/"
        if side:
            if name == side:
                depth += -1 if close else 1
                if depth <= 0:
                    side = ""
                    end_line()
            elif named and name in ("main", "h1") and not close:
                side = ""  # a wrapper of the page, not a part beside its text
            if side or name == "p" and close:
                continue
        if name in _INLINE:
            if name == "a":
                link = 0 if close else 1
            elif name == "br":
                parts.append(" ")
            continue
        end_line()
        link = 0
        if close:
            article -= name in ("article", "main") and article > 0
        elif name in _VOID:
            continue
        elif name in _SIDE or name == "header" and not article:
            side, depth, named = name, 1, False
        elif (name not in _BLOCK or name == "article" and article) and _named_side(m[4]):
            side, depth, named = name, 1, True
        else:
            article += name in ("article", "main")
    text(page[at:])
    end_line()
    return out


def _named_side(attributes: str) -> bool:
    return "=" in attributes and any(_SIDE_NAME.search(_BESIDE.sub("", a or b or c)) for a, b, c in _ROLE.findall(attributes))


def main_text(page: str | None, window: int = WINDOW, threshold: int = THRESHOLD) -> str:
    if not page:
        return ""
    lines = lines_of(page)
    declared = any(n and inside for _, n, inside in lines)
    lengths = [n if inside or not declared else 0 for _, n, inside in lines]
    total, sums = 0, []  # sums[i]: lines i to i + window - 1
    for i, n in enumerate(lengths):
        total += n - (lengths[i - window] if i >= window else 0)
        if i >= window - 1:
            sums.append(total)
    if not sums:
        sums = [total]
    low = max(sums) < threshold  # a short page
    least = max(1, min(threshold, max(sums)))
    keep = bytearray(len(lines))
    i = start = 0  # start: where the windows last rose from nothing
    while i < len(sums):
        if sums[i] >= least:  # a surge
            end = i
            while end < len(sums) and sums[end] > 0:  # to the dive
                end += 1
            for k in range(start if low or declared else i, min(len(lines), end + window - 1)):
                keep[k] = 1
            i = end
        if i < len(sums) and sums[i] == 0:
            start = i + 1
        i += 1
    if declared and any(keep):
        first, last = keep.index(1), keep.rindex(1)
        keep[first:last] = b"\1" * (last - first)
    return "\n".join(t for (t, _, _), n, k in zip(lines, lengths, keep, strict=True) if k and n and t)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(x) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op2_line_block(spark, sf_dir: str) -> DataFrame:
    from permea.llm.common import table
    return extract_main_text(table(spark, sf_dir, "pages"))
