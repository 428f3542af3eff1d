"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block element, with character references decoded and white space
collapsed. A line's weight is its text length, shaped by its markup. It is 0 for lines of navigation, headers, footers,
asides, forms, adverts, notices and reader comments (by element, role or class); for runs of two or more lines that are
mostly links, headings apart; and for lines under SURGE characters that are in no paragraph, heading, list or table, on
a page that has such elements. If the page marks its article, lines in it weigh SURGE more and all others 0.

Sums of weights over windows of WINDOW lines make the distribution: it surges where a window rises from zero and
dives where it falls back to zero. The text between a surge and its dive is kept if the distribution peaks at SURGE or
more in between, or if such a stretch is its neighbour and they are at most WINDOW lines apart or it has a heading; or,
on a page without a tall stretch, in the stretch with the most text. Everything before the first surge, after the last dive
and between stretches goes; so do, inside a stretch, lines that cannot be article text, but not those that only weigh
nothing for being short.

Elements end as HTML has it, also without end tags: a paragraph at the next block, a list item at the next item or
its list's end, cells and rows at the next ones. A class word makes an element suspect unless it is denied
("comment-free", "no-sidebar"); a page whose text is all in suspect elements is read as if nothing were.

Defined cases: a null or empty page has the empty text; unclosed and truncated markup ends with the page; very long pages
take time and memory in proportion; repeated rows come out each; columns other than page_id, url and html are
ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common

#: Lines of a window, and the sum of weights from which a stretch is article text.
WINDOW, SURGE = 3, 80
#: Share of a line's text inside links from which it is a menu line.
LINKED = 0.7

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<!\[CDATA\[.*?\]\]>|<(script|style|noscript|template|title|textarea|iframe|svg|math|object)\b(?:[^>\"']++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+>(?:.*?</\1\s*>|.*)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)>|<[!?/][^>]*>|<[a-zA-Z/!?][^>]*\Z",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold article text; a form may hold a whole page.
BARS = frozenset("head nav footer aside button select menu dialog search".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer footer gdpr header masthead menu modal nav navbar navigation "
    "newsletter notice notices popup promo promoted related replies respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar widget disqus".split()
)
#: Words that deny the other words of a class, words that an article's own parts carry, and those that count for inline elements.
DENIALS = frozenset("free no non not without less has with".split())
INNER = frozenset("header masthead banner".split())
ADVERTS = frozenset("ad ads advert adverts advertisement promo promoted share sharing sponsor sponsored".split())
ARTICLE = frozenset(["article", "main"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
#: Elements whose lines are running text, lists or tables.
TEXTUAL = HEADINGS | frozenset("p li dt dd pre blockquote td th caption figcaption summary address".split())
#: Elements that end at the next one of a group, if none of the boundaries is open in between.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    **dict.fromkeys(["dt", "dd"], (frozenset(["dt", "dd"]), frozenset(["dl"]))),
    **dict.fromkeys(["td", "th"], (frozenset(["td", "th"]), frozenset(["table", "tr"]))),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    **dict.fromkeys(["thead", "tbody", "tfoot"], (frozenset(["thead", "tbody", "tfoot", "caption"]), frozenset(["table"]))),
    **dict.fromkeys(["option", "optgroup"], (frozenset(["option"]), frozenset(["select"]))),
}
_WORD = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)", re.I)
#: What an open element is: no article text, suspect of that, the article, a heading, running text, an inline element.
BARRED, SUSPECT, MARKED, HEADING, TEXT, INLINE = 1, 2, 4, 8, 16, 32


class Line(NamedTuple):
    """A line's text, its characters inside links, and what is open around it."""

    text: str
    linked: int
    kind: int


def kind_of(name: str, attributes: str, in_article: bool) -> int:
    """What an element is, by its name and attributes."""
    block = name in BLOCKS
    kind = (MARKED if name in ARTICLE else 0) | (HEADING if name in HEADINGS else 0) | (TEXT if name in TEXTUAL else 0) | (0 if block else INLINE)
    if name in BARS or name == "header" and not in_article:
        kind |= BARRED
    if name == "form":
        kind |= SUSPECT
    if not attributes or name in ("html", "body"):
        return kind
    words = ADVERTS if not block else WORDS - INNER if in_article else WORDS
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if key == "role" and value in ROLES or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            kind |= BARRED
        elif key == "role" and value == "form":
            kind |= SUSPECT
        elif key in ("class", "id") and name not in ("main", "h1"):
            for one in value.split():
                parts = set(_WORD.findall(one))
                if parts & words and not parts & DENIALS and (name != "article" or parts & {"comment", "comments", "replies"}):
                    kind |= SUSPECT if block else BARRED
    if _HIDDEN.search(attributes):
        kind |= BARRED
    return kind


def lines(html: str) -> list[Line]:
    """The lines of a page; an element that cannot hold article text has WINDOW of them at least, maybe empty ones."""
    out: list[Line] = []
    pieces: list[tuple[str, bool]] = []
    stack: list[tuple[str, int, int]] = []  # name, kind, lines before it
    names: Counter[str] = Counter()
    kinds = dict.fromkeys((BARRED, SUSPECT, MARKED, HEADING, TEXT, INLINE), 0)
    hushed = 0  # open inline elements without article text
    in_link = False

    def close() -> None:
        if not pieces:
            return
        text = " ".join(unescape("".join(x for x, _ in pieces)).split())
        if text:
            out.append(Line(text, sum(len(" ".join(unescape(x).split())) for x, linked in pieces if linked), sum(bit for bit, n in kinds.items() if n)))
        pieces.clear()

    def push(name: str, kind: int) -> None:
        nonlocal hushed
        stack.append((name, kind, len(out)))
        names[name] += 1
        for bit in kinds:
            if kind & bit:
                kinds[bit] += 1
        if kind & INLINE and kind & BARRED:
            hushed += 1

    def pop() -> str:
        nonlocal hushed, in_link
        name, kind, before = stack.pop()
        if not kind & INLINE:
            close()
            in_link = False
        names[name] -= 1
        around = sum(bit for bit, n in kinds.items() if n)
        for bit in kinds:
            if kind & bit:
                kinds[bit] -= 1
        if kind & INLINE and kind & BARRED:
            hushed -= 1
        elif kind & (BARRED | SUSPECT) and not kinds[BARRED] and not kinds[SUSPECT]:
            out.extend([Line("", 0, around)] * max(0, WINDOW - (len(out) - before)))
        return name

    at = 0
    for m in TOKEN.finditer(html):
        if m.start() > at and not hushed:
            pieces.append((html[at : m.start()], in_link))
        at = m.end()
        if m[3] is None:
            if m[1] and m[1].lower() in ("iframe", "object"):
                close()
            continue
        name = m[3].lower()
        if m[2]:
            if name == "a":
                in_link = False
            elif names[name]:
                while pop() != name:
                    pass
            elif name in BLOCKS:
                close()
            continue
        if name == "br":
            pieces.append((" ", in_link))
        block = name in BLOCKS
        if block:
            if stack and stack[-1][0] == "p":
                pop()
            group, stops = ENDS.get(name, ((), ()))
            if any(names[x] for x in group):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in group:
                        while len(stack) > i:
                            pop()
                        break
                    if stack[i][0] in stops:
                        break
            close()
            in_link = False
        if name in VOID or m[4].endswith("/"):
            continue
        if name == "a":
            in_link = True
        kind = kind_of(name, m[4], kinds[MARKED] > 0)
        if block or kind & BARRED:
            push(name, kind)
    if at < len(html) and not hushed:
        pieces.append((html[at:], in_link))
    close()
    return out


def weigh(every: list[Line], relaxed: int) -> tuple[list[int], list[bool]]:
    """Of each line its weight, and whether it is kept inside a stretch. Relaxed by 1, short lines outside running
    text weigh too, by 2 also those of suspect elements.
    """
    out_kind = BARRED if relaxed > 1 else BARRED | SUSPECT
    able = [line.text != "" and not line.kind & out_kind for line in every]
    if any(x and line.kind & MARKED for x, line in zip(able, every, strict=True)):
        able = [x and bool(line.kind & MARKED) for x, line in zip(able, every, strict=True)]
        return [len(line.text) + SURGE if x else 0 for x, line in zip(able, every, strict=True)], able
    menu = [line.text != "" and not line.kind & HEADING and line.linked >= max(1, LINKED * len(line.text)) for line in every]
    able = [x and not (menu[i] and (i and menu[i - 1] or i + 1 < len(menu) and menu[i + 1])) for i, x in enumerate(able)]
    running = any(x and line.kind & TEXT for x, line in zip(able, every, strict=True))
    weak = [running and not relaxed and not line.kind & TEXT and len(line.text) < SURGE for line in every]
    return [len(line.text) if x and not y else 0 for x, y, line in zip(able, weak, every, strict=True)], able


def stretches(weights: list[int]) -> list[tuple[int, int, int]]:
    """(peak, first line, line after the last) of each part between a surge of the distribution and its dive."""
    n, total = len(weights), [0]
    for x in weights:
        total.append(total[-1] + x)
    # windows of lines that begin at each line, also those that reach in from before the page
    sums = [total[min(n, i + WINDOW)] - total[max(0, i)] for i in range(1 - WINDOW, n)]
    out, begin = [], None
    for i, x in enumerate([*sums, 0]):
        if x and begin is None:
            begin = i  # surge
        elif not x and begin is not None:
            out.append((max(sums[begin:i]), begin, i - WINDOW + 1))  # dive
            begin = None
    return out


def chosen(found: list[tuple[int, int, int]], weights: list[int], heading: list[bool]) -> list[tuple[int, int]]:
    """The stretches that are article text."""
    tall = {k for k, s in enumerate(found) if s[0] >= SURGE}
    if not tall:
        most = max(range(len(found)), key=lambda k: (sum(weights[found[k][1] : found[k][2]]), -k))
        return [found[most][1:]]
    heads = [any(heading[a:b]) for _, a, b in found]
    near = [found[k + 1][1] - found[k][2] <= WINDOW for k in range(len(found) - 1)]
    return [s[1:] for k, s in enumerate(found) if k in tall or k - 1 in tall and (near[k - 1] or heads[k]) or k + 1 in tall and (near[k] or heads[k])]


def main_text(html: str) -> str:
    """The article of a page, one block to a line."""
    every = lines(html)
    for relaxed in (0, 1, 2):
        weights, able = weigh(every, relaxed)
        found = stretches(weights)
        if found:
            heading = [x and bool(line.kind & HEADING) for x, line in zip(able, every, strict=True)]
            return "\n".join(every[i].text for a, b in chosen(found, weights, heading) for i in range(a, b) if able[i])
    return ""


def extract(pages: DataFrame) -> DataFrame:
    """Per page: ``page_id, url, text, n_chars``."""
    common.ship(pages.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    @common.tidy
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                texts = [main_text(x.as_py() or "") for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
