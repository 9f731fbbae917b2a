"""Main-text extraction by line-block distribution.

Markup is stripped into lines, one for each block element, and everything that
is not prose by its element or its announced purpose (scripts, styles, forms,
navigation, headers and footers of the page, asides, adverts, notices,
comments) leaves an empty line for each block it had; inside a line such an
element takes its own text with it and no more.  Lengths of text are summed over
sliding windows of WINDOW lines.  From where the sum rises to
where it dives to nothing is a stretch, and a stretch that surges, that is
reaches SURGE in a window, is text.  On a page where no window reaches it, any
text counts as a surge.

If the page says which part is its article, the stretches are weighed against
that: unless those outside hold bodies (of BODY characters) that make up more
than the article, the article's lines are the text, all of them, since an
article's short last line behind a wide gap is no less its text.

Defined results: null or empty html and html without prose give an empty text
and 0; character references are decoded once; malformed or unclosed tags end
at the next `>` or at the end; unclosed elements end with their parent.
Each row is extracted by itself, whatever ids repeat; time grows with the
page's length, however deep it is nested.  Extra columns are not read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines in a window; a surge reaches this many characters in one window.
WINDOW, SURGE = 3, 40
#: A stretch outside the article speaks against it from this many characters: a window of surging lines.
BODY = WINDOW * SURGE
#: Share of link text from which a line outside the article counts as navigation.
LINKED = 0.6

# What HTML says about its elements.
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol p pre section summary table tbody td template tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp noembed noframes".split())
_DROPPED = frozenset("aside audio button canvas dialog fieldset footer form head iframe input label legend menu nav noscript object option select style script svg template textarea title video".split())
_LISTS = ("ul", "ol", "dl", "select", "table", "menu")
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_CLOSES_P = _BLOCKS - frozenset("body html caption head li td th tr tbody thead tfoot template".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search tablist toolbar".split())
_PURPOSE = re.compile(
    r"(?:^|[-_\s])(?:ads?|adverts?|advertisement|advertising|adslot|adsbygoogle|banner|breadcrumbs?|byline|captcha|comments?|commentlist|consent|cookies?|disclaimer|disqus|feedback|footer|foot|gdpr|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|notification|overlay|pager|pagination|paywall|popup|promo|promoted|promotion|recommended|related|replies|reply|respond|rss|share|sharing|shoutbox|sidebar|signup|skip|social|sponsor|sponsored|subscribe|subscription|tags|toolbar|tools|topbar|widget)(?:$|[-_\s0-9])",
    re.IGNORECASE,
)
# Inside the article a class or id has to say it in full: one of these kinds, with nothing beside it but words for places and boxes.
_KINDS = frozenset("ad ads adbox adslot adsbygoogle advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr menu nav navbar navigation newsletter notice notices notification notifications popup promo promoted promotion replies reply respond share sharing shoutbox sidebar signup social sponsor sponsored subscribe subscription".split())
_BESIDE = frozenset("area bar block bottom box button buttons container content fixed form group icon icons inline inner item items js left link links list main module outer page panel post primary right row secondary section site slot sticky text thread title top unit widget wrap wrapper".split())
_ARTICLE = re.compile(r"(?:^|[-_\s])(?:article[-_]?(?:body|content|text)?|entry[-_]?(?:content|text)|main[-_]?(?:content|text)|post[-_]?(?:body|content|text)|story[-_]?(?:body|content|text)?)(?:$|\s)", re.IGNORECASE)
# A quote opens a value only directly behind `=`, and closes it only where an attribute can end; any other is part of the tag up to its `>`.
_VALUE = r"=\s*+(?:\"[^\"]*+\"|'[^']*+')(?=\s|/?(?:>|\Z)|[a-zA-Z_:][-\w:.]*+\s*+=\s*+[\"'])"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|{_VALUE}|=)*+)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


@dataclass
class Line:
    """The text of one block, in parts as they came, and what is known of it."""

    parts: list[str] = field(default_factory=list)
    linked: int = 0
    prose: bool = True
    heading: bool = False
    article: int = 0
    text: str = ""


@dataclass(slots=True)
class _Open:
    name: str
    drops: bool
    article: bool
    link: bool


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)}


def _purposeless(name: str, raw: str, in_article: bool) -> bool:
    """Whether an element is no prose by its name, role, class or id."""
    if name in _DROPPED or name == "header" and not in_article:
        return True
    if "=" not in raw and "hidden" not in raw:
        return False
    given = _attributes(raw)
    if given.get("role", "").lower() in _ROLES or "hidden" in given or given.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", given.get("style", "")):
        return True
    if name in ("html", "body", "main", "article"):
        return False
    return _said_in_full(given) if in_article else _announced(given)


def _announced(given: dict[str, str]) -> bool:
    """Whether class or id name a purpose that is no prose."""
    said = f"{given.get('class', '')} {given.get('id', '')}"
    return bool(_PURPOSE.search(said)) and not _ARTICLE.search(said)


def _said_in_full(given: dict[str, str]) -> bool:
    """Whether a class or the id is one of _KINDS and no more: `share-links` is, `related-work` and `ad-hoc-analysis` aren't."""
    for said in f"{given.get('class', '')} {given.get('id', '')}".lower().split():
        words = [w for w in re.split(r"[-_0-9]+", said) if w]
        if any(w in _KINDS for w in words) and all(w in _KINDS or w in _BESIDE for w in words):
            return True
    return False


def lines_of(source: str) -> list[Line]:
    """The page's lines in order: the text between the borders of block elements."""
    lines, here = [], Line()
    stack: list[_Open] = []
    # Where on the stack elements of each name and block elements stand, so that no tag searches it.
    places: defaultdict[str, list[int]] = defaultdict(list)
    blocks: list[int] = []
    drops = articles = links = 0
    at, end = 0, len(source)

    def close() -> None:
        nonlocal here
        lines.append(here)
        here = Line(prose=not drops, article=articles)

    def text(raw: str) -> None:
        if raw:
            if not drops:
                here.parts.append(raw)
                if links:
                    here.linked += len(raw.strip())

    def pop() -> None:
        nonlocal drops, articles, links
        gone = stack.pop()
        places[gone.name].pop()
        if blocks and blocks[-1] == len(stack):
            blocks.pop()
        drops, articles, links = drops - gone.drops, articles - gone.article, links - gone.link

    while at < end:
        m = _TOKEN.search(source, at)
        if m is None:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name, closing, raw = m[2].lower(), m[1] == "/", m[3] or ""
        block = name in _BLOCKS
        if closing:
            depth = places[name][-1] if places[name] else None
            # A closing tag ends inline elements left open, but no element around the nearest block.
            if depth is None or not block and blocks and blocks[-1] > depth:
                if block:
                    close()
                continue
            if block:
                close()
            while len(stack) > depth:
                pop()
            if block or not here.parts:  # a line that began inside an element that ends here
                here.prose, here.article = not drops, articles
            continue
        if name == "br":
            text(" ")
            continue
        if name in _CLOSES_P and places["p"]:
            depth = places["p"][-1]
            if blocks[-1] <= depth:
                close()
                while len(stack) > depth:
                    pop()
        elif name in _ENDS:
            around = max((places[x][-1] for x in _LISTS if places[x]), default=-1)
            ends = sorted(i for kind in _ENDS[name] for i in places[kind][bisect_right(places[kind], around) :])
            for i in reversed(ends):
                if block:
                    close()
                while len(stack) > i:
                    pop()
        if block:
            close()
        if name in _VOID or raw.rstrip().endswith("/") and not block:
            continue
        entry = _Open(name, _purposeless(name, raw, articles > 0), _is_article(name, raw), name == "a")
        places[name].append(len(stack))
        if block:
            blocks.append(len(stack))
        stack.append(entry)
        drops, articles, links = drops + entry.drops, articles + entry.article, links + entry.link
        if block:
            here.prose, here.article, here.heading = not drops, articles, name in _HEADINGS
        if name in _RAW:
            stop = re.compile(rf"</{re.escape(name)}[\s/>]|\Z", re.IGNORECASE).search(source, at)
            text(source[at : stop.start()])
            at = stop.start()
    close()
    return lines


def _is_article(name: str, raw: str) -> bool:
    """Whether an element is the article by its name, unless that announces a teaser or the like, or by its class or id."""
    if name == "main" or "articleBody" in raw:
        return True
    if "class" not in raw and "id" not in raw:
        return name == "article"
    given = _attributes(raw)
    if name == "article":
        return not _announced(given)
    return bool(_ARTICLE.search(f"{given.get('class', '')} {given.get('id', '')}"))


def main_text(source: str) -> str:
    """The blocks of the main text, joined by an empty line."""
    lines = lines_of(source)
    for line in lines:
        line.text = " ".join(html.unescape("".join(line.parts)).split()) if line.parts and line.prose else ""
        if line.text and line.linked >= LINKED * len(line.text) and not line.heading and not line.article:
            line.text = ""
    article = [line for line in lines if line.article > 0 and line.text]
    if article and sum(_bodies(lines)) <= sum(len(line.text) for line in article):
        return "\n\n".join(line.text for line in article)
    # Where nothing surges, whatever text there is.
    kept = _between(lines, SURGE) or _between(lines, 1)
    return "\n\n".join(line.text for line in kept)


def _bodies(lines: list[Line]) -> list[int]:
    """Characters of each stretch outside the article that is a body by itself."""
    outside = [Line() if line.article > 0 else line for line in lines]
    sizes = [sum(len(line.text) for line in stretch) for stretch in _stretches(outside, SURGE)]
    return [n for n in sizes if n >= BODY]


def _between(lines: list[Line], surge: int) -> list[Line]:
    """The lines with text of all stretches."""
    return [line for stretch in _stretches(lines, surge) for line in stretch]


def _stretches(lines: list[Line], surge: int) -> list[list[Line]]:
    """The lines with text from each rise of the windowed length from nothing to its dive to nothing, if it surges between."""
    total = [0, *accumulate(len(line.text) for line in lines)]
    sums = [total[min(i + WINDOW, len(lines))] - total[i] for i in range(len(lines))]
    kept: list[list[Line]] = []
    i = 0
    while i < len(lines):
        end = i
        while end < len(lines) and sums[end] > 0:
            end += 1
        if end > i and max(sums[i:end]) >= surge:
            kept.append([line for line in lines[i:end] if line.text])
        i = end + 1
    return kept


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns in `keep`, text and n_chars of every row of `pages` (html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [main_text(x.as_py() or "") for x in part.column(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*names, "text", "n_chars"])

    rows = pages.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col("html").cast("string").alias("html"))
    names = rows.columns[:-1]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, text string, n_chars long").withColumnsRenamed(dict(zip(names, keep, strict=True)))
