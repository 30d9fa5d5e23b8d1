"""Main text of web pages from parser events and text-to-tag ratios.

The standard library's parser streams a page as events. Blocks are the lines of the page: each has
its text and the number of tags around it. Blocks inside menus, page headers, footers, sidebars,
notices, adverts, forms, reader comments and the like are marked by their elements. The ratio of
characters to tags of the remaining lines is smoothed with a Gaussian, and lines above a standard
deviation are content. The region that holds most of the content, grown to the article or main
element around it, or else to its parents while these add nothing marked, is the text: every
unmarked block of it, short ones too.

What is marked is decided after parsing: a marked element around the article, or around most of the
text of a page without one, is a wrapper and stays.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE = 1 << 16  # characters fed to the parser at a time
RADIUS, SIGMA = 2, 1.0  # of the Gaussian over lines
SHARE = 0.8  # of the content's characters that the region has to hold

#: Elements that end a line of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead title tr ul".split())
#: Elements whose ends are tracked: regions, and those that are left out with all they hold.
REGIONS = frozenset("article body blockquote details div figure main section table td".split())
OUT = frozenset(
    "aside audio button canvas datalist dialog footer form head iframe input label menu nav noscript object script select style "
    "svg template textarea title video".split())
#: Those of them that are no text of the page, so that nothing of them is kept for the decision.
SILENT = OUT - frozenset("aside dialog footer form menu nav".split())
#: Elements whose start ends an open p; what other starts end, and the elements that this does not reach beyond.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr main menu nav ol p pre section summary table ul".split())
_CELL = frozenset("table td th".split())
_WALLS = _CELL | frozenset("article aside blockquote dialog figure footer form main nav section".split())
IMPLIED = (
    {"li": (frozenset(["li"]), _WALLS | {"ul", "ol", "menu"})}
    | dict.fromkeys(("dd", "dt"), (frozenset(("dd", "dt")), _WALLS | {"dl"}))
    | dict.fromkeys(("td", "th"), (frozenset(("td", "th")), frozenset(["table"])))
    | {"tr": (frozenset(("td", "th", "tr")), frozenset(["table"]))}
    | dict.fromkeys(("tbody", "thead", "tfoot"), (frozenset(("td", "th", "tr")), frozenset(["table"]))))
P_WALLS = _CELL | frozenset("button caption object".split())
#: How far an end tag looks for its element.
REACH = {"p": P_WALLS, "li": IMPLIED["li"][1], "dd": IMPLIED["dd"][1], "dt": IMPLIED["dt"][1]} | dict.fromkeys(
    ("td", "th", "tr"), frozenset(["table"]))
TRACKED = REGIONS | REACH.keys() | frozenset("header ul ol dl".split())

#: Roles and words in class or id of what is left out.
OUT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer gdpr masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo "
    "promoted related share sharing sidebar social sponsor sponsored subscribe toolbar".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CUT_OFF = re.compile(r"<[a-zA-Z/!?]")
_P = frozenset(["p"])
_SPLIT = re.compile(r"[^a-z0-9]+")


@dataclass
class Block:
    """A line of the page: its text, the tags met since the last one, the regions and the marked
    elements around it, and whether it is in an article or main within the innermost of these."""

    text: str
    tags: int
    regions: tuple[int, ...]
    marks: tuple[int, ...] = ()
    article: bool = False


@dataclass
class _Open:
    tag: str
    silent: bool = False
    region: int | None = None
    mark: int | None = None
    article: bool = False


class Blocks(HTMLParser):
    """Collects the blocks of a page from the parser's events."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.kinds: list[str] = []  # element of each region
        self.wrapper: list[bool] = []  # of each marked element, whether it may turn out to be a wrapper
        self.open: Counter[str] = Counter()
        self.stack: list[_Open] = []
        self.out = 0
        self.tags = 0
        self.parts: list[str] = []

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers are not used

    def _end_line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                article = False
                for o in self.stack:
                    article = (article or o.article) and o.mark is None
                self.blocks.append(Block(
                    text, self.tags, tuple(o.region for o in self.stack if o.region is not None),
                    tuple(o.mark for o in self.stack if o.mark is not None), article))
                self.tags = 0
            self.parts = []

    def _named_out(self, attrs: dict[str, str | None]) -> bool:
        names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower()
        return bool(names.strip()) and not OUT_WORDS.isdisjoint(_SPLIT.split(names))

    def _marked(self, tag: str, attrs: dict[str, str | None]) -> bool:
        if tag in OUT:
            return True
        if tag in ("html", "body", "main", "article"):
            return False
        if tag == "header":  # of the page; an article's own holds its title
            return not any(o.tag in ("article", "main") for o in self.stack)
        return self._hidden(attrs) or (attrs.get("role") or "").lower() in OUT_ROLES or self._named_out(attrs)

    def _hidden(self, attrs: dict[str, str | None]) -> bool:
        return "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true"

    def _pop(self, i: int) -> None:
        self._end_line()
        for o in self.stack[i:]:
            self.open[o.tag] -= 1
            self.out -= o.silent
        del self.stack[i:]

    def _end_implied(self, tags: frozenset[str], walls: frozenset[str]) -> None:
        if not any(self.open[t] for t in tags):
            return
        first = None
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag in tags:
                first = i
            elif self.stack[i].tag in walls:
                break
        if first is not None:
            self._pop(first)

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._end_line()
        if tag in ENDS_P:
            self._end_implied(_P, P_WALLS)
        if tag in IMPLIED:
            self._end_implied(*IMPLIED[tag])
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        attrs = dict(attrs)
        marked = self._marked(tag, attrs)
        if marked or tag in TRACKED:
            new = _Open(tag, tag in SILENT)
            if tag in REGIONS:
                new.region = len(self.kinds)
                self.kinds.append(tag)
            if marked:
                self._end_line()
                if not new.silent:
                    new.mark = len(self.wrapper)
                    self.wrapper.append(tag not in ("menu", "nav") and not self._hidden(attrs))
            new.article = tag in ("article", "main") and not self._named_out(attrs)
            self.stack.append(new)
            self.open[tag] += 1
            self.out += new.silent

    def handle_startendtag(self, tag, attrs):
        # Outside of drawings a slash does not close an element; inside one it opens nothing to track.
        if tag in VOID or not self.out:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self._end_line()
        self.tags += 1
        if not self.open[tag]:
            return
        walls = REACH.get(tag, frozenset())
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag == tag:
                self._pop(i)
                break
            if self.stack[i].tag in walls:
                break

    def handle_data(self, data):
        if not self.out:
            self.parts.append(data)

    def finish(self) -> None:
        # A tag or comment that the end of the page cuts off is no text.
        if _CUT_OFF.match(self.rawdata):
            self.rawdata = ""
        self.close()
        self._end_line()


def smoothed(ratios: np.ndarray, radius: int = RADIUS, sigma: float = SIGMA) -> np.ndarray:
    k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), k)[radius:radius + len(ratios)]
    return np.convolve(ratios, k)[radius:radius + len(ratios)] / weight


def wrappers(parser: Blocks) -> set[int]:
    """The marked elements that hold the page's text: those around more article or main text than
    there is outside of marked elements, and if there is none at all, those around most of the text."""
    stay: set[int] = set()
    total = sum(len(b.text) for b in parser.blocks)
    while True:
        free, article, whole = 0, Counter(), Counter()
        for b in parser.blocks:
            outer = next((m for m in b.marks if m not in stay), None)
            if outer is None:
                free += len(b.text) * b.article
            elif parser.wrapper[outer]:
                whole[outer] += len(b.text)
                article[outer] += len(b.text) * b.article
        for held, least in ((article, free), (whole, total / 2)):
            best = max(held, key=held.__getitem__, default=None)
            if best is not None and held[best] > least and (held is article or not free):
                stay.add(best)
                break
        else:
            return stay


def main_text(html: str) -> str:
    """The blocks of the page's content region, one per line; empty if it has none."""
    parser = Blocks()
    for i in range(0, len(html), SLICE):
        parser.feed(html[i:i + SLICE])
    parser.finish()
    stay = wrappers(parser) if parser.wrapper else set()
    blocks, marked, passed = [], [], 0
    for b in parser.blocks:
        if stay.issuperset(b.marks):
            b.tags += passed
            passed = 0
            blocks.append(b)
        else:
            passed += b.tags
            marked.append(b)
    if not blocks:
        return ""
    sizes = np.array([len(b.text) for b in blocks], float)
    ratio = smoothed(sizes / np.maximum(1, [b.tags for b in blocks]))
    # Pages of even lines have no cluster above one deviation; the best line then stands for it.
    content = ratio >= min(float(ratio.std()), float(ratio.max()))
    held: dict[int, float] = {}
    for b, n, c in zip(blocks, sizes, content, strict=True):
        if c:
            for r in b.regions:
                held[r] = held.get(r, 0) + n
    need = SHARE * float(sizes[content].sum())
    enough = [r for r, n in held.items() if n >= need]
    if not enough:
        return "\n".join(b.text for b in blocks)
    region = max(enough)  # regions are numbered as they open: the innermost that holds enough
    around = next(b.regions for b in blocks if region in b.regions)
    whole = [r for r in around if parser.kinds[r] in ("article", "main") and r <= region]
    chosen = whole[-1] if whole else region
    if not whole:
        barred = {r for b in marked if region not in b.regions for r in b.regions}
        for r in reversed([r for r in around if r < region]):
            if r in barred:
                break
            chosen = r
    return "\n".join(b.text for b in blocks if chosen in b.regions)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for i in range(0, whole.num_rows, 200):
            batch = whole.slice(i, 200)
            texts = [main_text(h) if h else "" for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["row", "text", "n_chars"])


def extract(pages: DataFrame, carry: list[str], html_col: str = "html") -> DataFrame:
    """The columns in `carry`, and text and n_chars (code points) of every page.

    Null or empty html has an empty text. Character references are decoded, white space inside a block
    becomes one space. Repeated rows are extracted one by one. Columns not carried are ignored,
    whatever their names; an empty table gives no rows.
    """
    source = pages.select(F.struct(*carry).alias("row"), F.col(html_col).alias("html"))
    row = source.schema["row"].dataType.simpleString()
    return source.mapInArrow(_extract, f"row {row}, text string, n_chars long").select("row.*", "text", "n_chars")
