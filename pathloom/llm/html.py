"""Main-text extraction from HTML by two-pass block rules.

Pass one cuts a page into blocks at block-level tags and decides each block by its place, link
density, length and stop-word density: good, bad, or open (short, or of middling density). Pass two
gives open blocks the label of their nearest decided neighbours. Blocks inside an article or main element are
judged among themselves; where none of them is decided the element is its own evidence and they stay.

Stop-word density counts only where the page's text is in a language of the list; else length and links decide.
An element's own attributes, read by name, can mark it as boilerplate; inside a block only its text goes.

Dropped: menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles, markup and
reader comments, known by element, role, or class and id words. Kept blocks: character references
decoded, white space turned into one space, trimmed, joined in page order by a line end.

Defined cases: null or empty html, or a page without kept blocks, gives the empty text; a page cut
off inside a tag, comment, script or style ends there; long pages are read whole, in time
proportional to their length; repeated rows stay; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import ship

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][\w:-]*)((?:[^<>"']|"[^"<]*"|'[^'<]*')*+|[^>]*+)>|<[!?][^>]*+(?:>|\Z)|</?[A-Za-z][^>]*\Z""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Their content is text up to their own end tag; without one, scripts and styles go to the page's end.
_RAW = {"script", "style", "textarea", "title", "xmp"}
_CODE = {"script", "style"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_BAD_TAGS = {"nav", "footer", "aside", "form", "dialog", "menu", "head", "fieldset"}
#: Not running text, wherever they stand.
_NO_TEXT = {"noscript", "template", "iframe", "svg", "math", "object", "select", "button", "canvas", "audio", "video", "map"}
#: Elements whose start ends an open element of the same name.
_ENDS_ITSELF = {"p", "li", "td", "tr", "th", "dd", "dt", "option", "a", "button"}
_BAD_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form"}
_BAD_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscri\w+|social|share|sharing|related|recommend\w*|comments?|disqus|replies|respond|login|signup|search|pagination|pager|copyright|disclaimer|widget|toolbar|skip-link)(?:$|[\s_-])",
    re.I,
)
#: A class such as has-sidebar or no-comments tells of the page, not of the element.
_OF_PAGE = re.compile(r"^(?:has|have|no|not|with|without|is|page|layout|body|site)[-_]", re.I)
#: Frequent function words of languages common on the web.
STOP_WORDS = frozenset(
    """the of and to in is was for on that by this with from are be as at it or an which not have has had were their its but they his her you we he she i a
    de la le les des et en un une du que qui dans pour par sur est pas au aux avec ce cette se sont ne il elle nous vous plus ou son sa ses
    der die das und zu den von mit sich des ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei um noch wie einem über so zum war für auf
    el los del se las por con no una su para al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde y
    il di che è non per della sono una gli con più alla nel dei come anche ma ha delle
    da do em os não uma com na no as dos mais foi ao ele das à seu sua ou quando muito
    het van een dat op te zijn met voor niet aan er om ook dan bij uit door naar worden""".split()
)
SHORT, LONG = 70, 200
LOW, HIGH = 0.15, 0.30
UNKNOWN = 0.2
LINKS = 0.3
_WORD = re.compile(r"[^\W\d_]+")


class Block:
    __slots__ = ("text", "links", "bad", "main", "heading", "label")

    def __init__(self, text: str, links: int, bad: bool, main: int, heading: bool):
        self.text, self.links, self.bad, self.main, self.heading, self.label = text, links, bad, main, heading, ""


def marked(name: str, attributes: str) -> bool:
    """Whether an element's attributes call it boilerplate."""
    for attribute, value in _ATTRIBUTE.findall(attributes):
        attribute, value = attribute.lower(), value.strip("\"'")
        if attribute == "hidden" or attribute == "aria-hidden" and value.lower() == "true":
            return True
        if attribute == "role" and value.lower() in _BAD_ROLES:
            return True
        if attribute in ("class", "id") and name not in ("body", "html", "article", "main"):
            if any(_BAD_WORDS.search(word) for word in value.split() if not _OF_PAGE.match(word)):
                return True
        if attribute == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


class Page:
    """Reads a page's tags into blocks. Open elements are held on a stack and counted by name."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.stack: list[tuple[str, bool, int, bool]] = []  # element, boilerplate, article, whether it mutes text inside a block
        self.open: Counter = Counter()
        self.held: list[str] = []
        self.linked = self.mains = self.muted = 0

    def state(self) -> tuple[bool, int]:
        return self.stack[-1][1:3] if self.stack else (False, 0)

    def cut(self) -> None:
        if self.held:
            text = " ".join(unescape("".join(self.held)).split())
            self.held.clear()
            if text:
                bad, main = self.state()
                heading = any(len(e[0]) == 2 and e[0][0] == "h" and e[0] != "hr" for e in self.stack[-3:])
                self.blocks.append(Block(text, self.linked, bad, main, heading))
        self.linked = 0

    def put(self, text: str) -> None:
        if text and not self.muted:
            self.held.append(text)
            if self.open["a"]:
                self.linked += len(text.strip())

    def end(self, name: str) -> None:
        if name in _BLOCK:
            self.cut()
        if self.open[name]:
            while self.pop() != name:
                pass

    def pop(self) -> str:
        name, _, _, mutes = self.stack.pop()
        self.open[name] -= 1
        self.muted -= mutes
        return name

    def start(self, name: str, attributes: str) -> None:
        if name in _BLOCK:
            self.cut()
            while self.open["select"]:  # no block stands in one
                self.pop()
        elif name == "br":
            self.put(" ")
        if name in _VOID or attributes.endswith("/"):
            return
        if name in _ENDS_ITSELF and self.stack and self.stack[-1][0] == name:
            self.pop()
        bad, main = self.state()
        if name in ("article", "main") and not main:
            self.mains += 1
            main = self.mains
            if name == "main" or "articlebody" in attributes.lower():  # what is around it says nothing of it
                bad = any(e[0] in _BAD_TAGS for e in self.stack)
        own = name in _BAD_TAGS or name in _NO_TEXT or name == "header" and not main or bool(attributes) and marked(name, attributes)
        mutes = not bad and own and name not in _BLOCK  # its text goes, its block stays
        self.stack.append((name, bad or own and not mutes, main, mutes))
        self.open[name] += 1
        self.muted += mutes


def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\b[^>]*>", re.I)


_ENDS = {name: _end_of(name) for name in _RAW | _NO_TEXT}


def blocks(page: str) -> list[Block]:
    read, at = Page(), 0
    ahead: dict[str, re.Match | None] = {}  # the next end tag of an element, looked for once it is passed

    def end_of(name: str) -> re.Match | None:
        if name not in ahead or ahead[name] and ahead[name].start() < at:
            ahead[name] = _ENDS[name].search(page, at)
        return ahead[name]

    while at < len(page):
        found = _TOKEN.search(page, at)
        if not found:
            read.put(page[at:])
            break
        read.put(page[at : found.start()])
        at = found.end()
        name = found[2].lower() if found[2] else ""
        if not name:
            continue
        if found[1]:
            read.end(name)
        elif name in _RAW:
            if end := end_of(name):
                at = end.end()
            elif name in _CODE:
                at = len(page)
        elif name not in _NO_TEXT or end_of(name):  # one that never ends holds nothing
            read.start(name, found[3])
    read.cut()
    return read.blocks


def known_language(found: list[Block]) -> bool:
    """Whether the page's running text is in a language of STOP_WORDS: else density says nothing."""
    words = [w for b in found if not b.bad and len(b.text) >= SHORT and 2 * b.links < len(b.text) for w in _WORD.findall(b.text.lower())]
    return sum(w in STOP_WORDS for w in words) >= UNKNOWN * len(words)


def decide(b: Block, known: bool) -> str:
    """good, bad, or open: near (of middling density) or short. In an unknown language by length and links alone."""
    if b.bad or b.links > LINKS * len(b.text) and (b.links > 0.8 * len(b.text) or not b.main):
        return "bad"
    if b.heading:
        return "short"
    if not known:  # some scripts say in one sign what others need three letters for
        size = sum(3 if c >= "\u2e80" else 1 for c in b.text[:LONG])
        return "good" if size >= LONG else "near" if size >= SHORT else "short"
    if len(b.text) < SHORT:
        return "short"
    words = _WORD.findall(b.text.lower())
    density = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if density >= HIGH:
        return "good" if len(b.text) > LONG else "near"
    if density >= LOW:
        return "near"
    return "short" if b.main else "bad"


def inherit(found: list[Block], main: int) -> None:
    """Open blocks of one article (0: outside any) take the label of the nearest decided neighbours."""
    own = [b for b in found if b.main == main]
    before: list[tuple[str, int]] = []
    last, far = "", 0
    for b in own:
        before.append((last, far))
        last, far = (b.label, 0) if b.label in ("good", "bad") else (last, far + len(b.text))
    last, far = "", 0
    for b, (earlier, d) in zip(reversed(own), reversed(before)):
        if b.label in ("good", "bad"):
            last, far = b.label, 0
            continue
        mine = b.label
        if earlier and last and earlier != last:
            near = earlier if d < far else last if far < d or b.heading else "good" if mine == "near" else "bad"
        else:
            near = earlier or last
        b.label = "good" if mine == "near" and "good" in (earlier, last) else near or ("good" if main or mine == "near" else "bad")
        far += len(b.text)


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    known = known_language(found)
    for b in found:
        b.label = decide(b, known)
    for main in {b.main for b in found}:
        if main:  # boilerplate inside an article says nothing of its other blocks
            outside = [b for b in found if b.main == main and b.bad]
            for b in outside:
                b.main = -main
        inherit(found, main)
    has_main = any(b.main > 0 and b.label == "good" for b in found)
    return "\n".join(b.text for b in found if b.label == "good" and not b.bad and (b.main > 0 or not has_main))


def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars."""
    ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(extract, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))


def op4(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
