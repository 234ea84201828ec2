"""Main text of web pages by consensus host paths.

Each page is read into containers and blocks.  From the page's root the page's own choice goes down to the child container that
holds the good text, as long as no sibling has prose of its own; its generalised path (tags and classes, digits replaced) is a
vote.  Votes are counted per host in Spark and the path with most pages wins.  Every page is then extracted from the containers at
its host's winning path if they hold most of the page's good text, and from its own choice otherwise.

Inside the container, menus, headers, footers, sidebars, notices, adverts, forms, comments by readers, scripts and styles are
left out; of a header inside an article its headings stay, and a form round the whole page is read like any other container.
Character references are decoded, white space inside a block becomes one space, and blocks are joined by one space.

Boilerplate is told by element, by role, and by class or id: a token that is a boilerplate word itself (``sidebar``), ends in one
(``site-footer``), or begins with one and goes on with a word for a part of a page (``cookie-box``).  Other compounds
(``social-history``, ``notice-board``) say nothing, nor do tokens with a word for content (``entry-header``).

Tags are read by the rules of HTML: quotes count only after an equals sign, the text of scripts and the like goes on to its own end tag,
foreign content ends at the next HTML block, unclosed paragraphs end at the next block, stray end tags are ignored.  A tag whose quote is
never closed ends at its first bracket.

Defined cases.  Null and empty pages give an empty text; null URLs and those without a host share one host without a name.  Repeated rows
each get a row.  Ties: of two children with equal text the first in the page counts; of two paths with equally many pages that with more text, then
the later in order.  An empty table gives no rows.  Pages may be of any length: nothing is cut, memory and time are in proportion to the page.
Columns other than page_id, url and html are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import cut, in_pieces, small

# Element and class names as HTML and common page templates use them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article body div form main section td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
FOREIGN = frozenset("math svg".split())
SKIP = frozenset("aside audio button canvas dialog footer head header label math menu nav object option select svg template video".split())
EXEMPT = frozenset("article body h1 html main".split())
SKIP_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
SKIP_WORDS = frozenset(
    "ad ads adbox advert advertisement adverts alert banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies disqus footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
PART_WORDS = frozenset(
    "area bar block box button buttons container content feed form frame group header icon icons inner item items label link links list message module nav outer overlay panel popup post posts row section slot strip text thread title toggle top unit widget wrap wrapper zone".split()
)
CONTENT_WORDS = frozenset("article body entry main story".split())
MADE_FOR_TEXT = frozenset("article main".split())
SAME_CLOSES = {"li": ("ul", "ol"), "option": ("select",), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}

_TAG = re.compile(r"<(?:!--|/?[a-zA-Z]|[!?]|/)")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"""(?:[^=>]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+|(?=>)))*+>""")
_ATTR = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_SAYING = frozenset("aria-hidden class hidden id role style".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"\d+")
#: The share of good text that a child, a child element made for content, and a host's path must hold.
MOST_TEXT, MAIN_TEXT, PATH_TEXT = 0.8, 0.5, 0.5
#: Characters outside links from which a block counts as prose.
PROSE_CHARS = 60
READ, HEADINGS_ONLY, SKIPPED = 0, 1, 2


class Page:
    """Containers (parent, own name) and blocks (container, text, characters in links) of one page."""

    def __init__(self, html: str):
        self.parent, self.name, self.tag = [-1], [""], [""]
        self.blocks: list[tuple[int, str, int]] = []
        self.read(html)
        self.leave_out_forms()

    def read(self, html: str) -> None:
        stack: list[tuple[str, int, int]] = [("", 0, READ)]  # tag, container, what is read of it
        still_open: Counter[str] = Counter()
        buffer: list[str] = []
        linked = 0

        def flush() -> None:
            nonlocal linked
            if buffer:
                text = " ".join("".join(buffer).split())
                if text:
                    self.blocks.append((stack[-1][1], text, linked))
                buffer.clear()
            linked = 0

        def add(raw: str) -> None:
            nonlocal linked
            if raw and stack[-1][2] == READ:
                text = unescape(raw) if "&" in raw else raw
                buffer.append(text)
                if still_open["a"]:
                    linked += len(text)

        def pop_to(k: int) -> None:
            flush()
            drop(k)

        def drop(k: int) -> None:
            for tag, _, _ in stack[k:]:
                still_open[tag] -= 1
            del stack[k:]

        at, size = 0, len(html)
        while at < size:
            m = _TAG.search(html, at)
            if m is None:
                add(html[at:])
                break
            add(html[at : m.start()])
            start = m.start()
            if html.startswith("<!--", start):
                end = html.find("-->", start + 2)
                at = size if end < 0 else end + 3
                continue
            named = _NAME.match(html, start)
            rest = _REST.match(html, named.end()) if named else None
            # declarations, and tags with a quote that is never closed, end at the first bracket
            end = rest.end() if rest else html.find(">", start) + 1
            if not end:  # a page cut off inside a tag
                break
            at = end
            if named is None:
                continue
            tag = named[1].lower()
            if html[start + 1] == "/":
                if still_open[tag]:
                    k = len(stack) - 1
                    while stack[k][0] != tag and (tag in BLOCK or stack[k][0] not in BLOCK):
                        k -= 1
                    if stack[k][0] == tag:  # else it is open outside the block, and stays open
                        pop_to(k) if tag in BLOCK else drop(k)
                continue
            if tag in RAW:
                if not html[start:end].endswith("/>"):
                    close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, end)
                    at = size if close is None else close.end()
                continue
            if tag in VOID:
                if tag in ("br", "hr"):
                    buffer.append(" ")
                    if tag == "hr":
                        flush()
                continue
            if tag in BLOCK:
                if (still_open["svg"] or still_open["math"]) and not still_open["foreignobject"]:
                    pop_to(min(k for k in range(len(stack)) if stack[k][0] in FOREIGN))
                if still_open["p"]:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == "p":
                            pop_to(k)
                            break
                        if stack[k][0] in CONTAINER or stack[k][0] in ("table", "ul", "ol"):
                            break
                if tag in SAME_CLOSES:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == tag or (tag in ("dt", "dd") and stack[k][0] in ("dt", "dd")):
                            pop_to(k)
                            break
                        if stack[k][0] in SAME_CLOSES[tag] or stack[k][0] in CONTAINER:
                            break
                flush()
            if html[end - 2] == "/" and tag not in BLOCK:
                continue
            _, container, state = stack[-1]
            said: dict[str, str] = {}
            if end - named.end() > 1:
                for a in _ATTR.findall(html[named.end() : end - 1]):
                    if (word := a[0].lower()) in _SAYING:
                        said.setdefault(word, a[1] or a[2] or a[3])
            if state != SKIPPED:
                if self.boilerplate(tag, said):
                    state = SKIPPED
                elif tag in SKIP:
                    state = HEADINGS_ONLY if tag == "header" and still_open["article"] else SKIPPED
                elif state == HEADINGS_ONLY and tag in HEADINGS:
                    state = READ
            if tag in CONTAINER:
                self.parent.append(container)
                classes = ".".join(sorted(said.get("class", "").lower().split())) or ".".join(said.get("id", "").lower().split())
                self.name.append(tag + (f".{_DIGITS.sub('#', classes)}" if classes else ""))
                self.tag.append(tag)
                container = len(self.parent) - 1
            still_open[tag] += 1
            stack.append((tag, container, state))
        flush()

    @staticmethod
    def boilerplate(tag: str, said: dict[str, str]) -> bool:
        if not said or tag in EXEMPT:
            return False
        if "hidden" in said or said.get("aria-hidden", "").lower() == "true" or "display:none" in said.get("style", "").replace(" ", "").lower() or said.get("role", "").lower() in SKIP_ROLES:
            return True
        found = False
        for token in f"{said.get('class', '')} {said.get('id', '')}".split():
            words = [w.lower() for w in _WORDS.findall(token)]
            if CONTENT_WORDS.intersection(words):
                return False
            if words and (words[-1] in SKIP_WORDS or (words[0] in SKIP_WORDS and words[1] in PART_WORDS)):
                found = True
        return found

    def leave_out_forms(self) -> None:
        """Drop the blocks of forms, but for one that has an article or prose, and most of the page's good text."""
        if "form" not in self.tag:
            return
        good, prose = self.good(), self.prose()
        made = [t in MADE_FOR_TEXT for t in self.tag]
        for c in range(len(made) - 1, 0, -1):
            made[self.parent[c]] |= made[c]
        gone = [False] * len(prose)
        for c in range(1, len(gone)):
            gone[c] = gone[self.parent[c]] or (self.tag[c] == "form" and not ((made[c] or prose[c]) and good[c] > MAIN_TEXT * good[0]))
        self.blocks = [b for b in self.blocks if not gone[b[0]]]

    def good(self) -> list[float]:
        """Good text at or below each container: block lengths, text in links counted against."""
        out = [0.0] * len(self.parent)
        for c, text, linked in self.blocks:
            out[c] += max(0, len(text) - 2 * linked)
        for c in range(len(out) - 1, 0, -1):
            out[self.parent[c]] += out[c]
        return out

    def prose(self) -> list[int]:
        """Blocks of prose at or below each container."""
        out = [0] * len(self.parent)
        for c, text, linked in self.blocks:
            out[c] += len(text) - 2 * linked >= PROSE_CHARS
        for c in range(len(out) - 1, 0, -1):
            out[self.parent[c]] += out[c]
        return out

    def choice(self) -> int:
        good, long, now = self.good(), self.prose(), 0
        children: dict[int, list[int]] = {}
        for c in range(1, len(long)):
            children.setdefault(self.parent[c], []).append(c)
        while now in children:
            best = max(children[now], key=lambda c: (good[c], -c))
            made_for_it = self.tag[best] in MADE_FOR_TEXT
            if good[best] <= 0 or good[best] < (MAIN_TEXT if made_for_it else MOST_TEXT) * good[now] or (not made_for_it and long[now] > long[best]):
                break
            now = best
            if self.tag[now] == "article":
                break
        return now

    def path(self, c: int) -> str:
        names = []
        while c > 0:
            names.append(self.name[c])
            c = self.parent[c]
        return " ".join(reversed(names))

    def at_path(self, path: str) -> set[int]:
        """The containers at a path."""
        names, depth, out = path.split(" "), [0] * len(self.parent), set()
        for c in range(1, len(depth)):
            above = depth[self.parent[c]]
            depth[c] = above + 1 if 0 <= above < len(names) and self.name[c] == names[above] else -1
            if depth[c] == len(names):
                out.add(c)
        return out

    def text(self, containers: set[int]) -> str:
        inside = [False] * len(self.parent)
        for c in range(len(inside)):
            inside[c] = c in containers or (c > 0 and inside[self.parent[c]])
        return " ".join(text for c, text, _ in self.blocks if inside[c])


def vote(html: str | None) -> tuple[str, int]:
    page = Page(html or "")
    c = page.choice()
    return page.path(c), int(page.good()[c])


def extract(html: str | None, path: str | None) -> str:
    page = Page(html or "")
    if path and (found := page.at_path(path)):
        good = page.good()
        if sum(good[c] for c in found) >= PATH_TEXT * good[0] and (text := page.text(found)):
            return text
    return page.text({page.choice()})


def host(url) -> F.Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path: the path that most pages of a host choose; ties go to more text, then to the path's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            votes = [vote(h) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v[0] for v in votes], pa.string()), pa.array([v[1] for v in votes], pa.int64())], names=["host", "path", "chars"])

    votes = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, path string, chars long")
    counted = votes.where("chars > 0").groupBy("host", "path").agg(F.count(F.lit(1)).alias("pages"), F.sum("chars").alias("chars"))
    return counted.groupBy("host").agg(F.max_by("path", F.struct("pages", "chars", "path")).alias("path"))


def main_texts(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every (page_id, url, html)."""
    paths = small(cut(spark, host_paths(pages)), 200_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            texts = [extract(h, p) for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    named = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host(F.col("url")).alias("host"))
    return named.join(paths, "host", "left").select("page_id", "url", "html", "path").mapInArrow(run, "page_id long, url string, text string, n_chars long")
