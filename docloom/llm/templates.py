"""Main text of web pages by site template removal.

Every block element of a page is a subtree, known by a hash of its tag and texts and of its children's hashes. Spark
counts on how many different pages of a host each subtree stands; subtrees that recur on many of them are the site's
template and are cut out of each page before its text is taken, whether they stand beside the articles or inside one.
Inside an article only containers are judged, not paragraphs, headings, lists and tables, since passages that articles
share are content; and there a subtree has to recur in so many different articles, so that copies of one article are one.
Elements that say what they are (menus, headers, footers, sidebars, notices,
adverts, forms, comments, scripts, styles, hidden parts) go by tag, class, id or role, which also serves hosts with too few
pages to count; a form or a noise word takes no element that holds an article or most of the text. Where a page marks
articles, the text comes from all of them, and from main elements without one, in page order.

Subtrees are counted with map-side aggregation. Each page's subtrees meet the recurring ones by host and hash, one row
each, so a host's list may be of any length: a page gets only those that it holds, joined back by its own hash.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.columnar import binary
from docloom.llm.tables import at_least, register, table
from docloom.session import cut_lineage

LEAST_PAGES = 5  # a template part stands on so many different pages of its host, however large the host

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li legend main menu nav ol option optgroup p pre search section summary table tbody td tfoot th thead tr ul".split()
)
SIBLINGS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
P_KEEPS = frozenset("html body article main section div td th li blockquote".split())
NOT_TEXT = RAW | frozenset("head nav footer aside form button select dialog menu search object audio video canvas".split())
# Words that classes, ids and roles use for what is not the article.
NOISE = frozenset(
    "ad ads adv advert advertisement adverts alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies dialog discussion disqus footer form gdpr hidden login menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
# Elements inside an article that can be a part of the site's template; all others there are running text.
CONTAINERS = frozenset("aside details dialog div fieldset footer form header hgroup menu nav search section".split())
SITE_HEADS = frozenset("header masthead topbar".split())
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>""", re.S)
_NAMES = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
# A name with one of these words (with-sidebar, comments-open) says what an element has, not what it is.
HAS = frozenset("with has have no not without open closed enabled disabled".split())
_WORD = re.compile(r"[a-z]+")
_ANY_WORD = re.compile(r"\w")


class Page:
    """Elements and texts of a page, in order."""

    def __init__(self, source: str):
        self.tags: list[str] = ["#"]
        self.parents: list[int] = [0]
        self.first: list[int] = [0]
        self.last: list[int] = [0]
        self.noise: list[bool] = [False]
        self.named: list[bool] = [False]  # a form, or noise by class, id or role
        self.site_head: list[bool] = [False]
        self.tokens: list[tuple[int, str | None]] = []  # element, and its text or None where a block begins or ends
        self._open = [0]
        self._open_names: Counter[str] = Counter()
        at = 0
        for match in self._matches(source):
            if match.start() > at:
                self.tokens.append((self._open[-1], source[at : match.start()]))
            at = match.end()
            name = match[2]
            if name is None:
                continue
            name = name.lower()
            if match[1]:
                self._end(name)
            else:
                self._start(name, match[3])
        if at < len(source):
            self.tokens.append((self._open[-1], source[at:]))
        while len(self._open) > 1:
            self._close()
        self.last[0] = len(self.tokens)

    def _matches(self, source: str) -> Iterator[re.Match]:
        at = 0
        while match := _TOKEN.search(source, at):
            yield match
            at = match.end()
            name = match[2] and not match[1] and match[2].lower()
            if name in RAW and not match[3].rstrip().endswith("/"):  # its content is no markup
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
                at = end.start() if end else len(source)

    def _start(self, name: str, attributes: str) -> None:
        if name in BLOCKS and name not in VOID:
            self._close_within({"p"}, P_KEEPS)
        if name in SIBLINGS:
            self._close_within(SIBLINGS[name], SCOPES.get(name, frozenset()) if name != "p" else P_KEEPS)
        if name in VOID:
            self.tokens.append((self._open[-1], None if name == "hr" else " " if name == "br" else ""))
            return
        noise, form, head = name in NOT_TEXT and name != "form", name == "form", name == "header"
        if attributes:
            for key, value in _NAMES.findall(attributes):
                key, words = key.lower(), set(_WORD.findall(value.lower()))
                if key == "hidden" or key == "aria-hidden" and "true" in words or key == "style" and {"display", "none"} <= words:
                    noise = True
                elif key in ("class", "id", "role") and name not in ("html", "body"):
                    named = [own for x in html.unescape(value).lower().strip("\"'").split() if not HAS & (own := set(_WORD.findall(x)))]
                    form |= any(own & NOISE for own in named)
                    head |= any(own & SITE_HEADS for own in named)
        parent = self._open[-1]
        self.tags.append(name)
        self.parents.append(parent)
        self.first.append(len(self.tokens))
        self.last.append(len(self.tokens))
        self.noise.append(noise)
        self.named.append(form)
        self.site_head.append(head)
        self._open.append(len(self.tags) - 1)
        self._open_names[name] += 1
        if name in BLOCKS:
            self.tokens.append((len(self.tags) - 1, None))
        if attributes.rstrip().endswith("/"):
            self._close()

    def _close(self) -> None:
        element = self._open.pop()
        self._open_names[self.tags[element]] -= 1
        if self.tags[element] in BLOCKS:
            self.tokens.append((element, None))
        self.last[element] = len(self.tokens)

    def _close_within(self, names: set[str], stop: frozenset[str] | set[str]) -> None:
        if not any(self._open_names[name] for name in names):
            return
        for depth in range(len(self._open) - 1, 0, -1):
            tag = self.tags[self._open[depth]]
            if tag in names:
                while len(self._open) > depth:
                    self._close()
                return
            if tag in stop:
                return

    def _end(self, name: str) -> None:
        if not self._open_names[name]:
            return
        for depth in range(len(self._open) - 1, 0, -1):
            if self.tags[self._open[depth]] == name:
                while len(self._open) > depth:
                    self._close()
                return

    def dropped(self) -> list[bool]:
        """Which elements say themselves that they are no main text.

        A form, or an element with a noise word, stays if it holds an article or main element that is not noise itself, or
        more than half of the page's text.
        """
        out = [False] * len(self.tags)
        article = [False] * len(self.tags)
        holds = self._holds() if any(self.named) or any(self.site_head) else out
        for e in range(1, len(self.tags)):
            parent = self.parents[e]
            article[e] = article[parent] or self.tags[e] in ("article", "main")
            out[e] = out[parent] or self.noise[e] or self.named[e] and not holds[e] or self.site_head[e] and not article[parent] and (self.tags[e] == "header" or not holds[e])
        return out

    def _holds(self) -> list[bool]:
        """Which elements hold an article (main) that is not noise, or are one, or hold most of the text."""
        silent = [False] * len(self.tags)
        for e in range(1, len(self.tags)):
            silent[e] = silent[self.parents[e]] or self.noise[e]
        sizes = [0]
        for element, text in self.tokens:
            sizes.append(sizes[-1] + (len("".join(text.split())) if text and not silent[element] else 0))
        out = [2 * (sizes[self.last[e]] - sizes[self.first[e]]) > sizes[-1] for e in range(len(self.tags))]
        holding = self._around([e for e in range(1, len(self.tags)) if self.tags[e] in ("article", "main") and not silent[e] and not self.named[e]])
        return [a or b for a, b in zip(out, holding)]

    def _around(self, elements: list[int]) -> list[bool]:
        """Which elements are one of these or hold one, but for the root."""
        out = [False] * len(self.tags)
        for e in elements:
            while e and not out[e]:
                out[e], e = True, self.parents[e]
        return out

    def main(self, dropped: list[bool]) -> list[int]:
        """The articles outside other articles and the main elements without one, in page order, else the whole page."""
        around = self._around([e for e, tag in enumerate(self.tags) if tag == "article" and not dropped[e]])
        inside = [False] * len(self.tags)
        found: list[int] = []
        for e in range(1, len(self.tags)):
            inside[e] = inside[self.parents[e]]
            if not inside[e] and not dropped[e] and (self.tags[e] == "article" or self.tags[e] == "main" and not around[e]):
                inside[e] = True
                found.append(e)
        return found or [0]

    def hashes(self) -> tuple[list[int], list[bool]]:
        """A hash of each element, from its texts and its children's hashes in order, and whether it has a word."""
        content: list[list[str]] = [[] for _ in self.tags]
        begun = 1
        for at, (element, text) in enumerate([*self.tokens, (0, None)]):
            while begun < len(self.tags) and self.first[begun] <= at:
                content[self.parents[begun]].append(begun)
                begun += 1
            if text and (words := " ".join(text.split())):
                content[element].append(words)
        out, worded = [0] * len(self.tags), [False] * len(self.tags)
        for e in range(len(self.tags) - 1, -1, -1):  # children come after their parents
            own = xxhash.xxh3_64(self.tags[e])
            for part in content[e]:
                if isinstance(part, int):
                    own.update(b"<%016x" % out[part])
                    worded[e] = worded[e] or worded[part]
                else:
                    own.update(b">" + part.encode("utf-8", "surrogatepass"))
                    worded[e] = worded[e] or _ANY_WORD.search(part) is not None
            out[e] = own.intdigest()
        return out, worded

    def subtrees(self) -> dict[int, tuple[int, int]]:
        """Elements that may be template: the hash of each, and of the outermost article around it or else 0.

        These are block elements with a word, but for articles, what holds one, whatever holds more than half of an article, and
        running text inside articles.
        """
        articles = [e for e in self.main(self.dropped()) if e]
        around, (known, worded) = self._around(articles), self.hashes()
        sizes = [0]
        for _, text in self.tokens:
            sizes.append(sizes[-1] + (len("".join(text.split())) if text else 0))
        article = [0] * len(self.tags)
        for e in articles:
            article[e] = e
        out = {}
        for e in range(1, len(self.tags)):
            top = article[e] = article[e] or article[self.parents[e]]
            if self.tags[e] not in BLOCKS or self.tags[e] in ("html", "body") or around[e] or not worded[e]:
                continue
            if top and (self.tags[e] not in CONTAINERS or 2 * (sizes[self.last[e]] - sizes[self.first[e]]) > sizes[self.last[top]] - sizes[self.first[top]]):
                continue
            out[e] = known[e] - (1 << 63), known[top] - (1 << 63) if top else 0
        return out

    def text(self, template: frozenset[int] = frozenset()) -> str:
        dropped = self.dropped()
        if template:
            for e, (own, _) in self.subtrees().items():
                if own in template:
                    dropped[e] = True
            for e in range(1, len(self.tags)):
                dropped[e] = dropped[e] or dropped[self.parents[e]]
        blocks: list[str] = []
        parts: list[str] = []
        for element, text in [x for e in self.main(dropped) for x in [*self.tokens[self.first[e] : self.last[e]], (0, None)]]:
            if text is None:
                if block := " ".join("".join(parts).split()):
                    blocks.append(block)
                parts = []
            elif not dropped[element]:
                parts.append(html.unescape(text))  # a reference split over elements is none
        return "\n".join(blocks)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, subtrees, pages, places = [], [], [], []
        for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            if source:
                page = xxhash.xxh3_128_digest(source.encode("utf-8", "surrogatepass"))
                own = {(e, article or int.from_bytes(page[:8], "big", signed=True)) for e, article in Page(source).subtrees().values()}
                hosts += [host] * len(own)
                subtrees += [e for e, _ in own]
                pages += [page] * len(own)
                places += [place for _, place in own]
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(subtrees, pa.int64()), binary(pages), pa.array(places, pa.int64())], names=["host", "subtree", "page", "place"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_ = zstandard.ZstdDecompressor()
    for batch in batches:
        texts = []
        for packed, size, template in zip(batch.column("packed"), batch.column("size").to_pylist(), batch.column("template").to_pylist()):
            source = open_.decompress(packed.as_py(), max_output_size=size).decode("utf-8", "replace") if size else ""
            texts.append(Page(source).text(frozenset(template or ())))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        raw = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), batch.column("host"), binary([xxhash.xxh3_128_digest(r) for r in raw]), binary([press.compress(r) for r in raw]), pa.array(np.array([len(r) for r in raw], np.int64))], names=["page_id", "url", "host", "page", "packed", "size"])


def template_parts(pages: DataFrame, least: int = LEAST_PAGES) -> DataFrame:
    """host, page (hash) and those of its subtrees (array of hashes) that recur in so many different places of the host.

    A place is a page, or for what stands inside an article that article's content.
    """
    parts = cut_lineage(pages.mapInArrow(_parts, "host string, subtree bigint, page binary, place bigint").distinct())
    places = parts.select("host", "subtree", "place").distinct().groupBy("host", "subtree").count()
    many = cut_lineage(places.where(F.col("count") >= least).select("host", "subtree"))
    return parts.join(many, ["host", "subtree"]).groupBy("host", "page").agg(F.collect_set("subtree").alias("template"))


def main_text(pages: DataFrame, least: int = LEAST_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of each page row.

    A null or empty html gives an empty text; a null or odd url belongs to the host ''. Repeated rows give a row each and count as
    one page for the template. Text blocks are joined by a newline, white space inside one is a single space, and
    character references are decoded. Other columns are ignored.
    """
    pages = at_least(pages, ["page_id", "url", "html"])
    pages = pages.withColumn("host", F.lower(F.coalesce(F.regexp_extract("url", r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit(""))))
    packed = pages.mapInArrow(_packed, "page_id bigint, url string, host string, page binary, packed binary, size bigint")
    joined = packed.join(cut_lineage(template_parts(pages, least)), ["host", "page"], "left")
    return joined.select("page_id", "url", "packed", "size", "template").mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")


@register("op1_site_templates")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return main_text(table(spark, folder, "pages"))
