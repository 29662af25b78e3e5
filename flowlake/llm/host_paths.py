"""Main-text extraction by the container paths that the pages of a host agree on.

Each page is parsed into blocks and containers. A container's score is the text of its blocks, less their link
text, with a bonus for what names itself the content; the page votes for the path of its best container, or of the
deepest one in it that holds the same unlinked text. Unless the best one names itself the content, it must hold all
unlinked text of the page, so that none is lost for standing apart. A path is the chain of tags with their classes,
digits generalised, so pages of one template share it. Spark counts the votes of every host; the paths with a fair share
win. Every page is then read again with its host's winning paths, in order of votes; a path counts on a page only if it
holds no less unlinked text than the page's own best container. A page without any of them falls back on its own.

Inside the chosen containers, menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments are left out, found by tag or by words of class, id and role. Names that only describe (``no-sidebar``,
``tag-social``) do not count, and what names itself content keeps its text. Where the words would take most of a
page's unlinked text, the page is read again with the containers that hold its content or all there is. Character
references are decoded, white space within a block becomes one space, blocks are joined by one space in page order.
A ``<`` before a letter opens a tag, to its end outside of quotes or, if a quote is not closed, to the next ``>`` or the
end of the page; no markup becomes text.

Votes are one row per host and path; the winners are broadcast if they are few (``BROADCAST_HOSTS``) and joined
by host otherwise, where Spark splits a host that holds much of the table.

Edge cases: null and empty html have empty text; unclosed and misplaced tags are closed by their parents; an
unterminated comment or script runs to the end of the page; a null url counts as the empty host; rows that
repeat a page are rows of their own; an empty table gives an empty result; further columns are passed on.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake.session import cut_lineage

#: A path wins if at least this share of its host's pages vote for it.
WINNING_SHARE = 0.05
#: Hosts whose winners are broadcast (at most 20 paths each, 8 bytes a path).
BROADCAST_HOSTS = 100_000
#: Readings of a page whose words leave out most of its text at every depth; the last one disregards the words.
MOST_READINGS = 6
_CONTENT_BONUS = 1.3

#: Fixed values of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td
    tfoot th thead title tr ul""".split())
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
             "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
_SCOPES = frozenset("ul ol dl table select menu div section article body".split())
#: What names itself content, and what is not part of an article.
_CONTAINERS = frozenset("article main section div body td".split())
_CONTENT = frozenset("article articlebody content entry main post story".split())
_LEFT_OUT_TAGS = frozenset("""aside audio button canvas dialog footer form head header menu nav noscript object select svg template
    video""".split())
_LEFT_OUT_WORDS = frozenset("""ad ads advert advertisement advertising adverts aside banner breadcrumb breadcrumbs comment comments
    consent cookie cookies copyright disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice
    notices outbrain overlay pager pagination popup promo promotion promoted recommended related replies respond search share sharing
    sidebar signup social sponsor sponsored subscribe subscription taboola toolbar widget contentinfo complementary""".split())

#: Reader comments: as large as they may be, they are left out as long as the page has other text.
_READERS = frozenset("comment comments disqus replies respond".split())
#: A name that begins with one of these tells what an element has or is filed under, not what it is.
_DESCRIBES = frozenset("cat category has hide is no not show tag with without".split())
#: Words that may stand beside those of ``_CONTENT`` in the name of a content element.
_CONTENT_TOO = _CONTENT | {"body", "text"}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_WORDS = re.compile(r"[a-z]+|[0-9]+")
_DIGITS = re.compile(r"\d+")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Container(NamedTuple):
    """A container: path, blocks it spans, depth, whether it names itself the content; its number and that of the
    container around it (0 for none), in order of opening."""
    path: int
    first: int
    end: int
    depth: int
    content: bool
    number: int
    parent: int


class Worded(NamedTuple):
    """An outermost element left out by its words: its number on the page, characters of its text less those of its
    links, whether it is a container, has content elements or a main heading, holds reader comments, begins a name
    with such a word."""
    number: int
    chars: int
    container: bool
    content: bool
    readers: bool
    named: bool


class Page(NamedTuple):
    """Blocks of a page in order, as (text, link characters), without what is left out; its containers; the number of
    the innermost container of each block."""
    blocks: list[tuple[str, int]]
    containers: list[Container]
    owners: list[int]


class Described(NamedTuple):
    """Generalised classes; words of class, id and role, each name's by itself; whether the element is hidden."""
    classes: str = ""
    names: tuple[tuple[str, ...], ...] = ()
    hidden: bool = False

    def is_content(self, whole: bool = False) -> bool:
        """Whether a name has a word for content, or, if ``whole``, is made of such words."""
        if whole:
            return any(not _CONTENT.isdisjoint(n) and _CONTENT_TOO.issuperset(n) for n in self.names)
        return any(not _CONTENT.isdisjoint(n) for n in self.names)

    def left_out(self) -> list[tuple[str, ...]]:
        """The names that say that this is no part of an article."""
        return [n for n in self.names if n[0] not in _DESCRIBES and not _LEFT_OUT_WORDS.isdisjoint(n)]


_PLAIN = Described()


def _described(attributes: str) -> Described:
    classes, names, hidden = "", [], False
    for found in _NAMES.finditer(attributes):
        name = found.group(1).lower()
        value = (found.group(2) or found.group(3) or found.group(4) or "").lower()
        if name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden |= value == "true"
        elif name == "style":
            hidden |= bool(_INVISIBLE.search(value))
        else:
            names += [words for words in map(tuple, map(_WORDS.findall, value.split())) if words]
            if name == "class":
                classes = ".".join(sorted(_DIGITS.sub("#", value).split()))
    return Described(classes, tuple(names), hidden)


def parse(html: str) -> Page:
    """Blocks and containers of a page; it is read again as long as the words leave out most of its unlinked text."""
    kept: frozenset[int] = frozenset()
    for _ in range(MOST_READINGS - 1):
        page, worded = _read(html, kept)
        more = _kept_after_all(page, worded)
        if not more:
            return page
        kept |= more
    return _read(html, None)[0]


def _kept_after_all(page: Page, worded: list[Worded]) -> frozenset[int]:
    """The elements that are to keep their text although their words say otherwise."""
    removed = sum(w.chars for w in worded)
    rest = sum(max(0, len(text) - 2 * linked) for text, linked in page.blocks)
    if removed <= rest:
        return frozenset()
    large = [w for w in worded if w.container and w.chars]
    found = [w for w in large if w.content and not w.readers]
    if not found and not any(c.content and any(len(t) > 2 * n for t, n in page.blocks[c.first:c.end]) for c in page.containers):
        found = [w for w in large if not w.named and not w.readers]
    if not found and not rest:
        found = [w for w in large if not w.readers] or large
    return frozenset(w.number for w in found)


def _read(html: str, kept: frozenset[int] | None) -> tuple[Page, list[Worded]]:
    """One pass over the tags; elements whose numbers are in ``kept`` (all, if None) are not left out by their words."""
    blocks: list[tuple[str, int]] = []
    containers: list[Container] = []
    owners: list[int] = []
    around = [0]  # numbers of the open containers
    stack: list[list] = []  # [tag, path, left out, first block, content, what its words leave out]
    opened: dict[str, int] = {}
    text: list[str] = []
    linked = 0
    left_out = links = worded = number = within = 0
    found_words: list[Worded] = []
    held, holds = 0, False  # of the outermost element left out by its words

    def end_block() -> None:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                blocks.append((joined, min(linked, len(joined))))
                owners.append(around[-1])
            text.clear()
            linked = 0

    def close() -> None:
        nonlocal left_out, links, worded, within, held, holds
        tag, path, out, first, content, by_words = stack.pop()
        opened[tag] -= 1
        if tag in _BLOCK:
            end_block()
        if tag in _CONTAINERS:
            own = around.pop()
            if not left_out and not worded:
                containers.append(Container(path, first, len(blocks), len(stack), content, own, around[-1]))
        left_out -= out
        links -= tag == "a"
        within -= content
        if by_words:
            worded -= 1
            if not worded and not left_out:
                found_words.append(by_words._replace(chars=max(0, held), content=holds))
                held, holds = 0, False

    at, end = 0, len(html)
    while at < end:
        token = _TOKEN.search(html, at)
        stop = token.start() if token else end
        if stop > at and not left_out:
            piece = entities.unescape(html[at:stop])
            if worded:
                held += -len(piece.strip()) if links else len(piece.strip())
            else:
                text.append(piece)
                linked += len(piece) if links else 0
        if not token:
            break
        at = token.end()
        closing, tag, attributes = token.group(1, 2, 3) if token.group(2) else token.group(4, 5, 6)
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if opened.get(tag):
                while stack[-1][0] != tag:
                    close()
                close()
            elif tag == "p":
                end_block()
            continue
        if tag in _RAW:
            ended = re.compile(f"</{tag}[^>]*>", re.I).search(html, at)
            at = ended.end() if ended else end
            continue
        if tag == "br":
            text.append(" ")
        if tag in _BLOCK:
            if opened.get("p"):
                while stack[-1][0] != "p":
                    close()
                close()
            for k in range(len(stack) - 1, max(-1, len(stack) - 8), -1) if tag in _SIBLINGS else ():
                if stack[k][0] in _SIBLINGS[tag]:
                    while len(stack) > k:
                        close()
                elif stack[k][0] in _SCOPES:
                    break
            end_block()
        if tag in _VOID or attributes.endswith("/") and tag not in _BLOCK:
            continue
        about = _described(attributes) if attributes else _PLAIN
        out = int(tag in _LEFT_OUT_TAGS or about.hidden)
        number += 1
        by_words = None
        if not out and kept is not None and number not in kept and tag not in ("html", "body", "main") and (names := about.left_out()) and not about.is_content(whole=True):
            # an article is left out only if it is a part of other content and its whole name says so, as of a reader's comment
            if tag != "article" or within and any(len(n) == 1 for n in names):
                by_words = Worded(number, 0, tag in _CONTAINERS, False, any(not _READERS.isdisjoint(n) for n in names), any(n[0] in _LEFT_OUT_WORDS for n in names))
        if out or by_words:
            end_block() if tag in _BLOCK else None
        parent = stack[-1][1] if stack else 0
        path = xxhash.xxh64_intdigest(f"{tag}.{about.classes}", parent) if tag in _CONTAINERS or tag in _BLOCK else parent
        content = tag in ("article", "main") or tag not in ("html", "body") and about.is_content()
        if worded and not left_out and not out and not by_words:
            holds |= tag in ("article", "main", "h1") or about.is_content(whole=True)
        worded += by_words is not None
        within += content
        stack.append([tag, path, out, len(blocks), content, by_words])
        if tag in _CONTAINERS:
            around.append(number)
        opened[tag] = opened.get(tag, 0) + 1
        left_out += out
        links += tag == "a"
    while stack:
        close()
    end_block()
    return Page(blocks, containers, owners), found_words


def _unlinked(block: tuple[str, int]) -> int:
    """Characters of a block that count as text of an article."""
    return max(0, len(block[0]) - 2 * block[1])


def best_container(page: Page) -> tuple[int, int] | None:
    """(path, characters) of the best container, or of the deepest one in it that holds the same unlinked text.

    None if no container names itself the content and none holds all unlinked text of the page.
    """
    total = [0]
    for block in page.blocks:
        total.append(total[-1] + _unlinked(block))
    held = {c.number: total[c.end] - total[c.first] for c in page.containers}
    scored = {c.number: held[c.number] * (_CONTENT_BONUS if c.content else 1.0) for c in page.containers}
    best = max(scored.values(), default=0)
    if best <= 0:
        return None
    opened = sorted(page.containers, key=lambda c: c.number)
    top = next(c for c in opened if scored[c.number] == best)
    if not top.content and held[top.number] < total[-1]:
        return None
    chosen, inside = top, {top.number}
    for c in opened:
        if c.parent in inside and held[c.number] == held[top.number]:
            chosen = c
            inside.add(c.number)
    return chosen.path, held[top.number]


def blocks_at(page: Page, path: int) -> list[int]:
    """The blocks of all containers with this path, each once, in page order."""
    return sorted({k for c in page.containers if c.path == path for k in range(c.first, c.end)})


def text_at(page: Page, path: int) -> str:
    """The blocks of all containers with this path, each once, in page order."""
    return " ".join(page.blocks[k][0] for k in blocks_at(page, path))


def main_text(html: str | None, paths: list[int]) -> str:
    """The text at the first of ``paths`` that holds no less unlinked text than the page's own best container; else at that
    container, else all blocks."""
    page = parse(html or "")
    present = {c.path for c in page.containers}
    own = best_container(page)
    least = own[1] if own else sum(map(_unlinked, page.blocks))
    for path in paths:
        if path in present:
            held = blocks_at(page, path)
            if held and sum(_unlinked(page.blocks[k]) for k in held) >= least:
                return " ".join(page.blocks[k][0] for k in held)
    return text_at(page, own[0]) if own else " ".join(text for text, _ in page.blocks)


def _signed(path: int) -> int:
    return path - (1 << 64) if path >> 63 else path


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, paths, chars = [], [], []
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = best_container(parse(html or ""))
            if own:
                hosts.append(host)
                paths.append(_signed(own[0]))
                chars.append(own[1])
        yield pa.RecordBatch.from_pydict({"_host": pa.array(hosts, pa.string()), "path": pa.array(paths, pa.int64()), "chars": pa.array(chars, pa.int64())})


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def winning_paths(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(_host, _paths): per host the paths that win, most votes first."""
    votes = pages.select("_host", html_col).mapInArrow(_votes, "_host string, path long, chars long")
    counted = votes.groupBy("_host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum("chars").alias("chars"))
    share = counted.withColumn("all", F.sum("votes").over(Window.partitionBy("_host"))).filter(F.col("votes") >= WINNING_SHARE * F.col("all"))
    ranked = F.sort_array(F.collect_list(F.struct("votes", "chars", "path")), asc=False)  # at most 1 / WINNING_SHARE paths
    return share.groupBy("_host").agg(ranked.alias("r")).select("_host", F.col("r.path").alias("_paths"))


def _extract(html_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            html, paths = columns.pop(html_col).to_pylist(), columns.pop("_paths").to_pylist()
            texts = [main_text(h, [p % (1 << 64) for p in x or ()]) for h, x in zip(html, paths)]
            columns["_text"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_pydict(columns)
    return run


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` without the html, with ``_text`` in place of a column of that name; ``_host`` and ``_paths`` are its own."""
    pages = pages.drop("_text", "_paths").withColumn("_host", host_of(F.col(url_col)))
    winners = cut_lineage(winning_paths(pages, html_col), "paths")
    few = winners.count() <= BROADCAST_HOSTS
    found = pages.join(F.broadcast(winners) if few else winners, "_host", "left").drop("_host")
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name not in ("_host", html_col)), "_text string"])
    return found.mapInArrow(_extract(html_col), fields)


def query(spark, sf_dir: str) -> DataFrame:
    found = extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))
