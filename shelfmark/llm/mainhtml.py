"""Main text of web pages by consensus host paths.

Every page's containers are scored by the share of the page's readable text that they hold (text outside
menus, headers, footers, sidebars, notices, adverts, forms, comments; links do not count). Each container
votes for its generalised path of tags and classes, Spark sums the votes by host, and the page is extracted
again from the containers on the winning path. What is not readable is told by tags, roles and whole names; a name
that has other words beside a listed one (`comments-on-kant`, `menu-prices`) only raises a doubt, which the share of
links and the words inside settle, by vote of the host's pages. A page without text there falls back on the next paths of its
host that hold most of its text and then on its own best container, so no page loses its text for being
unlike the others.

Null html gives an empty text, as does a page with nothing readable. A null or malformed URL counts as the
empty host. Unclosed and stray tags, quotes and comments are tolerated; any markup is read in linear time. Repeated rows and null ids stay; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import bounded_batches, materialize

#: Paths kept for each host, in order of their votes: a host can have several templates. A page on none of them falls back on its own containers.
PATHS = 4
#: A container held by chance of its name is content if fewer of its characters are links, and it has so many words (one inside an article).
LINKS, WORDS = 0.5, 12

_NAME, _SPACE = re.compile(r"[^\s/>]++"), re.compile(r"[\s/]*+")
_ATTR = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+[\s/]*+")
#: Content that is not markup, up to the end tag.
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input meta link".split())
#: Elements within a line: they end neither a block nor a paragraph.
_QUIET = _INLINE | frozenset("script style noscript template iframe svg math object select textarea button audio video canvas".split())
_BAD_TAG = frozenset("head title nav header footer aside form menu dialog fieldset audio video canvas noscript template svg math object select button".split())
_BAD_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
_CONTAINER = frozenset("body main article section div td".split())
_SOUND = frozenset("html body main article".split())
#: Words of class names and ids. The first kind is never content, the next two alone or beside words that say nothing.
_SURE_WORD = frozenset("ad ads adv advert adverts advertisement advertising sponsored promo disqus cookie cookies consent gdpr navbar breadcrumb breadcrumbs pagination pager newsletter".split())
_BAD_WORD = frozenset("sponsor comment comments reply replies respond nav navigation menu footer share sharing social related recommended subscribe signup login popup modal overlay toolbar skip".split())
_WEAK_WORD = frozenset("sidebar side aside header masthead banner notice notices alert widget widgets topbar tags meta rail".split())
_PLAIN_WORD = frozenset("site page post posts article articles entry story main content body text title item items list box block area wrap wrapper container section inner outer top bottom left right first last bar button buttons link links icon icons form thread panel module region row column col grid card cards unit slot global primary secondary user reader readers js id the and".split())
_LAYOUT_WORD = frozenset("has with no without layout".split())
_GOOD_WORD = frozenset("article content main post entry story body text page".split())
#: What attributes make of an element.
OPEN, DOUBT, BAD = 0, 1, 2


def judged(tag: str, attrs: dict[str, str]) -> int:
    """BAD for what is never main text; DOUBT where a name on the list has words beside it that may mean anything, so that the element's text must decide."""
    if tag in _SOUND:
        return OPEN
    if tag in _BAD_TAG or attrs.get("role", "").lower() in _BAD_ROLE or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return BAD
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "")):
        return BAD
    names = [set(re.split(r"[^a-z0-9]+", n)) - {""} for n in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split()]
    doubt = False
    good = any(n <= _GOOD_WORD for n in names)
    for n in names:
        if n & _SURE_WORD:
            return BAD
        if not n & (_BAD_WORD | _WEAK_WORD):
            continue
        # a wrapper may only say that it has a sidebar, beside the name of what it is
        if not n & _BAD_WORD and (good or n & _LAYOUT_WORD):
            continue
        if any(not re.search(r"\d", w) for w in n - _BAD_WORD - _WEAK_WORD - _PLAIN_WORD):
            doubt = True
        else:
            return BAD
    return DOUBT if doubt else OPEN


def tokens(source: str) -> Iterator[tuple[str, str, dict[str, str] | None]]:
    """(text, "", None), (start tag, name, attributes) and (end tag, name, None) after another, each character read once.

    As browsers do: quotes count only after an equals sign, `<!-->` is a whole comment, raw content ends at its end
    tag. Unlike them, a quote or raw element that nothing closes does not swallow the rest of the page.
    """
    at, n, low, missing = 0, len(source), None, set()
    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            yield source[at:], "", None
            return
        if lt > at:
            yield source[at:lt], "", None
        after = source[lt + 1 : lt + 2]
        if after == "!" and source.startswith("--", lt + 2):
            if source.startswith(">", lt + 4) or source.startswith("->", lt + 4):
                at = source.index(">", lt) + 1
                continue
            end = source.find("-->", lt + 4)
            if end < 0:
                return  # an open comment is one to the end
            at = end + 3
        elif after in ("!", "?") or after == "/" and not source[lt + 2 : lt + 3].isalpha():
            end = source.find(">", lt)
            if end < 0:
                return
            at = end + 1
        elif after == "/" or after.isalpha() and after.isascii():
            closing = after == "/"
            m = _NAME.match(source, lt + 1 + closing)
            name, attrs = m[0].lower(), {}
            at = _SPACE.match(source, m.end()).end()
            while at < n and source[at] != ">":
                a = _ATTR.match(source, at)
                key, value = a[1].lower(), a[4]
                if value and value[0] in "\"'":  # opened, and closed nowhere
                    value = value[1:]
                attrs.setdefault(key, a[2] or a[3] or value or "")
                at = a.end()
            if at >= n:
                return  # a tag that does not end is none
            own = source[at - 1] == "/"
            at += 1
            if closing:
                yield "end", name, None
                continue
            yield "start", name, attrs
            if name in _RAW and name not in missing:
                if low is None:
                    low = ascii_lower(source)
                end = low.find(f"</{name}", at)
                if end >= 0:
                    at = end
                elif name in ("script", "style"):
                    return
                else:
                    missing.add(name)
                    yield "end", name, None
            elif name in missing:
                yield "end", name, None
            elif own and name in ("path", "g"):
                yield "end", name, None
        else:
            yield "<", "", None
            at = lt + 1


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def ascii_lower(text: str) -> str:
    """A-Z alone, so that no place in the text moves."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_ASCII_LOWER)


class Page:
    """Elements in page order (parent, path, tag, state, link) and runs of text (element, block, text); after settle() also bad."""

    def __init__(self, source: str) -> None:
        self.parent, self.path, self.tag, self.state, self.link, self.sound = [-1], [""], [""], [OPEN], [False], [False]
        self.runs: list[tuple[int, int, str]] = []
        stack, block = [0], 0
        for kind, tag, attrs in tokens(source):
            if not tag:
                self.runs.append((stack[-1], block, kind))
                continue
            if tag not in _QUIET:
                block += 1
            if kind == "end":
                for k in range(len(stack) - 1, max(0, len(stack) - 256), -1):  # nesting beyond that is not looked through for a stray end tag
                    if self.tag[stack[k]] == tag:
                        del stack[k:]
                        break
                    if self.tag[stack[k]] in _CONTAINER and tag not in _CONTAINER and tag not in _BAD_TAG:
                        break  # a stray end tag does not close the container around it
                continue
            if tag in _VOID:
                continue
            if tag not in _QUIET:  # a block ends an open paragraph and what is open inside it
                for k in range(len(stack) - 1, max(0, len(stack) - 256), -1):
                    if self.tag[stack[k]] == "p" or tag in ("li", "td", "th", "tr", "dt", "dd", "option") and self.tag[stack[k]] == tag:
                        del stack[k:]
                        break
                    if self.tag[stack[k]] not in _INLINE:
                        break
            if tag in ("article", "main", "body"):  # not inside something left open
                while len(stack) > 1 and self.state[stack[-1]] == BAD:
                    stack.pop()
            up = stack[-1]
            names = sorted({re.sub(r"\d+", "0", c.lower()) for c in attrs.get("class", "").split()})
            own = ".".join([tag, *names])
            self.parent.append(up)
            self.tag.append(tag)
            # far down a path says no more than its end
            self.path.append(self.path[up] if tag in _INLINE else f"{self.path[up]}>{own}" if len(self.path[up]) < 400 else f"…>{own}")
            self.state.append(BAD if self.state[up] == BAD or tag in _RAW else judged(tag, attrs))
            self.link.append(self.link[up] or tag == "a")
            self.sound.append(self.sound[up] or tag in ("article", "main"))
            stack.append(len(self.parent) - 1)

    def doubts(self) -> dict[str, int]:
        """By path of each element in doubt: how many look like content less how many do not."""
        out: dict[str, int] = {}
        if DOUBT not in self.state:
            return out
        size, links, words = ([0] * len(self.parent) for _ in range(3))
        for e, _, text in self.runs:
            if self.state[e] != BAD:
                size[e] += len(text.strip())
                links[e] += len(text.strip()) if self.link[e] else 0
                words[e] += len(text.split())
        for k in range(len(size) - 1, 0, -1):
            for sums in (size, links, words):
                sums[self.parent[k]] += sums[k]
        for k, state in enumerate(self.state):
            if state == DOUBT and size[k]:
                good = links[k] < LINKS * size[k] and words[k] >= (1 if self.sound[k] else WORDS)
                out[self.path[k]] = out.get(self.path[k], 0) + (1 if good else -1)
        return out

    def settle(self, host: dict[str, bool] | None = None) -> None:
        """Decides elements in doubt: as the host's pages did (whether a path is content), else by this page."""
        own = self.doubts()
        content = {p: v > 0 for p, v in own.items()} | {p: v for p, v in (host or {}).items() if p in own}
        self.bad = [False]
        for k in range(1, len(self.parent)):
            self.bad.append(self.bad[self.parent[k]] or self.state[k] == BAD or self.state[k] == DOUBT and not content.get(self.path[k], False))

    def votes(self) -> dict[str, float]:
        """Score by path of each container that holds at least half of the readable text."""
        held, depth = [0] * len(self.parent), [0] * len(self.parent)
        for e, _, text in self.runs:
            if not self.bad[e] and not self.link[e]:
                held[e] += len(text.strip())
        for k in range(len(held) - 1, 0, -1):
            held[self.parent[k]] += held[k]
        total, out = held[0], {}
        for k in range(1, len(held)):
            depth[k] = depth[self.parent[k]] + 1
            share = held[k] / total if total else 0
            if self.tag[k] in _CONTAINER and not self.bad[k] and share >= 0.5:
                # depth tells only containers of the same text apart
                own = share + (self.tag[k] != "body") * 0.25 + (self.tag[k] in ("article", "main")) * 0.3 + min(depth[k], 10) * 1e-8
                out[self.path[k]] = max(own, out.get(self.path[k], 0.0))
        return out

    def text(self, path: str | None) -> str:
        """Blocks under the containers on a path (all, if None), joined by one space."""
        inside = [path is None] * len(self.parent)
        for k in range(1, len(inside)):
            inside[k] = inside[self.parent[k]] or self.path[k] == path and self.tag[k] not in _INLINE
        blocks: dict[int, list[str]] = {}
        for e, block, text in self.runs:
            if inside[e] and not self.bad[e]:
                blocks.setdefault(block, []).append(text)
        found = (" ".join(unescape("".join(b)).split()) for b in blocks.values())
        return " ".join(b for b in found if b)


def extract(source: str | None, paths: list[str], doubts: dict[str, bool] | None = None) -> tuple[str, str | None]:
    """The text, and the path it was found on (None: the whole page)."""
    if not source:
        return "", None
    page = Page(source)
    page.settle(doubts)
    own = page.votes()
    there = set(page.path)
    # the host's winner counts wherever it has text, its other paths where they hold the page's text
    chosen = [p for k, p in enumerate(paths) if p in there and (k == 0 or p in own or not own)]
    for path in chosen + sorted(own, key=lambda p: -own[p]):
        if text := page.text(path):
            return text, path
    return page.text(None), None


def host() -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def host_paths(pages: DataFrame, paths: int = PATHS) -> DataFrame:
    """host, paths: the paths with most votes, best first; keep, leave: paths in doubt that are content on most of the host's pages, or are not."""
    bounded_batches(pages.sparkSession)

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counted: dict[tuple[str, str, bool], float] = {}
            for h, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not source:
                    continue
                page = Page(source)
                page.settle()
                for doubt, found in ((False, page.votes()), (True, page.doubts())):
                    for path, own in found.items():
                        counted[h, path, doubt] = counted.get((h, path, doubt), 0.0) + own
            values = [round(v * 1_000_000_000) for v in counted.values()]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counted], pa.string()), pa.array([k[1] for k in counted], pa.string()), pa.array([k[2] for k in counted], pa.bool_()), pa.array(values, pa.int64())], ["host", "path", "doubt", "votes"])

    cast = pages.select(host().alias("host"), F.col("html").cast("string").alias("html"))
    summed = cast.mapInArrow(votes, "host string, path string, doubt boolean, votes long").groupBy("host", "path", "doubt").agg(F.sum(F.col("votes").cast("decimal(38,0)")).alias("votes"))
    best = F.row_number().over(Window.partitionBy("host", "doubt").orderBy(F.desc("votes"), "path"))
    ranked = summed.withColumn("k", best).where(F.col("doubt") | (F.col("k") <= paths))
    mine = lambda good: F.sort_array(F.collect_list(F.when(F.col("doubt") & ((F.col("votes") > 0) == F.lit(good)), F.col("path"))))
    first = F.array_sort(F.collect_list(F.when(~F.col("doubt"), F.struct("k", "path"))))
    grouped = ranked.groupBy("host").agg(first.alias("p"), mine(True).alias("keep"), mine(False).alias("leave"))
    return materialize(grouped.select("host", F.col("p.path").alias("paths"), "keep", "leave"))


def main_texts(pages: DataFrame, paths: int = PATHS) -> DataFrame:
    """page_id, url, text, n_chars (code points), path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for source, found, keep, leave in zip(*(b.column(k).to_pylist() for k in range(2, 6)), strict=True):
                made.append(extract(source, found or [], dict.fromkeys(keep or [], True) | dict.fromkeys(leave or [], False)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([m[0] for m in made], pa.string()), pa.array([len(m[0]) for m in made], pa.int64()), pa.array([m[1] for m in made], pa.string())], ["page_id", "url", "text", "n_chars", "path"])

    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    both = base.withColumn("host", host()).join(host_paths(pages, paths), "host", "left")
    return both.select("page_id", "url", "html", "paths", "keep", "leave").mapInArrow(run, "page_id long, url string, text string, n_chars long, path string")
