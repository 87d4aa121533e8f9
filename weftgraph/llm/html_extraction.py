"""Operator 12: main text of web pages, by paths on which the pages of a host agree.

Each page's containers are scored by the text of the paragraphs they hold. A page votes
for its containers' generalised paths, with shares that sum to a thousand; Spark adds the
votes of a host. Then each page is extracted by the winning paths of its host: the first
that leads to text on the page. A page without one, or without a host, keeps its own
best container.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, stored

SLICE_BYTES = 4 << 20
PATH_DEPTH = 48  # elements further down have the path of their ancestor at this depth
SHARES = 1000
WINNER_PART = 20  # a path wins with a twentieth of its host's votes, so at most so many do
BROADCAST_HOSTS = 20_000  # more hosts are joined by a shuffle
SALT = 64

# Elements of HTML by their part in the layout, and names that sites give to what is no article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp svg math object canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th figcaption caption summary".split())
INNER = frozenset("ul ol dl menu table tbody thead tfoot tr blockquote figure".split())
DROPPED = frozenset("nav aside footer form dialog menu button select input label search".split()) | RAW - {"xmp"}
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar form".split())
DROPPED_NAMES = frozenset(
    "ad ads adv banner comment comments commentlist consent cookie cookies footer gdpr header login masthead menu menubar modal nav navbar navigation notice notices "
    "outbrain pager pagination popup privacy promo promoted promotion related replies reply respond search share sharing sidebar signup social subscribe taboola toolbar "
    "topbar warning widget widgets".split()
)
DROPPED_BEGINNINGS = ("advert", "adsense", "breadcrumb", "commentbox", "commentform", "cookie", "disqus", "navbar", "newsletter", "sidebar", "sponsor", "usercomment")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# A start of one of these ends an open element of those, unless an element of the last group stands between.
ENDED_BY = {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "tbody": (frozenset("thead tbody tfoot tr td th".split()), frozenset(["table"])),
    "tfoot": (frozenset("thead tbody tfoot tr td th".split()), frozenset(["table"])),
}

ATTRIBUTES = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
WORDS = re.compile(r"[\s_:-]+|(?<=[a-z])(?=[A-Z])")
NUMBERED = re.compile(r"[0-9]+|(?<![a-z])[0-9a-f]{8,}(?![a-z])")


@dataclass
class Page:
    """Elements of a page in the order of their starts, and its text."""

    tag: list[str] = field(default_factory=list)
    path: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)  # behind the last element inside
    dropped: list[bool] = field(default_factory=list)
    main: list[bool] = field(default_factory=list)  # in an article or main part
    holder: list[int] = field(default_factory=list)  # the container that text of the element counts for
    headers: list[int] = field(default_factory=list)  # headers by tag or name
    text: list[tuple[int, str, bool]] = field(default_factory=list)  # element, text (a space where a block begins or ends), in a link


def drop_reason(tag: str, attributes: dict[str, str]) -> str:
    """Why an element is no part of an article: "tag", "name", "header" (by either), or an empty string if it may be one."""
    if tag == "header":
        return "header"
    if tag in DROPPED or attributes.get("role", "").lower() in DROPPED_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return "tag"
    if re.search(r"display:\s*none", attributes.get("style", "")):
        return "tag"
    reason = ""
    if tag not in ("html", "body", "main"):
        for name in (*attributes.get("class", "").split(), attributes.get("id", "")):
            words = [w.lower().rstrip("0123456789") for w in WORDS.split(name) if w]
            if words and words[0] not in ("has", "with", "no", "without", "is"):
                if any(w.startswith(DROPPED_BEGINNINGS) for w in words) or not (DROPPED_NAMES - {"header"}).isdisjoint(words):
                    return "name"
                if "header" in words:
                    reason = "header"
    return reason


def label(tag: str, attributes: dict[str, str]) -> str:
    """A tag with its sorted classes; numbers and hexadecimal names in these are told apart no more."""
    classes = sorted({NUMBERED.sub("#", c.lower()) for c in attributes.get("class", "").split()})
    return ".".join([tag, *classes])


def parse(html: str) -> Page:
    """Elements and texts of a page, whatever its state: open elements end with their parents, a tag cut off at the end is none."""
    page = Page()
    page_tag, text = page.tag, page.text
    open_, open_tags, at, n = [], defaultdict(int), 0, len(html)
    links = 0

    def start(tag: str, attributes: dict[str, str]) -> None:
        nonlocal links
        above = open_[-1] if open_ else -1
        path = page.path[above] if open_ else ""
        if len(open_) < PATH_DEPTH and tag in BLOCK:
            path = f"{path}/{label(tag, attributes)}" if path else label(tag, attributes)
        reason, own = drop_reason(tag, attributes), len(page_tag)
        page.parent.append(above)
        page.path.append(path)
        page.end.append(0)
        page.dropped.append(reason in ("tag", "name") or (above >= 0 and page.dropped[above]))
        main = tag in ("article", "main") or attributes.get("role") == "main" or attributes.get("itemprop") == "articleBody"
        inherits = above >= 0 and (page.main[above] or tag not in BLOCK or tag in PARAGRAPH or tag in INNER)
        page.holder.append(own if main or not inherits else page.holder[above])
        page.main.append(main or (above >= 0 and page.main[above]))
        if reason == "header":
            page.headers.append(own)
        page_tag.append(tag)
        open_.append(own)
        open_tags[tag] += 1
        links += tag == "a"

    def close(down_to: int) -> None:
        nonlocal links
        while len(open_) > down_to:
            e = open_.pop()
            page.end[e] = len(page_tag)
            links -= page_tag[e] == "a"
            open_tags[page_tag[e]] -= 1
            if page_tag[e] in BLOCK:
                text.append((e, " ", False))

    def innermost(tags: frozenset[str], until: frozenset[str]) -> int | None:
        if not any(open_tags[t] for t in tags):
            return None
        for depth in range(len(open_) - 1, -1, -1):
            if page_tag[open_[depth]] in tags:
                return depth
            if page_tag[open_[depth]] in until:
                return None
        return None

    start("html", {})
    while at < n:
        lt = html.find("<", at)
        if lt != at:
            piece = html[at : lt if lt >= 0 else n]
            text.append((open_[-1], unescape(piece) if "&" in piece else piece, links > 0))
            if lt < 0:
                break
        following = html[lt + 1 : lt + 2]
        if html.startswith("<!--", lt):
            gt = html.find("-->", lt + 4)
            at = gt + 3 if gt >= 0 else n
        elif following in ("!", "?"):
            gt = html.find(">", lt)
            at = gt + 1 if gt >= 0 else n
        elif following.isascii() and (following.isalpha() or (following == "/" and html[lt + 2 : lt + 3].isalpha())):
            found = TAG.match(html, lt)
            if not found:  # cut off
                break
            at = found.end()
            tag = found[2].lower()
            if found[1]:
                depth = innermost(frozenset([tag]), frozenset() if tag in BLOCK else BLOCK - {"br", "hr"})
                if depth:  # the root stays open
                    close(depth)
                continue
            if tag in ("br", "hr"):
                text.append((open_[-1], " ", False))
            if tag in VOID:
                continue
            attributes = {}
            for m in ATTRIBUTES.finditer(found[3]):
                attributes.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
            if tag == "html":
                continue
            if tag in BLOCK:
                depth = innermost(frozenset(["p"]), BLOCK - {"p"})
                if depth:
                    close(depth)
                if tag in ENDED_BY:
                    ended, until = ENDED_BY[tag]
                    while (depth := innermost(ended, until)) is not None:
                        close(depth)
                if tag in HEADINGS and page_tag[open_[-1]] in HEADINGS:
                    close(len(open_) - 1)
                text.append((open_[-1], " ", False))
            start(tag, attributes)
            if tag in RAW and not found[3].endswith("/"):
                stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                at = stop.start() if stop else n
        else:  # a sign
            text.append((open_[-1], "<", links > 0))
            at = lt + 1
    close(0)
    keep_headed(page)
    return page


def keep_headed(page: Page) -> None:
    """Headers go; of one inside an article its headings stay, as the article's title."""
    behind = 0
    for e in page.headers:
        if e < behind or page.dropped[e]:
            continue
        behind = page.end[e]
        was = page.dropped[e:behind]
        page.dropped[e:behind] = [True] * (behind - e)
        if page.main[e]:
            for h in range(e + 1, behind):
                if page.tag[h] in HEADINGS:
                    page.dropped[h : page.end[h]] = was[h - e : page.end[h] - e]


def sums(page: Page, sizes: dict[int, int]) -> list[int]:
    """Sums of what elements have, from the first on; an element with all inside is a difference of two."""
    return [0, *accumulate(sizes.get(e, 0) for e in range(len(page.tag)))]


def drop_menus(page: Page) -> None:
    """Lists with two links or more and no text besides are menus."""
    sizes: tuple[dict[int, int], dict[int, int]] = defaultdict(int), defaultdict(int)
    for e, s, in_link in page.text:
        sizes[in_link][e] += len(s.strip())
    outside, links = sums(page, sizes[False]), sums(page, {e: 1 for e, tag in enumerate(page.tag) if tag == "a"})
    for e, tag in enumerate(page.tag):
        end = page.end[e]
        if tag in ("ul", "ol") and outside[end] == outside[e] and links[end] - links[e] > 1:
            page.dropped[e:end] = [True] * (end - e)


def scores(page: Page) -> dict[int, int]:
    """Containers and the characters of their paragraphs that are no links.

    A paragraph's container is its parent beyond lists, tables and quotes; text outside
    paragraphs is its own block's. Within an article (or main part) it is this.
    """
    out: dict[int, int] = defaultdict(int)
    for e, s, in_link in page.text:
        if not in_link and not page.dropped[e]:
            out[page.holder[e]] += len(s.strip())
    return {e: n for e, n in out.items() if n}


def lifted(page: Page, path: str) -> str:
    """The path, raised to its parent's while that adds nothing but headings and text of the path itself."""
    same = [e for e, p in enumerate(page.path) if p == path and page.tag[e] in BLOCK and not page.dropped[e]]
    if not same or page.main[same[0]]:
        return path
    sizes: dict[int, int] = defaultdict(int)
    for e, s, _ in page.text:
        if not page.dropped[e]:
            sizes[e] += len(s.strip())
    covered = bytearray(len(page.tag))
    for e in (*same, *(e for e, tag in enumerate(page.tag) if tag in HEADINGS)):
        if not covered[e]:
            covered[e : page.end[e]] = b"\x01" * (page.end[e] - e)
    rest = sums(page, {e: n for e, n in sizes.items() if not covered[e]})
    e = same[0]
    while (above := page.parent[e]) > 0 and page.tag[above] != "body" and rest[page.end[above]] == rest[above]:
        e = above
    return page.path[e]


def votes(page: Page) -> list[tuple[str, int]]:
    """The page's containers by path, with shares of a thousand, the best first."""
    by_path: dict[str, int] = defaultdict(int)
    for e, n in scores(page).items():
        by_path[page.path[e]] += n
    if not by_path:
        return []
    best = min(by_path, key=lambda p: (-by_path[p], p))
    raised = lifted(page, best)
    if raised != best:
        by_path[raised] += by_path.pop(best)
    total = sum(by_path.values())
    return sorted(((p, n * SHARES // total) for p, n in by_path.items()), key=lambda x: (-x[1], x[0]))


def text_of(page: Page, path: str) -> str:
    """The text of all elements with a path, without what is dropped."""
    inside, behind = bytearray(len(page.path)), -1
    for e, own in enumerate(page.path):
        if own == path and e >= behind and page.tag[e] in BLOCK:
            behind = page.end[e]
            inside[e:behind] = b"\x01" * (behind - e)
    return " ".join("".join([s for e, s, _ in page.text if s == " " or (inside[e] and not page.dropped[e])]).split())


def parsed(html: str | None) -> Page:
    page = parse(html or "")
    drop_menus(page)
    return page


def host_of(url: Column) -> Column:
    """The lower-cased host of an address, null if it has none."""
    found = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/]*\]|[^/?#:]+)", 1)
    return F.when(found != "", found)


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, paths): for each host the paths with a twentieth of its pages' votes at least, the most voted first.

    pages has url and html; those without a host or without text don't vote.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1, SLICE_BYTES)):
            at, path, share = [], [], []
            for i, html in enumerate(batch.column(1).to_pylist()):
                for p, n in votes(parsed(html)):
                    at.append(i)
                    path.append(p)
                    share.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(path, pa.string()), pa.array(share, pa.int64())], names=["host", "path", "votes"])

    cast = pages.select(host_of(pages["url"]).alias("host"), "html").where("host is not null").mapInArrow(run, "host string, path string, votes long")
    counted = stored(cast.groupBy("host", "path").agg(F.sum("votes").alias("votes")))
    all_votes = counted.groupBy("host").agg(F.sum("votes").alias("all_votes"))
    best = F.expr("transform(array_sort(collect_list(struct(-votes as votes, path))), x -> x.path)")
    return counted.join(all_votes, "host").where(F.col("votes") * WINNER_PART >= F.col("all_votes")).groupBy("host").agg(best.alias("paths"))


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every page: (page_id, url, text, n_chars, path, by_host).

    text is the article without menus, headers, footers, sidebars, notices, adverts,
    forms, scripts, styles and readers' comments: character references decoded, white
    space within a block one space, blocks joined by one space in the page's order;
    path is the container's, by_host whether the host's vote chose it. A null or empty
    html, and one without such text, has an empty text, n_chars 0 and a null path; a null
    or odd url has no host, so the page's own best container counts. Of paths with equal
    votes the least wins. Repeated rows are pages of their own: one row out for each in,
    none for an empty table. Only page_id, url and html are read, so further columns
    can't clash. A task holds a slice of 4 MB of pages, or one longer page with some
    hundred bytes for each of its tags and texts.
    """
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    read = pages.select("page_id", "url", "html", host_of(pages["url"]).alias("host"))
    winners = stored(winning_paths(pages.select("url", "html")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2, SLICE_BYTES)):
            out = []
            for html, paths in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                page, found, path = parsed(html), "", None
                for path in paths or []:
                    found = text_of(page, path)
                    if found:
                        break
                by_host = bool(found)
                if not found:
                    path = next((p for p, _ in votes(page)), None)
                    found = text_of(page, path) if path else ""
                out.append((found, len(found), path if found else None, by_host))
            text, size, path, by_host = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(size, pa.int64()), pa.array(path, pa.string()), pa.array(by_host, pa.bool_())],
                names=["page_id", "url", "text", "n_chars", "path", "by_host"],
            )

    if winners.count() <= BROADCAST_HOSTS:
        told = read.join(F.broadcast(winners), "host", "left")
    else:  # a host may have a third of all pages: its pages are dealt to shares, its paths to each of them
        dealt = read.withColumn("_share", F.pmod(F.xxhash64("page_id", "html"), F.lit(SALT)).cast("int"))
        shares = winners.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        told = dealt.join(shares, ["host", "_share"], "left")
    return told.select("page_id", "url", "html", "paths").mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, path string, by_host boolean"
    )
