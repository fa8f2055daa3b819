"""Main text of web pages: markup rules, and a suffix array over each host's pages.

A page is read into blocks: runs of text between block-level tags. Each block is in the article
(inside ``article`` or ``main``), in a part that is never main text (menus, headers, footers, forms,
notices, adverts, comments, known by tag, role, class or id), or in neither. The blocks outside the
article form the page's token stream. The streams of a host's pages are joined, and the joined
stream's suffixes are sorted by doubling; neighbours with a long common prefix on different pages
are text that the host repeats. Undecided blocks that such runs cover go, the rest is unique to its
page and stays; beside an article only if it is as long as a run and the host has pages to compare.
A block of an article goes if it is on half of a host's pages or more and such blocks are the
smaller part of the article; what fewer pages share (an article or passage on several) is main text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkgauge.llm.staging import stage

#: Tokens that a repeated run must have, and the part of a block's tokens that such runs must cover.
MIN_RUN, COVERED = 8, 0.8
#: Pages of a host that are compared with each other; larger hosts are dealt out in groups of about this size.
GROUP_PAGES = 512
#: An article's block goes if it is on this share of a host's pages, the host has so many pages and the block so many words.
USUAL, MIN_PAGES, MIN_WORDS = 0.5, 8, 3
#: Rows of a group whose texts are given at once.
AT_ONCE = 1 << 17
#: No hashes.
NONE = np.zeros(0, np.int64)

#: INSIDE is an article in a part that only its name or a form makes doubtful, DOUBTFUL such a part's other text.
ARTICLE, OPEN, NEVER, INSIDE, DOUBTFUL = range(5)

#: Elements by what they do to text.
_INVISIBLE = frozenset("script style noscript template head title svg math iframe object canvas select textarea".split())
_NEVER = frozenset("nav header footer aside menu dialog button".split())
_MAIN = frozenset(["article", "main"])
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: What an end tag or a following block may close without its own end tag.
_CLOSES_P = _BLOCK - frozenset(["br", "option", "body", "html"])
_SAME = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
def _names(words: str) -> re.Pattern:
    return re.compile(rf"(?:^|[\s_-])(?:{'|'.join(words.split())})(?:$|[\s_-]|\d)", re.IGNORECASE)


#: Words of class, id and role that name parts that are never main text, whatever is in them.
_SURE = _names(
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer footer newsletter notice popup modal"
    " promo promoted related recommended reply replies respond sponsor sponsored subscribe navigation contentinfo complementary dialog alert skip"
)
#: Words that also name wrappers around an article, after what stands beside it.
_MAYBE = _names("banner header masthead menu nav navbar search share sharing sidebar side-bar social toolbar widget")
_WHITE = re.compile(r"\s+")


class _Reader(HTMLParser):
    """Blocks of a page as (kind, text), in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[int, str]] = []
        self.open: list[tuple[str, int, bool]] = []  # tag, kind inside, invisible
        self.kind, self.hidden = OPEN, False
        self.held: list[str] = []

    def _end_block(self) -> None:
        if self.held:
            text = _WHITE.sub(" ", "".join(self.held)).strip()
            if text:
                self.blocks.append((self.kind, text))
            self.held = []

    def _pop_to(self, depth: int) -> None:
        del self.open[depth:]
        _, self.kind, self.hidden = self.open[-1] if self.open else ("", OPEN, False)

    def _close(self, names: frozenset[str] | set[str], stop: frozenset[str]) -> None:
        for depth in range(len(self.open) - 1, -1, -1):
            tag = self.open[depth][0]
            if tag in names:
                self._pop_to(depth)
                return
            if tag in stop:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _BLOCK:
            self._end_block()
            if tag in _CLOSES_P:
                self._close({"p"}, _SCOPE)
        if tag in _SAME:
            self._close(set(_SAME[tag].split()), _SCOPE | _LISTS)
        if tag in _VOID:
            return
        kind, hidden = self.kind, self.hidden or tag in _INVISIBLE
        values = {k: v or "" for k, v in attrs}
        named = " ".join(values.get(a, "") for a in ("class", "id", "role")) if tag not in ("html", "body") else ""
        if tag in _MAIN or values.get("role") == "main":
            if kind in (ARTICLE, INSIDE):
                kind = NEVER if tag == "article" and (_SURE.search(named) or _MAYBE.search(named)) else kind
            elif kind != NEVER:
                kind = ARTICLE if kind == OPEN else INSIDE
        elif tag in _NEVER or _SURE.search(named):
            kind = NEVER
        elif tag == "form" or _MAYBE.search(named):
            kind = DOUBTFUL if kind in (OPEN, DOUBTFUL) else NEVER
        if "hidden" in values or values.get("aria-hidden") == "true":
            kind = NEVER
        if kind != self.kind:
            self._end_block()
        self.open.append((tag, kind, hidden))
        self.kind, self.hidden = kind, hidden

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and tag in _INVISIBLE:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCK:
            self._end_block()
        if tag in _VOID:
            return
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] == tag:
                if self.open[depth][1] != self.kind:
                    self._end_block()
                outside = self.open[depth - 1][1] if depth else OPEN
                if outside != self.kind:
                    self._end_block()
                self._pop_to(depth)
                return

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.held.append(data)

    def finish(self) -> list[tuple[int, str]]:
        """The blocks as ARTICLE, OPEN or NEVER: what is doubtful counts only where a page has nothing better."""
        self.close()
        self._end_block()
        kinds = {kind for kind, _ in self.blocks}
        inside = NEVER if ARTICLE in kinds else ARTICLE
        doubtful = NEVER if kinds & {ARTICLE, INSIDE, OPEN} else OPEN
        return [({INSIDE: inside, DOUBTFUL: doubtful}.get(kind, kind), text) for kind, text in self.blocks]


#: Elements that implied end tags don't reach across.
_SCOPE = frozenset("html body article main section div table td th button".split())
_LISTS = frozenset(["ul", "ol", "dl", "menu", "select"])


def page_blocks(html: str | None) -> list[tuple[int, str]]:
    """The page's blocks as (kind, text). Without an article, text in no telling part is undecided."""
    if not html:
        return []
    reader = _Reader()
    reader.feed(html)
    return reader.finish()


def suffix_order(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``tokens`` sorted by their first ``depth`` tokens (a power of two), and each suffix's rank by those."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < depth:
        ahead = np.zeros(len(rank), np.int64)
        ahead[:-width] = rank[width:] + 1
        rank = np.unique(rank * (len(rank) + 2) + ahead, return_inverse=True)[1].astype(np.int64)
        width *= 2
    return np.argsort(rank, kind="stable"), rank


def window_hashes(words: list[str], width: int, salt: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` words, with ``salt`` mixed in."""
    digests = np.fromiter((xxhash.xxh64_intdigest(w, salt) for w in words), np.uint64, len(words))
    n = len(words) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(width if n > 0 else 0):
        out = (out ^ digests[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def repeated(pages: list[list[str]], min_run: int = MIN_RUN, elsewhere: np.ndarray = NONE, salt: int = 0) -> list[list[bool]]:
    """For each page's tokens, whether a run of at least ``min_run`` of them that covers the token is on a page of other tokens too.

    ``elsewhere`` has the ``window_hashes`` of runs that pages not given here hold.
    """
    ids: dict[str, int] = {}
    contents: dict[tuple[str, ...], int] = {}
    stream, owner = [], []
    for p, words in enumerate(pages):
        stream += [ids.setdefault(w, len(ids)) for w in words]
        stream += [-1 - p] * min_run  # a mark of its own ends each page: no run goes across
        owner += [contents.setdefault(tuple(words), p)] * (len(words) + min_run)  # a page that is stored twice doesn't repeat itself
    if not stream:
        return [[] for _ in pages]
    tokens, page = np.array(stream, np.int64), np.array(owner, np.int64)
    order, rank = suffix_order(tokens, min_run)
    starts = np.flatnonzero(np.append(True, rank[order][1:] != rank[order][:-1]))
    low, high = np.minimum.reduceat(page[order], starts), np.maximum.reduceat(page[order], starts)
    shared = (low != high)[rank]
    if len(elsewhere):
        at = 0
        for words in pages:
            hashes = window_hashes(words, min_run, salt)
            shared[at : at + len(hashes)] |= np.isin(hashes, elsewhere)
            at += len(words) + min_run
    edge = np.zeros(len(tokens) + min_run, np.int64)
    np.add.at(edge, np.flatnonzero(shared), 1)
    np.add.at(edge, np.flatnonzero(shared) + min_run, -1)
    covered = np.cumsum(edge)[: len(tokens)] > 0
    out, at = [], 0
    for words in pages:
        out.append(covered[at : at + len(words)].tolist())
        at += len(words) + min_run
    return out


def outside_words(blocks: list[tuple[int, str]]) -> list[str]:
    """The page's token stream: the words of the blocks outside the article."""
    return [w for kind, text in blocks if kind != ARTICLE for w in text.split()]


def article_hashes(blocks: list[tuple[int, str]], salt: int) -> list[int]:
    """Hashes of the article's blocks, 0 for those of too few words to be judged."""
    texts = [text for kind, text in blocks if kind == ARTICLE]
    return [_signed(xxhash.xxh64_intdigest(t, salt ^ 1)) if t.count(" ") + 1 >= MIN_WORDS else 0 for t in texts]


def usual(n: int, pages: int) -> bool:
    """Whether a block on ``n`` of a host's ``pages`` pages belongs to the host rather than to its articles."""
    return pages >= MIN_PAGES and n >= USUAL * pages


def main_texts(pages: list[list[tuple[int, str]]], min_run: int = MIN_RUN, covered: float = COVERED, elsewhere: np.ndarray = NONE, salt: int = 0, host_pages: int | None = None, copies: list[int] | None = None) -> list[str]:
    """The main text of each of a host's pages, given as blocks; ``copies`` says how often each is stored.

    A page without an article of which everything is repeated keeps its undecided blocks: it has nothing else. Of a host of more pages than those given, ``host_pages`` is their number and ``elsewhere`` has the hashes of runs
    (as in ``repeated``) and of usual article blocks, which only all pages together tell.
    """
    marks = repeated([outside_words(blocks) for blocks in pages], min_run, elsewhere, salt)
    hashes = [article_hashes(blocks, salt) for blocks in pages]
    copies = copies or [1] * len(pages)
    total = sum(copies) if host_pages is None else host_pages
    if host_pages is None:
        counts: Counter[int] = Counter()
        for own, n in zip(hashes, copies):
            counts.update(dict.fromkeys(set(own), n))
        chrome = {h for h, n in counts.items() if h and usual(n, total)}
    else:
        chrome = set(elsewhere[np.isin(elsewhere, np.array([h for own in hashes for h in own if h], np.int64))].tolist())
    out = []
    for blocks, mark, own in zip(pages, marks, hashes):
        words = [len(text.split()) for kind, text in blocks if kind == ARTICLE]
        gone = [h in chrome for h in own]
        if 2 * sum(n for n, g in zip(words, gone) if g) > sum(words):  # a copy of an article, not a frame around one
            gone = [False] * len(own)
        kept, at, k = [], 0, 0
        for kind, text in blocks:
            if kind == ARTICLE:
                if not gone[k]:
                    kept.append(text)
                k += 1
                continue
            n = len(text.split())
            part = sum(mark[at : at + n]) / n
            at += n
            if kind == OPEN and part < covered and (not own or total >= MIN_PAGES and n >= min_run):
                kept.append(text)
        if not kept and not own:
            kept = [text for kind, text in blocks if kind == OPEN]
        out.append("\n".join(kept))
    return out


def host_of(url: F.Column) -> F.Column:
    """Host of a URL in lower case; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def extract(pages: DataFrame, min_run: int = MIN_RUN, covered: float = COVERED, group_pages: int = GROUP_PAGES) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points).

    Blocks are in page order, joined by a line feed, with white space inside a block made one space.
    A null or empty page, or one without main text, has an empty text. Pages without a host form a
    group of their own. Repeated rows stay repeated and count as pages of the host, but no page
    repeats itself: runs are compared between pages of different html. Broken markup is read as far as it goes. An empty table gives an empty
    table; other columns are ignored. A group holds at most a few hundred pages, so a host of any
    size is spread over tasks (equal pages of one go to one, and are read once); for hosts of several groups a first pass counts the pages of each run and article block over
    all groups of the host and tells the groups what they can't see alone.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url")))
    large = rows.groupBy("host").count().where(F.col("count") > group_pages)
    groups = stage(large.select("host", F.ceil(F.col("count") / group_pages).cast("int").alias("groups"), F.col("count").alias("pages")), "large-hosts")
    placed = (
        rows.join(F.broadcast(groups), "host", "left")  # one row for each group_pages pages at most
        .withColumn("part", F.pmod(F.xxhash64("html"), F.coalesce("groups", F.lit(1))).cast("int"))
    )
    known = F.lit(None).cast("array<long>").alias("known")

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition("host", "part").sortWithinPartitions("host", "part", F.desc(F.col("known").isNotNull()), F.xxhash64("html"), "page_id")

    def by_group(batches: Iterator[pa.RecordBatch], tell: Callable[..., pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, ids, urls, which, held, told, total = None, None, [], [], [], [], NONE, None
        for batch in batches:
            for host, part, page_id, url, html, pages, known in zip(*(batch.column(i) for i in range(7))):
                here, html = (host.as_py(), part.as_py()), html.as_py()
                if ids and (here != key or html != last and len(held) >= 2 * group_pages or len(ids) >= AT_ONCE):
                    yield tell(key, ids, urls, which, held, told, total)
                    ids, urls, which, held = [], [], [], held[-1:] if here == key and html == last else []
                if here != key:
                    key, told, last, held = here, NONE, None, []
                if known.is_valid:
                    told = np.asarray(known.values.to_numpy(), np.int64)
                    continue
                total = pages.as_py()
                ids.append(page_id.as_py())
                urls.append(url.as_py())
                if html != last or not held:
                    held.append(page_blocks(html))
                    last = html
                which.append(len(held) - 1)
        if ids:
            yield tell(key, ids, urls, which, held, told, total)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, int, int], tuple[list[np.ndarray], list[np.ndarray]]] = {}
            for host, part, html, total in zip(*(batch.column(i).to_pylist() for i in range(4))):
                blocks, salt = page_blocks(html), _salt(host)
                windows, articles = found.setdefault((host, part, total), ([], []))
                windows.append(np.unique(window_hashes(outside_words(blocks), min_run, salt)))
                articles.append(np.unique(np.array([h for h in article_hashes(blocks, salt) if h], np.int64)))
            for (host, part, total), kinds in found.items():
                for article, own in zip((False, True), kinds):
                    hashes, n = np.unique(np.concatenate(own), return_counts=True)
                    k = len(hashes)
                    yield pa.RecordBatch.from_arrays([pa.array([host] * k, pa.string()), pa.array([part] * k, pa.int32()), pa.array(hashes, pa.int64()), pa.array(n, pa.int64()), pa.array([total] * k, pa.int64()), pa.array([article] * k, pa.bool_())], ["host", "part", "hash", "n", "pages", "article"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tell(key, ids, urls, which, held, told, total):
            made = main_texts(held, min_run, covered, told, _salt(key[0]), total, np.bincount(which, minlength=len(held)).tolist())
            texts = [made[k] for k in which]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

        return by_group(batches, tell)

    every = placed.select("host", "part", "page_id", "url", "html", "pages", known)
    if not groups.isEmpty():
        counted = placed.where("groups is not null").select("host", "part", "html", "pages").mapInArrow(count, "host string, part int, hash long, n long, pages long, article boolean")
        counted = counted.groupBy("host", "part", "hash", "pages", "article").agg(F.sum("n").alias("n"))
        # a window has a row for each group of its host at most; equal pages are in one group, so two groups are two contents
        same = Window.partitionBy("hash", "host", "article")
        over = counted.withColumn("total", F.sum("n").over(same)).withColumn("groups", F.count("*").over(same))
        over = over.where(F.when(F.col("article"), F.col("total") >= USUAL * F.col("pages")).otherwise(F.col("groups") > 1))
        tell = over.groupBy("host", "part").agg(F.sort_array(F.collect_set("hash")).alias("known"))
        every = every.unionByName(tell, allowMissingColumns=True)
    return dealt(every).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _salt(host: str) -> int:
    return xxhash.xxh64_intdigest(host) >> 1
