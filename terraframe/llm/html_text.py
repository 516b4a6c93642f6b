"""Main text of web pages: marks of the page's structure, and a host suffix array for what they leave open.

A page is cut into blocks, each in a zone: article, main element, hinted, plain, or
outside. Elements and roles that HTML gives a meaning decide; so do names that say nothing but what
they name, like ``main-menu``. Names that merely hold such a word, like ``related-work``, are hints.

A page that marks an article keeps it whole: other pages may print the same text, in articles and in menus. What is
open is decided by the host's other pages: hinted blocks of an article, what a main element holds
beside its article, and all plain blocks of a page that marks nothing. Pages of such a host, in shards of bounded
size, form one token stream; its suffix array, sorted to the depth of a long substring, shows which token runs repeat
across distinct pages. (Whatever a longer match covers, its runs of that depth cover.) Open blocks lose the runs that
repeat, and their unique runs stay.

Plan: a survey tells the hosts on which any page is open; pages of other hosts are settled in the scan. The rest is dealt
by host and shard, and each shard is one task's group. On a host of several shards runs are counted by shard, summed over the
host, and joined back to the shards that may lose them.
"""

from __future__ import annotations

import html as entities
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import shared_dir, shuffle_partitions, table, tidy, written

#: Tokens of a long substring.
LONG = 8
#: Distinct pages on which it must stand to be boilerplate.
PAGES = 3
#: HTML bytes of a shard of a host.
SHARD_BYTES = 1 << 21
#: Hosts of more than one shard that are broadcast; beyond so many they are joined by a shuffle.
BROADCAST_HOSTS = 1 << 16

#: Zones of blocks. HINTED: in an article or main element, under a name that may mean boilerplate.
ARTICLE, MAIN, HINTED, PLAIN, OUTSIDE = "AMHPO"
#: What becomes of a word: it goes; it stays; it stays unless the host repeats it.
GONE, OWN, OPEN = 0, 1, 2

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title|noscript|template|iframe|svg|select|button|object|canvas)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HEADINGS = {f"h{i}" for i in range(1, 7)}
_BLOCK = _HEADINGS | set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = {"hr"}
#: Elements and roles that are never an article's text.
_DROPPED = set("nav aside form dialog menu head".split())
_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
#: Parts of names that mean boilerplate wherever they stand; outside of an article; at an article's end.
_ALWAYS = set("comment comments commentlist reply replies disqus respond discussion ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar widget widgets cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended trending pagination pager toolbar".split())
_HEAD = set("header masthead topbar footer colophon copyright legal".split())
_FOOT = {"footer", "colophon", "copyright"}
#: Parts that add no meaning of their own: a name of such parts and of the ones above is no hint but says it.
_NEUTRAL = set("main site page top bottom left right primary secondary global list box wrapper container area block item inner outer links bar slot unit".split())
#: Whole names of divisions that are the article, or the main element.
_ARTICLES, _MAINS = {"articlebody"}, {"main", "maincontent"}


@lru_cache(4096)
def _names(attrs: str) -> tuple[frozenset[str], frozenset[str], frozenset[str], str | None]:
    """(parts of names that say what they name, parts of those that only hint, whole names, role)."""
    said, hints, whole, role = set(), set(), set(), None
    for kind, value in _ATTRIBUTE.findall(attrs):
        for name in value.strip("\"'").lower().split():
            parts = [x for x in re.split(r"[^a-z0-9]+", name) if x]
            if kind.lower() == "role":
                role = role or name
                continue
            known = {x for x in parts if x in _ALWAYS or x in _HEAD}
            (said if all(x in known or x in _NEUTRAL or x.isdigit() for x in parts) else hints).update(known)
            whole.add("".join(parts))
    return frozenset(said), frozenset(hints), frozenset(whole), role


def _zone(tag: str, attrs: str, above: str, inside: bool) -> str:
    """The zone of an element under one of zone ``above``; ``inside``: an article or main element is open around it."""
    if tag in ("html", "body"):
        return above
    said, hints, whole, role = _names(attrs) if "=" in attrs else _names("")
    division = tag in ("div", "section")
    if tag == "article" or role == "article" or division and whole & _ARTICLES:
        return OUTSIDE if inside and above == OUTSIDE or said & _ALWAYS else ARTICLE
    if tag == "main" or role == "main" or division and whole & _MAINS:
        return OUTSIDE if inside and above == OUTSIDE else above if above == ARTICLE else MAIN
    if above == OUTSIDE or tag in _DROPPED or tag == "footer" or role in _ROLES or said & _ALWAYS or said & _FOOT:
        return OUTSIDE
    if not inside and (tag == "header" or said & _HEAD):
        return OUTSIDE
    return HINTED if hints & _ALWAYS and above in (ARTICLE, MAIN) else above


def blocks(page: str) -> list[tuple[str, str]]:
    """(zone, text) of every block that has text, in page order; character references decoded, white space runs one space."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []
    opened: dict[str, int] = {}
    held: list[str] = []
    zone, at, inside = PLAIN, 0, 0

    def flush():
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                out.append((zone, text))
            held.clear()

    def close():
        nonlocal inside
        tag, z = stack.pop()
        opened[tag] -= 1
        inside -= z in (ARTICLE, MAIN)

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            held.append(" ")
        if tag not in _BLOCK:
            continue
        flush()
        if m["end"] or m["end2"]:
            if opened.get(tag):
                while stack[-1][0] != tag:
                    close()
                close()
        elif tag not in _VOID:
            # a paragraph or item ends where the next block begins
            while stack and (stack[-1][0] == "p" or stack[-1][0] in _HEADINGS and tag in _HEADINGS | {"p"} or stack[-1][0] == tag == "li"):
                close()
            z = _zone(tag, m["attrs"] or m["attrs2"] or "", stack[-1][1] if stack else PLAIN, inside > 0)
            stack.append((tag, z))
            opened[tag] = opened.get(tag, 0) + 1
            inside += z in (ARTICLE, MAIN)
        zone = stack[-1][1] if stack else PLAIN
    held.append(page[at:])
    flush()
    return out


def fates(zones: str) -> list[int]:
    """What becomes of the words of a page's blocks, by their zones."""
    if ARTICLE in zones:
        of = {ARTICLE: OWN, MAIN: OPEN, HINTED: OPEN}
    elif MAIN in zones or HINTED in zones:
        of = {MAIN: OWN, HINTED: OPEN}
    else:
        of = {PLAIN: OPEN}
    return [of.get(z, GONE) for z in zones]


def suffixes(tokens: np.ndarray, row: np.ndarray, long: int = LONG) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ranks) of the runs of ``long`` tokens that stand more than once; equal runs have equal ranks.

    ``row`` numbers the stretches, which no run passes. Suffixes are ranked by their first
    2, 4, ... tokens until the depth is reached: neighbours of equal rank in the array share that many.
    """
    n, none = len(tokens), np.zeros(0, np.int64)
    if n < long:
        return none, none
    rank, depth = tokens.astype(np.int64), 1
    # the last token that a suffix may use
    ends = np.append(np.flatnonzero(row[1:] != row[:-1]), n - 1)
    end = ends[np.searchsorted(ends, np.arange(n))]
    live = np.arange(n)
    while depth < long and len(live):
        step = min(depth, long - depth)
        live = live[live + depth + step - 1 <= end[live]]
        pair = rank[live] * (int(rank.max(initial=0)) + 1) + rank[live + step]
        order = np.argsort(pair, kind="stable")
        new = np.concatenate([[True], pair[order][1:] != pair[order][:-1]]) if len(order) else np.zeros(0, bool)
        number = np.cumsum(new) - 1
        nxt = np.full(n, -1)
        nxt[live[order]] = number
        # suffixes alone of their rank repeat nowhere
        many = np.bincount(number, minlength=1)[number] > 1
        nxt[live[order[~many]]] = -1
        keep = np.zeros(n, bool)
        keep[live[order[many]]] = True
        rank, depth = nxt, depth + step
        live = np.flatnonzero(keep)
        if depth < long:
            # both halves of a deeper rank must repeat
            step = min(depth, long - depth)
            live = live[live + step < n]
            live = live[keep[live + step]]
    return live, rank[live]


def on_pages(rank: np.ndarray, page: np.ndarray) -> np.ndarray:
    """On how many distinct pages each rank stands; a negative page is no evidence."""
    seen = page >= 0
    wide = int(page.max(initial=0)) + 1
    both = np.unique(rank[seen] * wide + page[seen])
    return np.bincount(both // wide, minlength=int(rank.max(initial=-1)) + 1)


def covered(n: int, starts: np.ndarray, long: int = LONG) -> np.ndarray:
    """True for those of n tokens that runs of ``long`` from ``starts`` on cover."""
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + long, -1)
    return np.cumsum(cover[:n]) > 0


def repeated(tokens: np.ndarray, page: np.ndarray, long: int = LONG, pages: int = PAGES, row: np.ndarray | None = None) -> np.ndarray:
    """True for tokens covered by a run of ``long`` tokens that stands on ``pages`` or more distinct pages."""
    start, rank = suffixes(tokens, page if row is None else row, long)
    return covered(len(tokens), start[on_pages(rank, page[start])[rank] >= pages], long)


def runs(words: pa.DictionaryArray, row: np.ndarray, long: int = LONG) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every run of ``long`` words within a row; the hash is the same in every task."""
    digest = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "replace"), 42) for w in words.dictionary.to_pylist()], np.uint64)
    token, n = digest[words.indices.to_numpy(zero_copy_only=False)], len(words) - long + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    run = np.zeros(n, np.uint64)
    for k in range(long):
        run = run * np.uint64(0x9E3779B97F4A7C15) + token[k : k + n]
        run ^= run >> np.uint64(31)
    start = np.flatnonzero(row[:n] == row[long - 1 :])
    return start, run[start].view(np.int64)


class Stream:
    """The words of some pages: each block's start, and for each word its fate, its row, and its page's number, -1 for what is no evidence."""

    def __init__(self, pages: list[list[tuple[str, str]]], ids: list, evidence: list[bool]):
        words, number, self.at, page, row, fate = [], {}, [], [], [], []
        self.fates = [fates("".join(z for z, _ in p)) for p in pages]
        for i, (own, p, ok) in enumerate(zip(ids, pages, evidence, strict=True)):
            k = number.setdefault(own, len(number)) if ok else -1
            for (_, text), f in zip(p, self.fates[i], strict=True):
                w = text.split(" ")
                self.at.append(len(words))
                words += w
                page += [k] * len(w)
                row += [i] * len(w)
                fate += [f] * len(w)
        self.words = pa.array(words, pa.string()).dictionary_encode()
        self.row, self.page, self.fate = np.array(row, np.int64), np.array(page, np.int64), np.array(fate, np.int64)


def choose(pages: list[list[tuple[str, str]]], ids: list, evidence: list[bool] | None = None, common: np.ndarray | None = None, long: int = LONG, least: int = PAGES) -> list[str]:
    """The main text of each page of a host's shard.

    ``evidence`` tells rows that count from copies of a page, of which one does; by default the first. ``common``
    are the hashes of runs that repeat on the host, where the shard is not all of it.
    """
    if evidence is None:
        first: dict = {}
        evidence = [first.setdefault(tuple(p), own) == own for own, p in zip(ids, pages, strict=True)]
    s = Stream(pages, ids, evidence)
    gone = s.fate == GONE
    if (s.fate == OPEN).any():
        if common is None:
            again = repeated(s.words.indices.to_numpy(zero_copy_only=False), s.page, long, least, s.row)
        else:
            start, run = runs(s.words, s.row, long)
            again = covered(len(s.words), start[np.isin(run, common)], long)
        gone |= (s.fate == OPEN) & again
    texts, b = [], 0
    for p, f in zip(pages, s.fates, strict=True):
        kept = []
        for (_, text), fate in zip(p, f, strict=True):
            if fate != GONE:
                w = text.split(" ")
                lost = gone[s.at[b] : s.at[b] + len(w)]
                if lost.any():
                    text = " ".join(x for x, c in zip(w, lost.tolist(), strict=True) if not c)
                if text:
                    kept.append(text)
            b += 1
        texts.append("\n".join(kept))
    return texts


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row ``(page_id, url, text, n_chars)`` for each row of ``pages``.

    A null html is empty, an empty page has the text "". A null or odd url is of the host "". Rows with equal ids
    are one page as evidence, and so are rows of a host with equal blocks; each row gets its text. A row without
    an id is the page of its url. Pages of any length and depth are read whole. An empty table gives an empty one.
    """
    spark, base = pages.sparkSession, shared_dir(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^\w+://([^/?#]*)", 1))
    page = F.when(F.col(id).isNull(), F.xxhash64(F.lit("url"), F.col(url))).otherwise(F.xxhash64(F.lit("id"), F.col(id)))
    slim = pages.select(F.col(id).alias("page_id"), F.col(url).alias("url"), host.alias("host"), page.alias("page"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    kind = slim.schema["page_id"].dataType.simpleString()
    spec = f"page_id {kind}, url string, text string, n_chars long"

    def told(ids, urls, text):
        return [ids, urls, pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())]

    def survey(batches):
        for b in batches:
            open_ = [OPEN in fates("".join(z for z, _ in blocks(h.as_py()))) for h in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("size"), pa.array(open_, pa.bool_())], names=["host", "size", "open"])
        tidy()

    sizes = slim.select("host", "html", F.octet_length("html").cast("long").alias("size")).mapInArrow(survey, "host string, size long, open boolean")
    hosts = sizes.groupBy("host").agg(F.ceil(F.sum("size") / SHARD_BYTES).alias("shards"), F.max("open").alias("open"))
    hosts = written(hosts.where("open").select("host", "shards"), f"{base}/hosts")

    def settled(batches):
        for b in batches:
            text = [choose([blocks(h.as_py())], [0])[0] for h in b.column("html")]
            yield pa.RecordBatch.from_arrays(told(b.column("page_id"), b.column("url"), text), names=["page_id", "url", "text", "n_chars"])
        tidy()

    if hosts.isEmpty():
        return slim.select("page_id", "url", "html").mapInArrow(settled, spec)
    few = hosts.count() <= BROADCAST_HOSTS
    joined = slim.join(F.broadcast(hosts) if few else hosts, "host", "left")
    rest = joined.where("shards is null").select("page_id", "url", "html").mapInArrow(settled, spec)

    def cut(batches):
        squeeze = zstandard.ZstdCompressor(level=3)
        for b in batches:
            got = [blocks(h.as_py()) for h in b.column("html")]
            raw = ["\n".join(["".join(z for z, _ in p), *(t for _, t in p)]).encode("utf-8", "replace") for p in got]
            content = np.array([xxhash.xxh64_intdigest(x) for x in raw], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("page_id", "url", "host", "page", "shards")), pa.array([squeeze.compress(x) for x in raw], pa.binary()), pa.array(content)], names=["page_id", "url", "host", "page", "shards", "blocks", "content"])
        tidy()

    packed = joined.where("shards is not null").select("page_id", "url", "host", "page", "shards", "html")
    packed = written(packed.mapInArrow(cut, f"page_id {kind}, url string, host string, page long, shards long, blocks binary, content long"), f"{base}/packed")
    # of the copies of a page, those of one id count
    copies = written(packed.groupBy("host", "content").agg(F.min("page").alias("first"), F.max("page").alias("last")).where("first != last").select("host", "content", "first"), f"{base}/copies")
    some = F.broadcast(copies) if copies.count() <= BROADCAST_HOSTS else copies
    shard = F.pmod(F.xxhash64("page"), F.col("shards")).alias("shard")
    dealt = packed.join(some, ["host", "content"], "left").select("page_id", "url", "host", "page", "blocks", (F.coalesce("first", "page") == F.col("page")).alias("evidence"), "shards", shard)
    # a join's partitions by host would do for groups by host and shard, but not for a hot host
    dealt = dealt.repartition(shuffle_partitions(spark), "host", "shard")

    def opened(group):
        unzip, out = zstandard.ZstdDecompressor(), []
        for x in group["blocks"]:
            zones, *texts = unzip.decompress(x.as_py()).decode().split("\n")
            out.append(list(zip(zones, texts, strict=False)))
        return out

    def settle(group, common=None):
        text = choose(opened(group), group["page"].to_pylist(), group["evidence"].to_pylist(), common)
        out = pa.table(told(group["page_id"], group["url"], text), names=["page_id", "url", "text", "n_chars"])
        tidy()
        return out

    def count(group):
        """Runs of a shard: on how many of its pages each stands, and whether a page here may lose it."""
        s = Stream(opened(group), group["page"].to_pylist(), group["evidence"].to_pylist())
        start, run = runs(s.words, s.row)
        each, number = np.unique(run, return_inverse=True)
        n, own = on_pages(number, s.page[start]), np.zeros(len(each), bool)
        may = np.concatenate([[0], np.cumsum(s.fate == OPEN)])
        own[number[may[start + LONG] > may[start]]] = True
        same = [pa.array(group[c][:1].to_pylist() * len(each), t) for c, t in (("host", pa.string()), ("shard", pa.int64()))]
        return pa.table([*same, pa.array(each, pa.int64()), pa.array(n, pa.int64()), pa.array(own)], names=["host", "shard", "run", "n", "own"])

    small = dealt.where("shards = 1").groupBy("host", "shard").applyInArrow(lambda group: settle(group), spec)
    large = dealt.where("shards > 1")
    if hosts.where("shards > 1").isEmpty():
        return rest.unionByName(small)
    found = written(large.groupBy("host", "shard").applyInArrow(count, "host string, shard long, run long, n long, own boolean"), f"{base}/runs")
    common = found.groupBy("host", "run").agg(F.sum("n").alias("n")).where(F.col("n") >= PAGES).select("host", "run")
    common = found.where("own").select("host", "shard", "run").join(common, ["host", "run"])
    both = large.groupBy("host", "shard").cogroup(common.groupBy("host", "shard"))
    return rest.unionByName(small).unionByName(both.applyInArrow(lambda group, more: settle(group, more["run"].to_numpy()), spec))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op9_html_text": op9_html_text}
