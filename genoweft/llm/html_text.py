"""HTML main text by a suffix array per host.

A page is cut into blocks of text, each with its zone: `main` inside article or main, `chrome`
inside menus, headers, footers, sidebars, forms, notices, adverts or comments (by element or by
a name in class, id or role), `open` elsewhere.

The token streams of all blocks of all pages of a host are one array of suffixes, ordered by a
48-bit hash of their first `run` tokens: suffixes that begin alike are neighbours, which is all
that the search for repeats asks of the order. A block of fewer tokens is one suffix, whole. A
stretch of neighbours is a repeat, its support the number of distinct pages it comes from; a
longer repeat is a chain of such suffixes at places one after another. A repeat is boilerplate
if its support is `share` of the host's distinct pages, and `least` pages, at least. Then

- open blocks lose the tokens that boilerplate covers; unique runs stay;
- main blocks go only if boilerplate of `main_share` and `main_least` covers them whole: a
  passage that other articles share is still theirs;
- chrome blocks go; they are in the array, so that a menu is known as one wherever it turns up.

A page with main text returns it alone, unless its open text that stays is longer (the body of a
page whose article element is a teaser): then both, in page order.

The array of a host lies in as many tasks as its pages need: hosts beyond `frag_pages` pages are
cut into ranges of the hash, hosts beyond `part_pages` also into parts by page, whose supports
are added, those of one page too: the sum is exact however a host is cut. Boilerplate
windows of a host are at most 1 / share times those of its mean page; they are joined to the
pages by host. No page is sent anywhere to be compared.

Edge cases: null or empty html gives an empty text; broken, unclosed or truncated markup is read
to its end; a null url is a host of its own; pages with equal block streams count as one page
when repeats are sought; null ids and repeated rows stay; texts of any length are read whole; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, materialize, mix64, per_group, tidy, word_bounds, word_hashes

#: Elements whose content is no text, those that end a block, those that hold no main text.
SILENT = frozenset("script style noscript template svg math iframe object canvas head select textarea button title".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CHROME = frozenset("nav header footer aside form menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY = {"p": BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"])}
_NAMED = re.compile(
    r"(?:^|[\s_\-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|sidebar|"
    r"comments?|disqus|respond|share|sharing|social|related|breadcrumbs?|menu|nav|navbar|navigation|header|footer|masthead|pagination|pager|widget|login|signup|search)(?:$|[\s_\-])",
    re.I,
)
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
#: Class names that mark no article text even inside an article (whole names only).
WITHIN = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie-banner cookie-notice cookies disqus menu modal nav navigation "
    "newsletter notice pagination popup promo related related-posts respond share share-buttons sharing sidebar social sponsored subscribe".split()
)
#: Bytes of a suffix's hash: of 48 bits, as hosts tell suffixes apart besides.
SUFFIX_BYTES = 6
_MARK = np.uint64(0x5851F42D4C957F2D)


def _is_chrome(attrs: str, inside: str) -> bool:
    if not attrs or "=" not in attrs:
        return False
    for name, value in _ATTR.findall(attrs):
        value = value.strip("\"'")
        if name.lower() == "role":
            if value.lower() in _ROLE:
                return True
        elif inside == "main":
            if not WITHIN.isdisjoint(value.lower().split()):
                return True
        elif _NAMED.search(value):
            return True
    return False


def blocks(page: str | None) -> list[tuple[str, str]]:
    """(zone, text) of the blocks of a page, in page order."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []  # tag, zone inside it
    held: list[str] = []
    zone, at, page = "open", 0, page or ""

    def end() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((zone, text))

    while at < len(page):
        m = _TAG.search(page, at)
        held.append(page[at : m.start()] if m else page[at:])
        if not m:
            break
        at = m.end()
        if m[1] is not None:
            held.append(entities.escape(m[1], False))
        if m[3] is None:
            continue
        tag = m[3].lower()
        if tag in SILENT and not m[2]:
            if tag not in ("svg", "math", "head") or not m[4].rstrip().endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}\s*>" if tag != "head" else r"</head\s*>|<body\b", re.I).search(page, at)
                at = (stop.start() if stop and tag == "head" and stop[0][1] != "/" else stop.end()) if stop else len(page)
            held.append(" ") if tag not in ("head",) else end()
            continue
        if tag in BLOCK:
            end()
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        else:
            while stack and tag in CLOSED_BY.get(stack[-1][0], ()):
                stack.pop()
            if tag not in VOID and not m[4].rstrip().endswith("/"):
                inside = stack[-1][1] if stack else "open"
                if inside != "chrome":
                    if tag in CHROME and not (tag == "header" and inside == "main") or (tag not in ("html", "body", "main") and (tag != "article" or inside == "main") and _is_chrome(m[4], inside)):
                        inside = "chrome"
                    elif tag in ("article", "main"):
                        inside = "main"
                if tag in BLOCK or inside == "chrome":
                    stack.append((tag, inside))
        now = stack[-1][1] if stack else "open"
        if now != zone:
            end()
            zone = now
    end()
    return out


class Streams:
    """Token streams of the blocks of some pages, and their suffixes: `run` tokens each, or a whole shorter block."""

    def __init__(self, pages: list[list[tuple[str, str]]], hosts: np.ndarray, run: int):
        """hosts: a hash of each page's host, part of every suffix's hash."""
        texts = [t.encode("utf-8", "surrogatepass") + b"\n" for found in pages for _, t in found]
        n_blocks = np.array([len(found) for found in pages], np.int64)
        offs = np.concatenate([[0], np.cumsum(np.array([len(t) for t in texts], np.int64))])
        buf = np.frombuffer(b"".join(texts), np.uint8)
        start, end = word_bounds(buf, offs)
        token = word_hashes(buf, start, end)
        self.page = np.repeat(np.arange(len(pages)), n_blocks)  # of each block
        self.first = np.searchsorted(start, offs)  # token number at each block's start
        size = np.diff(self.first)
        edge = offs[np.concatenate([[0], np.cumsum(n_blocks)])]
        self.name = word_hashes(buf, edge[:-1], edge[1:])  # of each page's block streams
        many = np.where(size > 0, np.maximum(size - run, 0) + 1, 0)
        self.block = np.repeat(np.arange(len(size)), many)
        self.at = np.arange(len(self.block)) - np.repeat(np.cumsum(many) - many, many) + self.first[:-1][self.block]
        self.length = np.minimum(size, run)[self.block]
        h = mix64(hosts[self.page[self.block]].astype(np.uint64) + self.length.astype(np.uint64)) if len(self.block) else np.empty(0, np.uint64)
        for k in range(run):
            inside = np.flatnonzero(self.length > k)
            h[inside] = mix64(h[inside] + token[self.at[inside] + k] + np.uint64(k + 1))
        self.suffix = h >> np.uint64(64 - 8 * SUFFIX_BYTES)

    def covered(self, known: np.ndarray) -> np.ndarray:
        """Which tokens lie in a suffix's beginning that is among `known` (sorted)."""
        hit = np.zeros(self.first[-1] + 1, np.int64)
        if len(known) and len(self.suffix):
            got = known[np.minimum(np.searchsorted(known, self.suffix), len(known) - 1)] == self.suffix
            np.add.at(hit, self.at[got], 1)
            np.add.at(hit, (self.at + self.length)[got], -1)
        return np.cumsum(hit)[:-1] > 0


def _runs(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Rows of about `most` bytes of html at a time; one page is never split."""
    size = pc.fill_null(pc.binary_length(batch["html"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(size)])
    a = 0
    while a < len(size):
        b = min(max(a + 1, int(np.searchsorted(upto, upto[a] + most, "right")) - 1), len(size))
        yield a, b
        a = b


def _packed(x: np.ndarray, edge: np.ndarray) -> pa.Array:
    return pa.array([x[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())


@tidy
def _suffixes(batches: Iterator[pa.RecordBatch], run: int, frag_pages: int, part_pages: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """By fragment: its hosts, the pages of each, and the suffixes of each page; one more suffix marks every page."""
    for batch in batches:
        for a, b in _runs(batch):
            rows = batch.slice(a, b - a)
            hosts = rows["host"].to_numpy().view(np.uint64)
            count = rows["n"].fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64)
            s = Streams([blocks(h) for h in rows["html"].to_pylist()], hosts, run)
            # Of pages of one name and host one is enough.
            one = np.zeros(len(rows), bool)
            one[np.unique(mix64(s.name + mix64(hosts)), return_index=True)[1]] = True
            suffix, page = np.concatenate([s.suffix, _marks(hosts)]), np.concatenate([s.page[s.block], np.arange(len(rows))])
            own = one[page]
            suffix, page = suffix[own], page[own]
            parts = np.maximum(count + np.uint64(part_pages - 1), np.uint64(part_pages)) // np.uint64(part_pages)
            ranges = np.maximum(count // parts + np.uint64(frag_pages - 1), np.uint64(frag_pages)) // np.uint64(frag_pages)
            small = mix64(hosts) % np.uint64(buckets)
            part = mix64(hosts + mix64((s.name >> np.uint64(8)) % parts + np.uint64(1)))
            frag = np.where(((parts > 1) | (ranges > 1))[page], mix64(part[page] + suffix % ranges[page]), small[page]).view(np.int64)
            order = np.lexsort((page, hosts[page], frag))
            frag, page, suffix = frag[order], page[order], suffix[order]
            row = np.append(True, frag[1:] != frag[:-1])[: len(frag)]
            host_run = row | np.append(True, hosts[page][1:] != hosts[page][:-1])[: len(frag)]
            page_run = np.flatnonzero(host_run | np.append(True, page[1:] != page[:-1])[: len(frag)])
            host_run, row = np.flatnonzero(host_run), np.append(np.flatnonzero(row), len(frag))
            by_host, by_page = (np.append(np.searchsorted(x, row[:-1]), len(x)) for x in (host_run, page_run))
            low = suffix.view(np.uint8).reshape(-1, 8)[:, :SUFFIX_BYTES]
            yield pa.RecordBatch.from_pydict(
                {
                    "frag": pa.array(frag[row[:-1]]),
                    "host": _packed(hosts[page[host_run]], by_host), "parts": _packed(parts[page[host_run]], by_host),
                    "pages": _packed(np.diff(np.append(np.searchsorted(page_run, host_run), len(page_run))).astype(np.int32), by_host),
                    "name": _packed(s.name[page[page_run]], by_page), "size": _packed(np.diff(np.append(page_run, len(frag))).astype(np.int32), by_page),
                    "suffix": _packed(low, row),
                }
            )


FRAGMENT = "frag long, host binary, parts binary, pages binary, name binary, size binary, suffix binary"


def _marks(hosts: np.ndarray) -> np.ndarray:
    """The suffix that stands for a page of a host."""
    return mix64(hosts ^ _MARK) >> np.uint64(64 - 8 * SUFFIX_BYTES)


def _supports(table: pa.Table, least: int) -> pa.Table:
    """(host, suffix, support) of a fragment's suffixes on `least` pages or more, in a part of a host of all
    its suffixes; a null suffix has the number of pages."""
    low = joined(table["suffix"], np.uint8).reshape(-1, SUFFIX_BYTES)
    suffix = np.zeros((len(low), 8), np.uint8)
    suffix[:, :SUFFIX_BYTES] = low
    suffix, size = suffix.view(np.uint64).ravel(), joined(table["size"], np.int32)
    names, page = np.unique(joined(table["name"], np.uint64), return_inverse=True)
    host = np.repeat(np.repeat(joined(table["host"], np.uint64), joined(table["pages"], np.int32)), size)
    page = np.repeat(page.astype(np.int32), size)
    if (joined(table["parts"], np.uint64) > 1).any():  # one part of one host
        least = 1
    order = np.lexsort((page, suffix))  # the fragment's part of the suffix array
    suffix, page, host = suffix[order], page[order], host[order]
    new = np.append(True, suffix[1:] != suffix[:-1])[: len(suffix)]
    once = new | np.append(True, page[1:] != page[:-1])[: len(suffix)]
    first = np.flatnonzero(new)
    support = np.add.reduceat(once.astype(np.int64), first) if len(first) else np.empty(0, np.int64)
    mark = suffix[first] == _marks(host[first])
    some = mark | (support >= least)
    first, mark = first[some], mark[some]
    return pa.table({"host": host[first].view(np.int64), "suffix": pa.array(suffix[first].view(np.int64), mask=mark), "support": support[some]})


@tidy
def _extract(batches: Iterator[pa.RecordBatch], run: int) -> Iterator[pa.RecordBatch]:
    """Text of each page, boilerplate of its host known."""
    for batch in batches:
        for a, b in _runs(batch):
            rows = batch.slice(a, b - a)
            pages = [blocks(h) for h in rows["html"].to_pylist()]
            hosts = rows["host"].to_numpy().view(np.uint64)
            s = Streams(pages, hosts, run)
            one = pa.array(np.unique(hosts, return_index=True)[1])
            often, most = (s.covered(np.unique(rows[c].take(one).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))) for c in ("often", "most"))
            out: dict[str, list] = {"text": [], "n_chars": [], "n_repeated": []}
            k = 0
            for found in pages:
                main, every, n_main, n_open, n_repeated = [], [], 0, 0, 0
                for zone, text in found:
                    x, y = s.first[k], s.first[k + 1]
                    k += 1
                    n_repeated += int(often[x:y].sum())
                    if zone == "main" and not most[x:y].all():
                        main.append(text)
                        every.append(text)
                        n_main += y - x
                    elif zone == "open" and not often[x:y].all():
                        kept = " ".join(w for w, hit in zip(text.split(" "), often[x:y], strict=True) if not hit) if often[x:y].any() else text
                        every.append(kept)
                        n_open += kept.count(" ") + 1
                text = "\n".join(every if n_open > n_main else main)
                for c, v in (("text", text), ("n_chars", len(text)), ("n_repeated", n_repeated)):
                    out[c].append(v)
            yield pa.RecordBatch.from_arrays([rows["page_id"], rows["url"], pa.array(out["text"], pa.string()), pa.array(out["n_chars"], pa.int64()), pa.array(out["n_repeated"], pa.int64())], ["page_id", "url", *out])


def boilerplate(rows: DataFrame, run: int, share: float, least: int, main_share: float, main_least: int, frag_pages: int, part_pages: int) -> DataFrame:
    """(host, often, most) of hosts with boilerplate: hashes of the suffixes that open and main blocks lose."""
    count = rows.groupBy("host").agg(F.count("*").alias("n"))
    total = rows.count()
    large = materialize(count.where(F.col("n") > frag_pages), "hosts")
    cut = rows.select("host", "html").join(large, "host", "left").select("host", "html", "n")
    cut = cut.mapInArrow(partial(_suffixes, run=run, frag_pages=frag_pages, part_pages=part_pages, buckets=max(1, -(-total // frag_pages))), FRAGMENT)
    found = per_group(cut, "frag", _supports, "host long, suffix long, support long", least=min(least, main_least))
    found = materialize(found.groupBy("host", "suffix").agg(F.sum("support").alias("support")), "supports")
    pages = found.where("suffix is null").select("host", F.col("support").alias("pages"))
    found = found.where(F.col("suffix").isNotNull() & (F.col("support") >= min(least, main_least))).join(pages, "host")
    reach = lambda part, n: (F.col("support") >= F.col("pages") * part) & (F.col("support") >= n)
    found = found.where(reach(share, least) | reach(main_share, main_least))
    known = found.groupBy("host").agg(
        F.collect_list(F.when(reach(share, least), F.col("suffix"))).alias("often"), F.collect_list(F.when(reach(main_share, main_least), F.col("suffix"))).alias("most")
    )
    return materialize(known, "boilerplate")


def main_texts(pages: DataFrame, run: int = 10, share: float = 0.5, least: int = 3, main_share: float = 0.8, main_least: int = 5, frag_pages: int = 2000, part_pages: int = 50_000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_repeated) for every row; n_repeated: tokens in boilerplate, of any zone."""
    if not 0 < share <= main_share <= 1 or least < 2 or main_least < 2 or run < 1:
        raise ValueError("0 < share <= main_share <= 1, least and main_least of 2 or more, and run of 1 or more are needed")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    rows = rows.withColumn("host", F.xxhash64(F.coalesce(F.lower(F.regexp_extract("url", HOST, 1)), F.lit(""))))
    known = boilerplate(rows, run, share, least, main_share, main_least, frag_pages, part_pages)
    none = F.array().cast("array<long>")
    read = rows.join(known, "host", "left").select("page_id", "url", "html", "host", F.coalesce("often", none).alias("often"), F.coalesce("most", none).alias("most"))
    return read.mapInArrow(partial(_extract, run=run), "page_id long, url string, text string, n_chars long, n_repeated long")


def op7_html_text(spark, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
