"""Main text of web pages by nearest-URL page differencing.

A page becomes lines, one per block. Within each host pages are sorted by URL path, and each
page is set beside its neighbours in that order. Their lines are aligned by longest common
subsequence; what a page shares with the nearest neighbour is the site's frame, not the page's text, and is deleted.

Structure is evidence for single lines. Elements for navigation, forms, notices, adverts or comments mark frame lines, which
go with or without a neighbour that shares them; but an element that holds an article, or more than half of the
page's text, marks nothing, whatever its name (a form around the whole page, a menu that is never closed). Lines inside an article or main
element are text, even if a neighbour repeats them: copies of an article share all of it. All other lines are
decided by differencing.

Equal pages of a host (by a hash of their lines) count as one, so neighbours are distinct pages however many copies stand
between. Two on either side are asked. The nearest that shares something, but less than half of the lines, gives the frame.
Where all share half or more, a line is of the frame if at least two of these distinct pages share it; with only one
such page a frame can't be told from an edited copy, and nothing is deleted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm.common import forget, ship, slices, written

#: Elements that never hold text; elements of a page's frame; elements that end a block; void elements; elements that class words don't mark.
NO_TEXT = frozenset("head script style noscript template svg iframe object canvas audio video".split())
FRAME = frozenset("nav header footer aside form button select textarea dialog menu".split())
BLOCK = frozenset("p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre section article main figure figcaption address details summary hr body html fieldset center".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNMARKED = frozenset("html body main p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd td th tr figcaption".split())
#: Whole words of class, id or role that mark an element as frame.
MARKS = frozenset("ad ads advert advertisement banner sponsor sponsored promo cookie cookies consent notice alert popup modal newsletter subscribe sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination toolbar footer header masthead comment comments discussion replies disqus share sharing social related recommended widget login signup search".split())
#: Bytes of the lines to delete up to which they are broadcast; beyond, Spark shuffles both sides.
BROADCAST_BYTES = 16 << 20
#: Bits of the table of one alignment; longer pages are aligned in halves.
TABLE_BITS = 1 << 26
_URL = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)")


class _Page(HTMLParser):
    """Collects (text, frame elements around it, inside article or main) for each block, in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, tuple[int, ...], bool]] = []
        self.open: list[tuple[str, bool, tuple[int, ...], bool]] = []  # element, without text, frame elements, in an article
        self.parts: list[str] = []
        self.frames = 0
        self.holding: set[int] = set()  # frame elements that hold an article

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append((text, *(self.open[-1][2:] if self.open else ((), False))))
        self.parts = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.flush()
        else:
            self.parts.append(" " if tag in ("br", "img") else "")
        if tag in VOID:
            return
        if tag == "body" or (tag in BLOCK and tag != "html" and self.open and self.open[-1][0] == "head"):
            self.close_to("head")
        if tag == "p" and self.open and self.open[-1][0] == "p":
            self.open.pop()
        empty, frames, inside = self.open[-1][1:] if self.open else (False, (), False)
        words = {w for k, v in attrs if k in ("class", "id", "role") for w in (v or "").lower().split()}
        hidden = any(k == "hidden" or (k == "aria-hidden" and v == "true") for k, v in attrs)
        frame = (tag in FRAME and not (tag == "header" and inside)) or (tag not in UNMARKED and bool(words & MARKS)) or hidden
        empty = empty or tag in NO_TEXT
        if frame:
            self.flush()
            self.frames += 1
            frames = (*frames, self.frames)
        elif tag in ("article", "main") and not empty:
            self.holding.update(frames)
            inside = True
        self.open.append((tag, empty, frames, inside))

    def close_to(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                outer = self.open[i - 1][2] if i else ()
                if self.open[-1][2] != outer or any(t in BLOCK for t, *_ in self.open[i:]):
                    self.flush()
                del self.open[i:]
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.close_to(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        self.close_to(tag)

    def handle_data(self, data: str) -> None:
        if not (self.open and self.open[-1][1]):
            self.parts.append(data)


def blocks(html: str | None) -> list[tuple[str, bool]]:
    """(text, inside an article or main element) of a page's blocks, without those that an element marks as frame."""
    page = _Page()
    page.feed(html or "")
    page.close()
    page.flush()
    total = sum(len(t) for t, _, _ in page.blocks)
    held: dict[int, int] = {}
    for text, frames, _ in page.blocks:
        for f in frames:
            held[f] = held.get(f, 0) + len(text)
    marking = {f for f, n in held.items() if f not in page.holding and 2 * n <= total}
    return [(text, inside) for text, frames, inside in page.blocks if not marking.intersection(frames)]


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of a and each beginning of b."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes((len(b) + 7) // 8, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def lcs(a: list[int], b: list[int]) -> list[int]:
    """Positions in a of a longest common subsequence of a and b (rows of the table as bits of integers)."""
    in_b, in_a = set(b), set(a)
    ia, b = [i for i, x in enumerate(a) if x in in_b], [x for x in b if x in in_a]
    head = 0
    while head < min(len(ia), len(b)) and a[ia[head]] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(ia), len(b)) - head and a[ia[-1 - tail]] == b[-1 - tail]:
        tail += 1
    out = ia[:head] + (ia[len(ia) - tail :] if tail else [])
    mid, b = ia[head : len(ia) - tail], b[head : len(b) - tail]
    if not mid or not b:
        return sorted(out)
    if len(mid) > 1 and len(mid) * len(b) > TABLE_BITS:
        half = len(mid) // 2
        ahead, behind = _lengths([a[i] for i in mid[:half]], b), _lengths([a[i] for i in mid[:half - 1:-1]], b[::-1])
        j = int(np.argmax(ahead + behind[::-1]))
        for part, other in ((mid[:half], b[:j]), (mid[half:], b[j:])):
            out += [part[i] for i in lcs([a[i] for i in part], other)]
        return sorted(out)
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, []  # a zero bit: the table steps up at this column
    for i in mid:
        m = places.get(a[i], 0)
        u = v & m
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    j = len(b) - 1
    for r in range(len(mid) - 1, -1, -1):
        above = rows[r - 1] if r else full
        # length at (r, j) is the number of zeros up to j; step left to the last column where this row steps up
        zeros = ~rows[r] & ((1 << (j + 1)) - 1)
        if not zeros:
            break
        if (~above & ((1 << (j + 1)) - 1)).bit_count() == zeros.bit_count():
            continue
        j = zeros.bit_length() - 1
        out.append(mid[r])
        j -= 1
    return sorted(out)


def _near(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _place(url: str | None) -> tuple[str, str]:
    m = _URL.match(url or "")
    return (m[1].lower(), m[2]) if m else ("", url or "")


def _sign(own: list[tuple[str, bool]]) -> int:
    """Hash of a page's lines and marks."""
    return xxhash.xxh3_64_intdigest("\n".join(f"{int(x)}{t}" for t, x in own)) - 2**63


def frame(path: str, hashes: list[int], fixed: list[bool], beside: list[dict], copy_share: float = 0.5) -> list[int]:
    """Positions of a page's lines that are the site's frame: shared with its neighbours (path and hashes each), and not fixed."""
    if all(fixed):
        return []
    times: dict[int, int] = {}
    for x in sorted((x for x in beside if x["hashes"]), key=lambda x: -_near(path, x["path"])):
        shared = lcs(hashes, x["hashes"])
        if 0 < len(shared) < copy_share * len(hashes):
            break
        for i in shared:
            times[i] = times.get(i, 0) + 1
    else:
        shared = sorted(i for i, k in times.items() if k > 1)
        if len(shared) == len(hashes):  # all of it stands elsewhere, too: no frame can be told
            shared = []
    return [i for i in shared if not fixed[i]]


def extract(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", html_col: str = "html", copy_share: float = 0.5) -> DataFrame:
    """page_id, url, text, n_chars long: a row per row of pages.

    Blocks are joined by one newline; white space inside a block is one blank; character references are decoded. A null
    or empty html gives an empty text. A null or relative URL has the host "" and stands beside others of that kind; pages
    without a neighbour on their host keep what structure leaves. Equal pages of a host, repeated rows among them, get the same
    text. Pages of one URL are ordered by their key. Other columns are left out; an empty table gives no rows.
    """
    spark = pages.sparkSession
    ship(spark)
    rows = pages.select(F.col(html_col).alias("html"), F.col(key_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    kind = dict(rows.dtypes)["page_id"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            hosts, paths, sigs, fixed, hashes, lines = [], [], [], [], [], []
            for html, url in zip(b.column("html").to_pylist(), b.column("url").to_pylist(), strict=True):
                host, path = _place(url)
                own = blocks(html)
                hosts.append(host)
                paths.append(path)
                sigs.append(_sign(own))
                fixed.append([x for _, x in own])
                lines.append([t for t, _ in own])
                hashes.append([xxhash.xxh3_64_intdigest(t) - 2**63 for t, _ in own])
            made = [pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(sigs, pa.int64()), pa.array(fixed, pa.list_(pa.bool_())), pa.array(hashes, pa.list_(pa.int64())), pa.array(lines, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), *made], names=["page_id", "url", "host", "path", "sig", "fixed", "hashes", "lines"])

    # each page is parsed once; only hashes of lines are sorted and set side by side
    parsed = written(rows.mapInArrow(parse, f"page_id {kind}, url string, host string, path string, sig long, fixed array<boolean>, hashes array<long>, lines array<string>"), "pages")
    # equal pages of a host stand once
    light = parsed.groupBy("host", "sig").agg(F.min(F.struct("path", "page_id", "fixed", "hashes")).alias("x")).select("host", "sig", "x.*")
    light = written(light, "lines")
    order = ["host", "path", "page_id", "sig"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # ranges, not hosts, are dealt out: one host may hold most pages
    ranges = written(light.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "ranges")
    forget(light)
    side = F.struct("host", "path", "hashes")
    beyond = {"b1": F.lag(side, 1), "b2": F.lag(side, 2), "a1": F.lead(side, 1), "a2": F.lead(side, 2)}
    w = Window.partitionBy("part").orderBy(*order)
    back = Window.partitionBy("part").orderBy(*[F.desc(c) for c in order])
    edges = ranges.withColumn("up", F.row_number().over(w)).withColumn("down", F.row_number().over(back)).where("up <= 2 or down <= 2")
    # four rows a range at most
    over = Window.orderBy(*order)
    edges = edges.select(F.col("host").alias("h"), F.col("sig").alias("s"), *[x.over(over).alias(f"edge_{k}") for k, x in beyond.items()])
    beside = ranges.select("part", "sig", "host", "path", "fixed", "hashes", *[x.over(w).alias(k) for k, x in beyond.items()])
    beside = beside.join(edges, (F.col("host") == F.col("h")) & (F.col("sig") == F.col("s")), "left")
    beside = beside.select("sig", "host", "path", "fixed", "hashes", *[F.coalesce(k, f"edge_{k}").alias(k) for k in beyond])

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 200):
                part = b.slice(start, 200)
                gone = [frame(r["path"], r["hashes"], r["fixed"], [x for x in (r["b1"], r["a1"], r["b2"], r["a2"]) if x and x["host"] == r["host"]], copy_share) or None for r in part.select(["host", "path", "fixed", "hashes", "b1", "b2", "a1", "a2"]).to_pylist()]
                out = pa.RecordBatch.from_arrays([part.column("host"), part.column("sig"), pa.array(gone, pa.list_(pa.int32()))], names=["host", "sig", "gone"])
                yield out.filter(out.column("gone").is_valid())

    gone = written(beside.mapInArrow(differ, "host string, sig long, gone array<int>").select(F.col("host").alias("h"), F.col("sig").alias("s"), "gone"), "shared-lines")
    forget(ranges)
    size = gone.agg(F.sum(4 * F.size("gone") + F.octet_length("h") + 40)).first()[0] or 0
    few = F.broadcast(gone) if size <= BROADCAST_BYTES else gone
    out = parsed.join(few, (F.col("host") == F.col("h")) & (F.col("sig") == F.col("s")), "left")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone")), lambda i: F.col("lines")[i])
    text = F.array_join(F.when(F.col("gone").isNull(), F.col("lines")).otherwise(kept), "\n")
    return out.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
