"""HTML extraction (operator 3): nearest-URL page differencing.

Every page is cut into text lines (one for each block). Lines inside menus, forms, footers and other parts that say by tag, role or name that they are no article are out
at once; of the others, those inside the page's article (or main part) are preferred when there is one. Then pages are differenced: within each host, pages are put in order
of URL path, and each page is aligned with the two pages before and the two pages after it by the longest common subsequence of their lines. Pages equal in all lines count as one
place in that order, and a page that shares nearly all with this one is a copy that says nothing about boilerplate (outside articles only if at most two do, and not all: more are a frame). A line votes for boilerplate with every aligned page that shares it:

- outside an article two votes delete a line (where there is only one page to compare with: one vote, if the page keeps half of its text);
- inside an article or main element all four pages must share it: articles do share lines (quotes, licences, short sentences), README has figures, but not with all pages around them.

Scale: what is ordered and aligned is line hashes. The order is a range partitioning by (host, path, id), so a host with a third of all pages spreads over many tasks; the
two first and the two last distinct pages of each range are handed to the neighbouring ranges, so that the cuts change nothing.

Defined cases: a null html is empty and gives the empty text; a null or odd url has the empty host; ties in the path go by page id; repeated rows are pages of their own and
copies of each other; long pages are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import Scratch, chunks, table

OUT, OTHER, CUE, MAIN = 0, 1, 2, 3
#: Fixed lists: tags whose content is no text, parts that are never the article, blocks, and tags without content.
SILENT = ("script", "style", "noscript", "template", "iframe", "svg", "math", "canvas", "object", "textarea", "select", "title", "video", "audio")
CHROME = {"nav", "footer", "aside", "form", "head", "menu", "dialog", "button", "fieldset"}
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class names, ids and roles that mark a part as no article.
NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "share sharing social related recommended recommendations sidebar widget widgets breadcrumb breadcrumbs menu navbar nav navigation footer masthead comment comments disqus reply replies respond login "
    "paywall pagination pager toolbar skip contentinfo complementary search dialog hidden".split()
)
HEADS = {"header", "topbar", "banner"}
#: Parts of longer names (`commentlist`, `topnav`) that mean the same; names of parts that hold an article; what an article can't stand in.
STEMS = re.compile("comment|advert|sidebar|footer|cookie|newsletter|sponsor|breadcrumb|navbar|topnav|sitenav|navigation|pagination|popup|subscri|masthead|disqus")
HOLDERS = {"article", "content", "post", "entry", "story"}
CLOSED = {"aside", "footer", "form", "comment", "comments", "commentlist", "sidebar", "footer", "related", "recommended", "recommendations", "disqus", "hidden"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(" + "|".join(SILENT) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S | re.I)
_NAMED = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _words(attributes: str) -> set[str]:
    return {w.lower() for m in _NAMED.finditer(attributes) for w in _WORDS.findall(m[1] or m[2] or m[3] or "")}


def lines_of(page: str) -> list[tuple[str, int]]:
    """(text, OUT / OTHER / CUE / MAIN) of every block with text, in page order. CUE: in a part that is named like an article."""
    found: list[tuple[str, int, int]] = []
    # tag, no article from here on (1: but an article element inside is one, 2: nothing inside is), number of the article around, inside a link, in a part named like an article
    stack: list[tuple[str, int, int, bool, bool]] = []
    buffer: list[str] = []
    linked = total = articles = 0

    def close_block() -> None:
        nonlocal linked, total
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text:
                _, out, article, _, cue = stack[-1] if stack else ("", 0, 0, False, False)
                only_links = not article and linked > 0.6 * max(total, 1)
                found.append((text, OUT if out or only_links else MAIN if article else CUE if cue else OTHER, article))
            buffer.clear()
            linked = total = 0

    def take(text: str) -> None:
        nonlocal linked, total
        buffer.append(text)
        if not text.isspace():
            total += len(text)
            if stack and stack[-1][3]:
                linked += len(text)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            take(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if not tag:
            if m[1] and m[1].lower() in ("video", "audio", "textarea", "select"):
                buffer.append(" ")
            continue
        tag = tag.lower()
        if tag == "br":
            buffer.append(" ")
        elif m[2]:
            if tag in BLOCKS:
                close_block()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        else:
            if tag in BLOCKS:
                close_block()
            if tag in VOID or m[4].endswith("/"):
                continue
            if tag in ("p", "li") and stack and stack[-1][0] == tag:
                stack.pop()  # the end tag may be left out
            out, article, link, cue = stack[-1][1:] if stack else (0, 0, False, False)
            words = _words(m[4]) if m[4] else set()
            whole = tag in ("body", "html")
            named = not whole and (words & NAMES or any(STEMS.search(w) for w in words) or words & HEADS and not article or m[4] and _HIDDEN.search(m[4]))
            if out == 1 and tag in ("article", "main"):
                out = 0
            if tag in CHROME or tag == "header" and not article or named:
                hard = tag in CLOSED or words & CLOSED or any("comment" in w for w in words) or out == 2
                out = 2 if hard else 1
            if tag in ("article", "main") and not out and not article:
                articles += 1
                article = articles
            cue = cue or bool(words & HOLDERS) and not whole and tag != "a"
            stack.append((tag, out, article, link or tag == "a", cue))
    if at < len(page):
        rest = page[at:]
        cut = rest.rfind("<")
        take(rest if cut < 0 or not re.match(r"</?[a-zA-Z!]", rest[cut:]) else rest[:cut])
    close_block()
    sizes: dict[int, int] = {}
    for text, kind, article in found:
        if kind == MAIN:
            sizes[article] = sizes.get(article, 0) + len(text)
    largest = max(sizes, key=lambda a: (sizes[a], -a), default=0)
    return [(text, kind if kind != MAIN or article == largest else OUT) for text, kind, article in found]


def candidates(page: str) -> tuple[list[str], bool]:
    """Lines that may be the article, and whether they come from an article part."""
    lines = lines_of(page)
    for wanted in (MAIN, CUE):
        if some := [t for t, k in lines if k == wanted]:
            return some, wanted == MAIN
    return [t for t, k in lines if k == OTHER], False


def common(a: list[int], b: list[int]) -> list[int]:
    """Places in a of a longest common subsequence with b: matches in order of a, longest chain rising in b."""
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    tails: list[int] = []
    ends: list[int] = []
    links: list[tuple[int, int]] = []
    for i, x in enumerate(a):
        for j in reversed(places.get(x, ())):
            k = bisect_left(tails, j)
            links.append((i, ends[k - 1] if k else -1))
            if k == len(tails):
                tails.append(j)
                ends.append(len(links) - 1)
            else:
                tails[k], ends[k] = j, len(links) - 1
    out, at = [], ends[-1] if ends else -1
    while at >= 0:
        out.append(links[at][0])
        at = links[at][1]
    return out[::-1]


#: A page that shares more than this part of the characters of both is a copy. A page compared with one other keeps this part of its characters at least.
COPY, LEFT = 0.9, 0.5
#: Pages on each side that a page is compared with.
NEAR = 2


def shared(page: dict, others: list[dict]) -> list[int]:
    """Lines of page to delete, given the nearest different pages on its host."""
    size, votes = sum(page["sizes"]) or 1, [0] * len(page["hashes"])
    found = [common(page["hashes"], other["hashes"]) for other in others]
    copies = [sum(page["sizes"][i] for i in same) > COPY * max(size, sum(other["sizes"])) for same, other in zip(found, others, strict=True)]
    if not page["main"] and (sum(copies) > NEAR or len(copies) > 1 and all(copies)):
        copies = [False] * len(copies)  # so many are no copies of a text but a large frame with little in it
    pages = len(copies) - sum(copies)
    for same, copy in zip(found, copies, strict=True):
        for i in () if copy else same:
            votes[i] += 1
    gone = [i for i, n in enumerate(votes) if n >= (2 * NEAR if page["main"] else min(2, pages) or 1)]
    if pages == 1 and sum(page["sizes"][i] for i in gone) > LEFT * size:
        return []
    return gone


LINES = "part int, host string, path string, id long, mark long, real boolean, main boolean, hashes array<long>, sizes array<int>"


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for part, texts in chunks(batches, "html"):
        rows = []
        for page in texts:
            lines, main = candidates(page)
            rows.append((main, np.asarray([xxhash.xxh3_64_intdigest(t) for t in lines], np.uint64).view(np.int64), [len(t) for t in lines]))
        kinds = [pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("host", "path", "id", "mark")), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["host", "path", "id", "mark", "main", "hashes", "sizes"])


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (part, host, path, id) to (id, mark, drop). Equal pages in a row are one place; a place is decided once NEAR places after it are seen."""
    places: list[dict] = []  # NEAR decided ones, then those that wait

    def done(at: int) -> list[tuple]:
        here = places[at]
        if not here["members"]:
            return []
        near = [*places[max(0, at - NEAR) : at], *places[at + 1 : at + 1 + NEAR]]
        drop = shared(here, [o for o in near if o["host"] == here["host"] and o["part"] == here["part"]])
        return [(*m, drop) for m in here["members"]] if drop else []

    def batches_of(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(rows), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[a : a + 1000], strict=True), [pa.int64(), pa.int64(), pa.list_(pa.int32())], strict=True)], names=["id", "mark", "drop"])

    decided = 0  # of places
    for batch in batches:
        rows: list[tuple] = []
        for page in batch.to_pylist():
            member = [(page["id"], page["mark"])] if page["real"] else []
            if places and all(places[-1][c] == page[c] for c in ("part", "host", "main", "hashes")):
                places[-1]["members"] += member
                continue
            places.append({**page, "members": member})
            if len(places) - decided > NEAR:
                rows += done(decided)
                decided += 1
            if decided > NEAR:
                del places[0]
                decided -= 1
        yield from batches_of(rows)
    yield from batches_of([row for at in range(decided, len(places)) for row in done(at)])


def extract(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "pages")
    url = F.coalesce("url", F.lit(""))
    keyed = pages.select(
        F.col(id_col).alias("id"), F.xxhash64("url", "html").alias("mark"), "url", "html",
        F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1).alias("path"),
    )
    order = ["host", "path", "id", "mark"]
    found = keyed.select(*order, "html").mapInArrow(_hashes, LINES.replace("part int, ", "").replace("real boolean, ", ""))
    # as many ranges as the session shuffles into, each about the same number of pages
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = scratch.save(found.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()), "lines")

    # the NEAR first and last places of each range also stand in the ranges beside it
    place = ranged.groupBy("part", "host", "main", F.xxhash64("hashes").alias("print")).agg(F.min(F.struct(*order)).alias("lo"), F.max(F.struct(*order)).alias("hi"))
    firsts = place.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy("lo"))).where(F.col("n") <= NEAR).select("part", F.col("lo").alias("at"), F.lit(-1).alias("step"))
    lasts = place.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("hi")))).where(F.col("n") <= NEAR).select("part", F.col("hi").alias("at"), F.lit(1).alias("step"))
    numbered = ranged.select("part").distinct().withColumn("nth", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("part")))  # a row for each range
    moved = firsts.unionByName(lasts).join(numbered, "part").select("part", "at.*", (F.col("nth") + F.col("step")).alias("nth"))
    moved = moved.join(numbered.withColumnRenamed("part", "to"), "nth")
    same = [ranged[c].eqNullSafe(moved[c]) for c in order]
    guests = ranged.join(moved, [ranged["part"] == moved["part"], *same]).select(moved["to"].alias("part"), *[ranged[c] for c in (*order, "main", "hashes", "sizes")]).dropDuplicates(["part", *order]).withColumn("real", F.lit(False))
    rows = ranged.withColumn("real", F.lit(True)).unionByName(guests).select(*[c.split()[0] for c in LINES.split(", ")])
    drop = rows.repartition("part").sortWithinPartitions("part", *order).mapInArrow(_aligned, "id long, mark long, drop array<int>")
    drop = scratch.save(drop.where("size(drop) > 0").dropDuplicates(["id", "mark"]), "drop")

    both = keyed.alias("k").join(drop.alias("d"), F.col("k.id").eqNullSafe(F.col("d.id")) & (F.col("k.mark") == F.col("d.mark")), "left").select("k.id", "k.url", "k.html", "d.drop")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, "html"):
            out = []
            for t, gone in zip(texts, part.column("drop").to_pylist(), strict=True):
                gone = set(gone or ())
                out.append("\n\n".join(line for i, line in enumerate(candidates(t)[0]) if i not in gone))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(out, pa.string())], names=[id_col, "url", "text"])

    return both.mapInArrow(assemble, f"{id_col} long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
