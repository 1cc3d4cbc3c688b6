"""Resumable scans: pages made of whole chunks, with a cursor that survives later appends."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tidescan.errors import PagingError
from tidescan.operators.scan import Scan, project, select_rows


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    state: tuple | None
    chunks: list[tuple]


def chunk_counts(scan: Scan, df: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Matching rows of every chunk after the cursor, in the order in which pages take them."""
    source, chunk = scan.columns["source"], scan.columns["chunk"]
    return after_cursor(scan, select_rows(scan, df, stats).groupBy(source, chunk).agg(F.count(F.lit(1)).alias("n")))


def take_while(counts: list[int], row_limit: int, threshold: int) -> int:
    """How many leading chunks make a page. Within threshold of the limit: stop after that chunk; above: stop before it."""
    total = 0
    for k, n in enumerate(counts):
        total += n
        if total > row_limit + threshold:
            if not k:
                raise PagingError(f"a chunk of {n} rows exceeds row_limit and threshold")
            return k
        if total >= row_limit - threshold:
            return k + 1
    return len(counts)


def after_cursor(scan: Scan, chunks: DataFrame) -> DataFrame:
    source, chunk = scan.columns["source"], scan.columns["chunk"]
    if scan.stream.state is None:
        return chunks
    s, c = scan.stream.state
    return chunks.where((F.col(source) > F.lit(s)) | ((F.col(source) == F.lit(s)) & (F.col(chunk) > F.lit(c))))


def between(scan: Scan, rows: DataFrame, first: tuple, last: tuple) -> DataFrame:
    """Rows of the chunks from the first to the last one, by bounds that reach the files."""
    source, chunk = (F.col(scan.columns[k]) for k in ("source", "chunk"))
    (s0, c0), (s1, c1) = first, last
    after, upto = (source > F.lit(s0)) | ((source == F.lit(s0)) & (chunk >= F.lit(c0))), (source < F.lit(s1)) | ((source == F.lit(s1)) & (chunk <= F.lit(c1)))
    return rows.where(after & upto & source.between(F.lit(s0), F.lit(s1)))


def leading(scan: Scan, df: DataFrame, stats: DataFrame | None, listed: DataFrame | None) -> tuple[list, bool]:
    """Matching rows of the chunks that come next, in order, as far as a page can need them; whether there are more.

    With a list of chunks and their rows, matches are counted only in as many chunks as hold a page of rows, then in twice as
    many, until the page is full. Without one they are counted in all chunks that are left, and the first come to the driver.
    """
    source, chunk, s = scan.columns["source"], scan.columns["chunk"], scan.stream
    full = lambda ns: sum(ns) >= max(1, s.row_limit - s.threshold) or any(n > s.row_limit + s.threshold for n in ns)
    k = 256
    while True:
        if listed is None:
            found = chunk_counts(scan, df, stats).orderBy(source, chunk).limit(k + 1).collect()
            counts, more = [((r[source], r[chunk]), r["n"]) for r in found[:k]], len(found) > k
        else:
            heads = after_cursor(scan, listed).orderBy(source, chunk).limit(k + 1).collect()
            need, at = s.row_limit + s.threshold, 0
            while at < min(k, len(heads)) and need > 0:
                need, at = need - heads[at]["n_rows"], at + 1
            # Chunks without a match make the counted ones too few: then all of these heads are counted, and then more of them.
            counts, more = [], bool(heads)
            for end in dict.fromkeys((at, min(k, len(heads)))):
                if not end or full([n for _, n in counts]):
                    break
                rows = between(scan, select_rows(scan, df, stats), (heads[0][source], heads[0][chunk]), (heads[end - 1][source], heads[end - 1][chunk]))
                found = rows.groupBy(source, chunk).agg(F.count(F.lit(1)).alias("n")).orderBy(source, chunk).collect()
                counts, more = [((r[source], r[chunk]), r["n"]) for r in found], len(heads) > end
        if not more or full([n for _, n in counts]):
            return counts, more
        k *= 4


def next_page(scan: Scan, df: DataFrame, stats: DataFrame | None = None, listed: DataFrame | None = None) -> Page:
    """The page after scan.stream.state. listed: a small table of all chunks with n_rows, which spares counting beyond the page."""
    s = scan.stream
    counts, more = leading(scan, df, stats, listed)
    taken = counts[: take_while([n for _, n in counts], s.row_limit, s.threshold)]
    more = more or len(counts) > len(taken)
    keys = [key for key, _ in taken]
    rows = select_rows(scan, df, stats)
    return Page(project(scan, between(scan, rows, keys[0], keys[-1]) if keys else rows.where(F.lit(False))), keys[-1] if more and keys else None, keys)


def pages(scan: Scan, df: DataFrame, stats: DataFrame | None = None, listed: DataFrame | None = None) -> Iterator[Page]:
    """All pages, one after another."""
    while True:
        page = next_page(scan, df, stats, listed)
        yield page
        if page.state is None:
            return
        scan = scan.replace(stream=type(scan.stream)(scan.stream.row_limit, scan.stream.threshold, page.state))
