"""Line dedup by site-relative frequency: lines that stand on too large a share of a site's pages are boilerplate.

Pages are grouped by host; a line's pages are counted once each, and divided by the host's pages. The lines of a host
above the ratio are few, at most lines per page / ratio on average, and are kept as one list of hashes per host. The texts
themselves are never shuffled line by line: they are joined to their host's list and filtered in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.llm.shared import own_name, stored

MAX_RATIO = 0.015
MIN_PAGES = 3  # a line on one or two pages is not yet repeated; the same for hosts of any size


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def boilerplate(
    docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """(host, line, n_pages, host_pages): lines with a word on at least ``min_pages`` pages of their host and on a
    share of them above ``max_ratio``. A null host is a host of its own. Long lines are told by their hashes."""
    pages = docs.select(F.col(host).alias("host"), _lines(text).alias("lines"))
    totals = pages.groupBy("host").agg(F.count("*").alias("host_pages"))
    each = pages.select("host", F.explode(F.array_distinct(F.filter("lines", _has_word))).alias("line"))
    # Two hashes stand for the line: rows of the shuffle stay small, and every task counts its own rows first.
    counted = each.groupBy(
        "host", F.xxhash64("line").alias("line"), F.xxhash64(F.lit(7), "line").alias("line_2")
    ).agg(F.count("*").alias("n_pages"))
    counted = counted.filter(F.col("n_pages") >= min_pages)
    totals = totals.select(F.col("host").alias("of"), "host_pages")
    return (
        counted.join(totals, F.col("host").eqNullSafe(F.col("of")))
        .filter(F.col("n_pages") > max_ratio * F.col("host_pages"))
        .select("host", "line", "line_2", "n_pages", "host_pages")
    )


def drop_boilerplate(
    docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES,
    dropped: str | None = None,
) -> DataFrame:
    """``docs`` with its boilerplate lines taken out of ``text``; ``dropped`` names a column for their number.

    All rows stay; one whose lines are all boilerplate has an empty text left. A null text stays null, and lines without
    a word stay. Repeated rows are pages of their own. An empty table gives no rows; other columns are kept as they are.
    """
    found = boilerplate(docs, host, text, max_ratio, min_pages)
    of, listed, hit = own_name(docs, "of"), own_name(docs, "listed"), own_name(docs, "hit")
    # Written first, so that the optimizer knows its size before it plans how to join the texts: while the lists are
    # small they are sent to the texts, and the texts are not shuffled.
    lists = stored(found.groupBy(F.col("host").alias(of)).agg(F.collect_list("line").alias(listed)), "boilerplate")
    joined = docs.join(lists, docs[host].eqNullSafe(F.col(of)), "left")
    # The intersection is one pass with a hash set; it is empty for most pages.
    hashes = F.transform(_lines(text), lambda line: F.xxhash64(line))
    common = F.when(F.col(listed).isNotNull(), F.array_intersect(hashes, F.col(listed)))
    joined = joined.withColumn(hit, common)
    is_hit = F.coalesce(F.size(hit), F.lit(0)) > 0
    kept = F.filter(_lines(text), lambda line: ~F.array_contains(F.col(hit), F.xxhash64(line)))
    number = F.when(is_hit, F.size(_lines(text)) - F.size(kept)).otherwise(0).cast("bigint")
    cleaned = F.when(is_hit, F.array_join(kept, "\n")).otherwise(F.col(text))
    columns = [cleaned.alias(c) if c == text else F.col(c) for c in docs.columns]
    return joined.select(*columns, *([number.alias(dropped)] if dropped else []))
