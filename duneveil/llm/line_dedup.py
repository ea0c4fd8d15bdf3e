"""Line dedup by site-relative frequency (DataFrame operations only).

Pages are grouped by host.  A line's ratio is the number of its host's pages that hold it over the number of
the host's pages; lines above the ratio are the site's frame, not content, and go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import n_words, private, saved

RATIO = 0.1
#: A line frames a site if it stands on two pages at least; a site of one page has no frame.
MIN_PAGES = 2


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; null or no host: the empty text."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1)), F.lit(""))


def html_lines(html: Column) -> Column:
    """The text between tags and line ends, trimmed, without blank ones."""
    return F.filter(F.transform(F.split(F.regexp_replace(html, "<[^>]*>", "\n"), "\n"), trimmed), lambda x: x != "")


def text_lines(text: Column) -> Column:
    """The lines of a plain text as they are; blank ones stay."""
    return F.split(text, "\n")


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))


def fingerprint(line: Column) -> Column:
    """A 64-bit hash of a trimmed line; null for a blank one.

    A line is lost to a collision only if it meets one of its own site's few frame lines.
    """
    x = trimmed(line)
    return F.when(x != "", F.xxhash64(x))


def drop_site_lines(
    pages: DataFrame, id_col: str, site: Column, lines: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES, max_loss: float = 1.0, min_words: int = 1,
    copies_once: bool = False,
) -> DataFrame:
    """pages with the columns site, n_lines, n_dropped and kept_text (kept lines joined by line feeds).

    lines: an array of texts.  A line is dropped if at least min_pages pages of its site hold it and they are
    more than ratio of the site's pages.  Lines are compared trimmed; blank ones count for nothing and stay.
    Lines of fewer than min_words words stay as well.
    copies_once: the pages that hold a line count by their longest other line, so that copies, whose lines are all
    content, count once; and a page that would lose all its lines is left whole.  Copies that differ in their
    longest line count as often as it does.
    A page counts once for a line it repeats.  A page that would lose more than max_loss of its lines that are
    not blank is left whole: it is a copy of other pages and not framed by them (1.0: no page is).
    Null lines: kept_text null, counts 0.  A null site is a site.  Repeated rows are pages of their own, very long
    pages count with all their lines, ties don't arise, and an empty table gives an empty result.
    Columns of pages that bear the names of results are replaced; other columns pass, whatever their names.  The
    frames of all sites are a written table: pages meet it by a broadcast only where its size allows, and else by a
    join on the site, whose hot keys adaptive execution splits.  A site's frame has at most (lines a page) / ratio
    entries.
    """
    at, texts, marks, solid_, bad, drop, lost_ = private("site", "lines", "prints", "solid", "frame", "drop", "lost")
    rows = pages.withColumns({at: site, texts: lines})
    count = lambda x: F.size(F.filter(x, lambda y: y.isNotNull()))
    every = F.transform(texts, fingerprint)
    long = F.transform(texts, lambda x: F.when(n_words(trimmed(x)) >= min_words, fingerprint(x))) if min_words > 1 else every
    rows = rows.withColumns({marks: long, solid_: count(every)})
    narrow = rows.select(F.col(at).alias("site"), F.col(texts).alias("lines"), F.col(marks).alias("prints"))
    prints = F.explode(F.array_distinct(F.filter("prints", lambda x: x.isNotNull()))).alias("print")
    if copies_once:
        sized = F.filter(F.transform("lines", lambda x: F.struct(F.length(trimmed(x)).alias("size"), fingerprint(x).alias("print"))), lambda x: x["print"].isNotNull())
        longest = narrow.withColumn("sized", sized).withColumn("top", F.array_max("sized")["print"])
        longest = longest.withColumn("next", F.array_max(F.filter("sized", lambda x: x["print"] != F.col("top")))["print"])
        other = F.coalesce(F.when(F.col("print") == F.col("top"), F.col("next")).otherwise(F.col("top")), F.col("print"))
        prints = longest.select("site", "top", "next", prints).select("site", "print", other.alias("other")).distinct()
    else:
        prints = narrow.select("site", prints)
    held = prints.groupBy("site", "print").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") >= min_pages)
    totals = narrow.groupBy(F.col("site").alias("of")).agg(F.count(F.lit(1)).alias("pages"))
    frame = held.join(totals, F.col("site").eqNullSafe(F.col("of"))).filter(F.col("held") > F.lit(ratio) * F.col("pages"))
    frame = saved(frame.groupBy("site").agg(F.collect_list("print").alias(bad)), "frames")
    (key,) = private("key")
    rows = rows.join(frame.withColumnRenamed("site", key), F.col(at).eqNullSafe(F.col(key)), "left")
    marked = F.transform(marks, lambda x: F.coalesce(F.array_contains(bad, x), F.lit(False)))
    rows = rows.withColumn(drop, F.when(F.col(bad).isNotNull(), marked))
    lost = F.coalesce(F.size(F.filter(drop, lambda x: x)), F.lit(0))
    whole = lost > F.lit(max_loss) * F.col(solid_)
    if copies_once:
        whole = whole | (lost == F.col(solid_))
    rows = rows.withColumn(lost_, F.when(whole, 0).otherwise(F.greatest(lost, F.lit(0))))
    kept = F.filter(texts, lambda x, i: ~F.element_at(drop, i + 1))
    text = F.array_join(F.when(F.col(lost_) > 0, kept).otherwise(F.col(texts)), "\n")
    solid = F.greatest(F.coalesce(F.col(solid_), F.lit(0)), F.lit(0)).cast("long")
    results = {"site": F.col(at), "n_lines": solid, "n_dropped": F.coalesce(F.col(lost_), F.lit(0)).cast("long"), "kept_text": text}
    return rows.select(*(F.col(f"`{x}`") for x in pages.columns if x not in results), *(x.alias(n) for n, x in results.items()))
