"""Line removal by site-relative frequency, in DataFrame operations only.

Lines are what is left of a page's HTML between tags, without scripts, styles
and comments, trimmed of spaces; empty ones don't count.  A line that more than
``ratio`` of its host's pages have, and at least ``least`` of them, is
boilerplate and goes from all pages of the host.

A page counts a line once, so a host has at most ``lines per page / ratio``
boilerplate lines, and they travel to the pages as one short array a host.  A host with a
third of all pages is dealt to ``SALTS`` keys in both joins.

Markup is stripped once: the lines are written to the shared folder and read from there.

Null HTML has no lines; a null or odd URL has the host ''.  Repeated rows are
pages of their own, null ids are kept, an empty table gives none, very long pages are
cut into lines whole, and columns with this module's own names don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import written

RATIO = 0.2
LEAST = 3
SALTS = 32
HOST = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)"
HIDDEN = "(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
TAG = "<[^>]*>"


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def lines_of(html: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(html, HIDDEN, ""), TAG, "\n")
    return F.coalesce(F.filter(F.transform(F.split(bare, "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 0), F.array().cast("array<string>"))


def remove_boilerplate(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """page_id, host, n_lines, n_removed, kept_text (lines joined by newlines) of every page."""
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), lines_of(F.col(html_col)).alias("lines"))
    rows = written(rows, "lines")
    keys = F.transform("lines", lambda x: F.unhex(F.md5(x)))
    found = rows.select("host", F.explode(F.array_distinct(keys)).alias("key")).groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    totals = rows.groupBy(F.col("host").alias("of_host")).agg(F.count("*").alias("pages")).withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = found.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    common = found.join(totals, (F.col("host") == F.col("of_host")) & (F.col("salt") == F.col("of_salt"))).where(F.col("n") > F.col("pages") * ratio)
    common = common.groupBy(F.col("host").alias("of_host")).agg(F.collect_list("key").alias("common")).withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    held = rows.join(common, (F.col("host") == F.col("of_host")) & (F.col("salt") == F.col("of_salt")), "left")
    kept = F.when(F.col("common").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col("common"), F.unhex(F.md5(x)))))
    held = held.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"))
    return held.select("page_id", "host", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_removed"), F.array_join("kept", "\n").alias("kept_text"))
