"""Line dedup by site-relative frequency; DataFrame operations only.

A line is boilerplate of a host if more than one of the host's pages contain it and their share exceeds a ratio. Such
lines are dropped from all pages of the host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.shared import saved

#: Share of a host's pages above which a line is boilerplate; a line of a single page repeats nothing, whatever its share.
RATIO, PAGES = 0.1, 2
HIDDEN = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->"
BREAKS = r"(?i)</?(?:p|div|li|ul|ol|h[1-6]|br|tr|td|th|table|nav|article|header|footer|title|section|aside|body|head|html)(?:[\s/][^>]*)?>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def lines(html: Column) -> Column:
    """The lines of a page's text: scripts, styles and comments go, block tags break lines, other tags go, ends are
    trimmed, empty lines go."""
    shown = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, "")
    text = F.regexp_replace(F.regexp_replace(shown, BREAKS, "\n"), "<[^>]*>", "")
    return F.filter(F.transform(F.split(text, r"\n"), lambda x: F.trim(F.translate(x, "\t\r", "  "))), lambda x: x != "")


def kept_lines(df: DataFrame, ratio: float = RATIO, pages: int = PAGES) -> DataFrame:
    """One row for each page: page_id, host, n_lines, n_dropped, kept (array of lines).

    ``df`` has page_id, url and html. A line counts once for each page however often it stands there. Pages without a
    host lose nothing, null html has no lines, repeated rows count as often as they occur: two equal pages that are all of
    a host lose every line. A host of one page loses nothing. An empty table gives no rows; other columns are left aside.
    Lines are compared by their 64-bit hashes within a host.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))
    table = saved(df.select("page_id", host.alias("host"), lines(F.col("html")).alias("lines")), "lines")
    sited = table.where("host != ''")
    holds = sited.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x)))).alias("line"))
    counts = holds.groupBy("host", "line").agg(F.count("*").alias("holding")).where(F.col("holding") >= pages)
    totals = sited.groupBy(F.col("host").alias("of")).agg(F.count("*").alias("total"))
    common = counts.join(totals, F.col("host") == F.col("of")).where(F.col("holding") > ratio * F.col("total"))
    # At most (lines of a page on average / ratio) for each host.
    dropped = saved(common.groupBy(F.col("of").alias("site")).agg(F.collect_set("line").alias("dropped")), "dropped")
    joined = table.join(dropped, F.col("host") == F.col("site"), "left")
    kept = F.filter("lines", lambda x: ~F.coalesce(F.array_contains("dropped", F.xxhash64(x)), F.lit(False)))
    size = F.size("lines").cast("long")
    return joined.select("page_id", "host", size.alias("n_lines"), "lines", kept.alias("kept")).select("page_id", "host", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), "kept")


def report(df: DataFrame, ratio: float = RATIO, pages: int = PAGES) -> DataFrame:
    """As kept_lines(), with the hash of the kept lines in place of them."""
    found = kept_lines(df, ratio, pages)
    digest = F.sha2(F.array_join("kept", "\n").cast("binary"), 256)
    return found.select("page_id", "host", "n_lines", "n_dropped", digest.alias("kept_sha256"))


ORACLE = rf"""
WITH shown AS (
    SELECT row_number() OVER () AS k, page_id, lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)) AS host,
        regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{HIDDEN}', '', 'g'), '{BREAKS}', chr(10), 'g'), '<[^>]*>', '', 'g') AS t
    FROM pages
), lines AS (
    SELECT k, page_id, host, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(translate(x, chr(9) || chr(13), '  '))), lambda x: x <> '') AS ls FROM shown
), holds AS (
    SELECT host, unnest(list_distinct(ls)) AS line FROM lines WHERE host <> ''
), common AS (
    SELECT h.host, line FROM (SELECT host, line, count(*) AS n FROM holds GROUP BY ALL) h
    JOIN (SELECT host, count(*) AS total FROM lines GROUP BY ALL) t ON h.host = t.host WHERE n >= 2 AND n > 0.1 * total
), dropped AS (SELECT host, list(line) AS d FROM common GROUP BY ALL
), kept AS (
    SELECT page_id, l.host, ls, list_filter(ls, lambda x: NOT coalesce(list_contains(d, x), false)) AS kept FROM lines l LEFT JOIN dropped USING (host)
)
SELECT page_id, host, len(ls)::BIGINT AS n_lines, (len(ls) - len(kept))::BIGINT AS n_dropped, sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256 FROM kept
"""
