"""URL filters with dated lists: entries become validity intervals, captures look up their time.

A list is a log of ``(entry, at, action)``: from ``at`` on, hosts equal to or below ``entry`` are
blocked (``add``) or no longer (``remove``). Each entry's log is turned into intervals, cut at the
borders of months; a capture is joined on entry and month to the interval open when it was
fetched. One capture meets at most one interval of each domain above its host, however long the
log, and neither a busy host nor a busy entry meets in one task: captures are first brought down
to distinct hosts and times, entries to one row per instant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ADD, REMOVE = "add", "remove"


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, without user, port and closing dot; null if there is none."""
    found = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    host = F.regexp_replace(F.lower(found), r"\.+$", "")
    return F.when(host != "", host)


def domains_above(host: Column) -> Column:
    """The host and every domain above it, longest first."""
    parts = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."),
    )


def month(at: Column) -> Column:
    return (F.year(at) * 12 + F.month(at)).cast("int")


def intervals(entries: DataFrame, until: DataFrame) -> DataFrame:
    """``(entry, month, starts, ends, active_from)``: when each entry was active, by month.

    ``until`` holds one row with the last time asked for, as ``last``. An entry added and removed
    at the same instant is active from then on. Rows with a null and unknown actions say nothing.
    ``ends`` is exclusive and null in the last month of a run that is still going.
    """
    log = (
        entries.select(
            F.lower(F.trim("entry")).alias("entry"), F.col("at"),
            F.when(F.col("action") == ADD, 1).when(F.col("action") == REMOVE, 0).alias("on"),
        )
        .dropna()
        .groupBy("entry", "at")
        .agg(F.max("on").alias("on"))
        .withColumn("month", month(F.col("at")))
    )
    # what holds when a month begins: one row per entry and month
    ends = log.groupBy("entry", "month").agg(
        F.max_by("on", "at").alias("left_on"), F.max("at").alias("changed"), F.min("at").alias("first")
    )
    along = Window.partitionBy("entry").orderBy("month")
    ends = (
        ends.crossJoin(F.broadcast(until))  # one row
        .withColumn("next", F.coalesce(F.lead("month").over(along), month(F.col("last")) + 1))
    )
    # months without a change inherit what the last change left
    quiet = (
        ends.filter("left_on = 1 and next > month + 1")
        .withColumn("month", F.explode(F.sequence(F.col("month") + 1, F.col("next") - 1)))
        .select("entry", "month", F.lit(None).cast("timestamp").alias("starts"),
                F.lit(None).cast("timestamp").alias("ends"))
    )
    carried = ends.withColumn("was_on", F.coalesce(F.lag("left_on").over(along), F.lit(0)))
    opening = carried.filter("was_on = 1").select(
        "entry", "month", F.lit(None).cast("timestamp").alias("at"), F.lit(1).alias("on")
    )
    inside = Window.partitionBy("entry", "month").orderBy(F.col("at").asc_nulls_first())
    busy = (
        log.select("entry", "month", "at", "on")
        .unionByName(opening)
        .withColumn("ends", F.lead("at").over(inside))
        .filter("on = 1")
        .select("entry", "month", F.col("at").alias("starts"), "ends")
    )
    return busy.unionByName(quiet)


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` with ``host``, ``blocked`` and ``entry``, one row per row.

    ``captures`` has ``url`` and ``fetched_at``, ``entries`` has ``entry``, ``at`` and ``action``.
    ``entry`` is the most specific entry active then, null if none is. A capture without host or
    time is not blocked. Columns of the same names in ``captures`` are replaced.
    """
    given = captures.drop("host", "blocked", "entry").withColumn("host", host_of(F.col("url").cast("string")))
    asked = given.select("host", F.col("fetched_at").alias("_at")).dropna().distinct()
    until = asked.agg(F.max("_at").alias("last"))
    keys = asked.select(
        "host", "_at", month(F.col("_at")).alias("month"), F.explode(domains_above(F.col("host"))).alias("entry")
    )
    hits = (
        keys.join(intervals(entries, until), ["entry", "month"])
        .filter(
            (F.col("starts").isNull() | (F.col("starts") <= F.col("_at")))
            & (F.col("ends").isNull() | (F.col("_at") < F.col("ends")))
        )
        .groupBy("host", "_at")
        .agg(F.max_by("entry", F.length("entry")).alias("entry"))
        .select(F.col("host").alias("_host"), "_at", "entry")
    )
    found = given.alias("given").join(
        hits.alias("hits"),
        (F.col("given.host") == F.col("hits._host")) & (F.col("given.fetched_at") == F.col("hits._at")),
        "left",
    )
    return found.select("given.*", "hits.entry").withColumn("blocked", F.col("entry").isNotNull())
