"""Operator 2: URL filters as a temporal list join, in DataFrame operations only.

A list is a history of dated events (key, action, at); a key is a domain (it and its subdomains) or a URL
prefix (domain, then path up to a segment's end). An event holds until the key's next one, which gives validity
intervals. A capture stands for its candidate keys (its host's suffixes, and its host with each path prefix); an
equi-join on the key with the fetch time inside the interval finds the entries active at that time, and the
longest key decides; at the same length an ``allow`` wins.

A hot host's captures are one key of the large side only, whose rows Spark's skew join splits; an entry's
history is never gathered with them.

Defined results: a capture without a host or a fetch time meets no entry and passes; events with a null key or
date are ignored; of events of one key at one time the last by action's name counts (remove, block, allow); rows
are judged one by one; other columns pass unchanged (those named as the results are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANK = "array_position(array('remove', 'block', 'allow'), action)"


def intervals(events: DataFrame) -> DataFrame:
    """(key, action, valid_from, valid_to): valid_to is null for the entries still active."""
    known = events.filter("key is not null and at is not null and action is not null")
    last = known.groupBy("key", "at").agg(F.max_by("action", F.expr(RANK)).alias("action"))
    history = Window.partitionBy("key").orderBy("at")
    return last.select("key", "action", F.col("at").alias("valid_from"), F.lead("at").over(history).alias("valid_to")).filter("action != 'remove'")


def host_of(url: Column) -> Column:
    """The host in lower case, without user and port; null if the URL has none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def candidate_keys(url: Column, segments: Column) -> Column:
    """Keys that could match: host suffixes of two labels or more (or the host), and host + path prefixes.

    segments: path segments of the list's longest prefix; no key has more.
    """
    host = host_of(url)
    labels = F.split(host, r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^?#]*)", 1)
    parts = F.slice(F.filter(F.split(path, "/"), lambda p: p != ""), 1, segments)
    prefix = F.transform(parts, lambda _, k: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, k + 1), "/")))
    return F.when(host.isNotNull(), F.array_distinct(F.concat(suffix, prefix)))


def judge_captures(captures: DataFrame, events: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """The captures with ``n_active`` entries, the deciding ``entry`` and ``blocked``."""
    captures = captures.drop("n_active", "entry", "blocked", "top")
    entry = intervals(events)
    asked = captures.select(F.col(url_col).alias("asked_url"), F.col(time_col).alias("asked_at")).distinct()
    longest = events.agg(F.coalesce(F.max(F.length("key") - F.length(F.replace("key", F.lit("/"), F.lit("")))), F.lit(0)).alias("segments"))
    keys = asked.crossJoin(F.broadcast(longest)).select("asked_url", "asked_at", "segments").withColumn("key", F.explode(candidate_keys(F.col("asked_url"), F.col("segments")))).drop("segments")
    active = keys.join(entry, "key").filter("asked_at >= valid_from and (valid_to is null or asked_at < valid_to)")
    order = F.struct(F.length("key"), F.expr(RANK), F.col("key"))
    verdict = active.groupBy("asked_url", "asked_at").agg(F.count(F.lit(1)).alias("n_active"), F.max_by("key", order).alias("entry"), F.max_by("action", order).alias("top"))
    match = (F.col(url_col) == F.col("asked_url")) & (F.col(time_col) == F.col("asked_at"))
    judged = captures.join(verdict, match, "left").drop("asked_url", "asked_at")
    return judged.withColumn("n_active", F.coalesce("n_active", F.lit(0))).withColumn("blocked", F.coalesce(F.col("top") == "block", F.lit(False))).drop("top")


def sample_history(pages: DataFrame) -> DataFrame:
    """A dated list made from the hosts of a table, by their digests: the tables come without one."""
    host = pages.select(host_of(F.col("url")).alias("key")).filter("key is not null").distinct()
    digit = lambda k: F.conv(F.substring(F.md5("key"), k, 1), 16, 10).cast("int")
    host = host.select("key", digit(1).alias("a"), digit(2).alias("b"), digit(3).alias("c"))
    day = lambda n: F.expr(f"timestamp'2024-01-01' + make_dt_interval({n})")
    parts = [
        host.filter("a < 7").select("key", F.lit("block").alias("action"), day("b").alias("at")),
        host.filter("a < 5").select("key", F.lit("remove").alias("action"), day("b + 1 + c").alias("at")),
        host.filter("a = 7").select("key", F.lit("block").alias("action"), day("0").alias("at")),
        host.filter("a = 7").select("key", F.lit("allow").alias("action"), day("b").alias("at")),
        host.filter("a in (8, 9)").select(F.concat("key", F.lit("/en")).alias("key"), F.lit("block").alias("action"), day("b").alias("at")),
        host.filter("c < 2").select(F.expr("substring_index(key, '.', -3)").alias("key"), F.lit("block").alias("action"), day("20").alias("at")),
    ]
    events = parts[0]
    for more in parts[1:]:
        events = events.unionAll(more)
    return events


def with_fetch_time(pages: DataFrame) -> DataFrame:
    """Fetch times for a table without them, by its page numbers."""
    return pages.withColumn("fetched_at", F.expr("timestamp'2024-01-01' + make_dt_interval(0, cast(page_id % 720 as int))"))
