"""URL filters by a temporal join of captures with dated list entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: days of a join bucket
BUCKET = 32
PARTS = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL without user, port or final dot; else empty."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1)), r"\.+$", "")


def keys_of(url: Column) -> Column:
    """Keys that list entries can name: the host, its parent domains, and each leading part of its path.

    ``d:a.b.c``, ``d:b.c``, ``d:c``, ``p:a.b.c/x``, ``p:a.b.c/x/y`` ...
    """
    host = host_of(url)
    labels = F.split(host, r"\.")
    steps = F.filter(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2), "/"), lambda x: x != "")
    domains = F.transform(labels, lambda _, i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")))
    paths = F.transform(steps, lambda _, i: F.concat(F.lit("p:"), host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i + 1), "/")))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, paths)))


def intervals(entries: DataFrame) -> DataFrame:
    """``(list, key, since, until)``: when each key is on each list; ``until`` (exclusive) may be null.

    ``entries(list, key, day, action)`` with actions ``add`` and ``remove``.
    An entry holds until the key's next dated entry on that list. Several
    entries of one day count once, removal first; so a key has at most one
    row per list and day, whatever its share of the entries.
    """
    days = entries.where("list is not null and key is not null and day is not null and action in ('add', 'remove')").groupBy("list", "key", "day").agg(F.max("action").alias("action"))
    span = Window.partitionBy("list", "key").orderBy("day")
    return days.withColumn("until", F.lead("day").over(span)).where("action = 'add'").select("list", "key", F.col("day").alias("since"), "until")


def evaluate(captures: DataFrame, entries: DataFrame, blocking: str = "block", allowing: str = "allow") -> DataFrame:
    """``captures(page_id, url, day)`` with ``host``, ``n_matches``, ``lists`` and ``blocked``.

    As-of join: a capture meets, for each of its keys and each list, the
    newest entry of its day or before, if that is an addition. ``n_matches``
    counts such (list, key) pairs, ``lists`` names the lists, and ``blocked``
    is true when ``blocking`` is among them and ``allowing`` is not.

    Captures are joined as distinct (url, day), on key and a bucket of
    `BUCKET` days, so a busy key meets only the few intervals of its time,
    and a skewed key's rows can be split. A null or relative URL, or a null
    day, matches nothing; repeated rows all stay; entries with a null field or
    another action are ignored; extra columns are ignored; empty tables give
    no rows or no matches.
    """
    captures = captures.select(captures["page_id"], captures["url"].cast("string").alias("url"), captures["day"].cast("date").alias("day"))
    seen = captures.where("url is not null and day is not null").select("url", "day").distinct()
    number = lambda c: (F.datediff(c, F.lit("1970-01-01")) / BUCKET).cast("int")
    last = captures.agg(F.max("day")).first()[0]  # open intervals end here
    first = captures.agg(F.min("day")).first()[0]
    held = intervals(entries).where((F.col("since") <= F.lit(last)) & (F.coalesce("until", F.lit("9999-12-31").cast("date")) > F.lit(first)))
    held = held.select("list", "key", "since", "until", F.explode(F.sequence(number(F.greatest("since", F.lit(first))), number(F.least(F.coalesce("until", F.lit(last)), F.lit(last))))).alias("bucket"))
    keyed = seen.select("url", "day", number(F.col("day")).alias("bucket"), F.explode(keys_of(F.col("url"))).alias("key"))
    met = keyed.join(held, ["key", "bucket"]).where((F.col("since") <= F.col("day")) & (F.col("until").isNull() | (F.col("day") < F.col("until"))))
    found = met.groupBy("url", "day").agg(F.count("*").alias("n_matches"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), F.max(F.col("list") == blocking).alias("on"), F.max(F.col("list") == allowing).alias("off"))
    out = captures.join(found, ["url", "day"], "left")
    return out.select("page_id", "url", "day", host_of(F.col("url")).alias("host"), F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"), F.coalesce("lists", F.lit("")).alias("lists"), F.coalesce(F.col("on") & ~F.col("off"), F.lit(False)).alias("blocked"))
