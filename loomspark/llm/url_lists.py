"""URL filters by dated lists: a temporal list join, in DataFrame operations only.

A list entry says from when on a key (a host, a domain above it, or a host with its first path segment) is blocked or
allowed. Entries become validity intervals, closed by the next entry of the same key; an as-of join evaluates each
capture against the intervals that hold when it was fetched, and the most specific key decides.

A capture's keys and its identity are shuffled, nothing else of the page; captures and intervals of a key are sorted by time, and
each capture takes the interval before it. A key may hold any share of the captures: one with more than HEAVY, and
more than one in SHARES of all, is dealt to several groups, with its intervals repeated there; other keys are not salted. The
salts are broadcast: fewer than SHARES keys have any.

Defined results: two entries of a key at one time count as blocked if one of them blocks; entries without a key or a
time are void, as are captures' keys where the URL has no host; a capture without a time meets no interval; both are
'none', not blocked. Captures that repeat id, URL and time are one. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Captures that a key has in one group, about: so many, or one in SHARES of all.
HEAVY, SHARES = 512, 20_000
#: Scheme, user, host; port and the rest follow. Then the first path segment.
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
SEGMENT = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)"


def host(url: Column) -> Column:
    """Lower-cased host without a final dot; null without one."""
    return F.nullif(F.regexp_replace(F.regexp_extract(F.lower(url), HOST, 1), r"\.$", ""), F.lit(""))


def keys(url: Column) -> Column:
    """What an entry may name of a URL, as structs (key, rank); a higher rank is more specific. Null without a host."""
    labels = F.split(host(url), r"\.")
    n = F.size(labels)
    domains = F.transform(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda i: F.struct(F.array_join(F.slice(labels, i, n), ".").alias("key"), (n - i + 1).alias("rank")),
    )
    segment = F.regexp_extract(url, SEGMENT, 1)
    path = F.struct(F.concat(host(url), F.lit("/"), segment).alias("key"), (n + 1).alias("rank"))
    return F.when(segment != "", F.concat(domains, F.array(path))).otherwise(domains)


def intervals(entries: DataFrame) -> DataFrame:
    """key, since, until (null: still open), blocked of entries(key, since, action)."""
    known = entries.where("key is not null and since is not null").groupBy("key", "since").agg(F.max(F.coalesce(F.col("action") == "block", F.lit(False))).alias("blocked"))
    return known.withColumn("until", F.lead("since").over(Window.partitionBy("key").orderBy("since")))


def verdicts(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, url, fetched_at, matched_key, since, verdict (block, allow, none) of captures(page_id, url, fetched_at)."""
    identity = ["page_id", "url", "fetched_at"]
    asked = captures.select(*identity, F.explode_outer(keys(F.col("url"))).alias("k")).select(*identity, F.col("k.key").alias("key"), F.col("k.rank").alias("rank"))
    keyed = asked.where("key is not null")
    total = keyed.count()
    salts = keyed.groupBy("key").agg(F.ceil(F.count("*") / max(HEAVY, total // SHARES)).alias("salts")).where("salts > 1")
    salts = F.broadcast(salts)  # keys of more than one in SHARES rows: fewer than SHARES
    void = F.lit(None)
    a = keyed.join(salts, "key", "left").select("key", F.coalesce(F.pmod(F.xxhash64(*identity), F.col("salts")), F.lit(0)).alias("salt"), F.col("fetched_at").alias("at"), F.lit(1).alias("kind"), F.struct(*identity, "rank").alias("capture"), void.cast("string").alias("since"), void.cast("boolean").alias("blocked"))
    held = intervals(entries)
    e = held.join(salts, "key", "left").select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"), F.col("since").alias("at"), F.lit(0).alias("kind"), void.cast(a.schema["capture"].dataType).alias("capture"), "since", "until", "blocked")
    a = a.withColumns({"since": void.cast(held.schema["since"].dataType), "until": void.cast(held.schema["until"].dataType)}).select(*e.columns)
    # The as-of join: captures and intervals in the order of time, each capture with the last interval that began before it.
    order = Window.partitionBy("key", "salt").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("kind") == 0, F.struct("since", "until", "blocked")), ignorenulls=True).over(order)
    met = a.unionAll(e).select("key", "at", "kind", "capture", last.alias("e")).where("kind = 1")
    active = F.col("e").isNotNull() & (F.col("e.until").isNull() | (F.col("at") < F.col("e.until")))
    found = F.when(active, F.struct(F.col("capture.rank").alias("rank"), F.col("key"), F.col("e.since").alias("since"), F.col("e.blocked").alias("blocked"))).alias("f")
    met = met.select(*(F.col(f"capture.{x}").alias(x) for x in identity), found)
    lost = asked.where("key is null").select(*identity, void.cast(met.schema["f"].dataType).alias("f"))
    best = met.unionAll(lost).groupBy(*identity).agg(F.max("f").alias("m"))
    verdict = F.when(F.col("m").isNull(), "none").when(F.col("m.blocked"), "block").otherwise("allow")
    return best.select(*identity, F.col("m.key").alias("matched_key"), F.col("m.since").alias("since"), verdict.alias("verdict"))


def number(key: Column, mod: int) -> Column:
    """A number below mod from a string's md5; the same in SQL."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 6), 16, 10).cast("long"), F.lit(mod)).cast("int")


def dated(pages: DataFrame) -> DataFrame:
    """Captures of pages(page_id, url), which carry no time: one in 2024 or 2025 from the id."""
    day = number(F.concat(F.lit("fetch"), F.col("page_id").cast("string")), 731)
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), day).alias("fetched_at"))


def revisions(pages: DataFrame) -> DataFrame:
    """A list for pages, which come with none: four dated entries for each key of their URLs that its hash puts on the list (two in three)."""
    own = pages.select(F.explode(keys(F.col("url"))).alias("k")).select(F.col("k.key").alias("key")).distinct().where(number(F.col("key"), 3) > 0)
    tag = F.concat(F.col("key"), F.lit("#"), F.col("i").cast("string"))
    rows = own.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3))))
    action = F.when(number(tag, 2) == 0, "block").otherwise("allow")
    return rows.select("key", F.date_add(F.lit("2024-01-01").cast("date"), number(tag, 701)).alias("since"), action.alias("action"))
