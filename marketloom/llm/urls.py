"""URL rules: prefixes of reversed-host keys become intervals, and one sorted sweep finds the innermost open one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import ascii_lower, materialise

#: Ends a host in a key, so that the key of a host is never the beginning of another host's.
_HOST_END = "\x01"
#: Above every character that a key holds.
_TOP = "\U0010ffff"


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or a URL without ://."""
    rest = F.substring_index(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), "/", 1)
    return F.coalesce(ascii_lower(F.regexp_extract(rest, r"(?s)^[^?#]*", 0)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ? or # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def apply_url_rules(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge every URL by the longest fitting rule.

    rules: host, path, verdict. A rule fits its host and all subdomains when the URL's path starts with the rule's.
    A rule (host, path) is the interval of keys that begin with reversed host + end mark + path. A page asks with one key
    for each suffix of its host (labels are few), so the innermost interval around a key is the longest rule of that host.
    The sweep sorts starts, ends and keys together: ends hand back the enclosing rule, so the last event before a key is
    the top of the stack. Ranges are swept side by side; each range inherits the last event of those before it.

    Returns id_col, host, path, rule (host + path, or null), verdict. Null or malformed URLs have an empty host and path and
    get the default. Repeated rules keep the smallest verdict; rules with a null host or path are ignored; other columns of
    either table are not looked at. Empty rules give the default everywhere.
    """
    spark = pages.sparkSession
    asked = pages.select(F.col(id_col).alias("_id"), url_host(F.col(url_col)).alias("_host"), url_path(F.col(url_col)).alias("_path"))
    # Equal URLs ask once.
    places = asked.groupBy("_host", "_path").agg(F.lit(1).alias("_one")).drop("_one")
    labels = F.split(F.col("_host"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(F.reverse(labels), F.lit(1), i), "."))
    keys = places.filter(F.col("_host") != "").select("_host", "_path", F.explode(suffixes).alias("_suffix")).select(
        "_host", "_path", F.concat("_suffix", F.lit(_HOST_END), "_path").alias("_key"))

    clean = (rules.select(ascii_lower(F.col("host")).alias("h"), F.col("path").alias("p"), F.col("verdict").alias("v"))
             .filter(F.col("h").isNotNull() & F.col("p").isNotNull() & (F.col("h") != ""))
             .groupBy("h", "p").agg(F.min("v").alias("v"))
             .withColumn("_key", F.concat(host_key(F.col("h")), F.lit(_HOST_END), F.col("p"))))
    own = clean.select("_key", F.struct(F.length(F.concat("h", "p")).alias("n"), F.length("h").alias("nh"), F.concat("h", "p").alias("rule"), F.col("v").alias("verdict")).alias("_top"))
    # The rule around each rule: the longest proper beginning of its key that is itself a rule's key.
    starts = clean.select("_key", "h", "p", F.explode(F.sequence(F.lit(0), F.greatest(F.length("p") - 1, F.lit(0)))).alias("_cut")).filter(F.col("_cut") < F.length("p"))
    outer_keys = starts.select("_key", F.concat(host_key(F.col("h")), F.lit(_HOST_END), F.substring(F.col("p"), F.lit(1), F.col("_cut"))).alias("_outer"))
    outer = (outer_keys.join(own.withColumnRenamed("_key", "_outer"), "_outer").groupBy("_key")
             .agg(F.max_by("_top", F.length("_outer")).alias("_around")))
    # Kinds sort within a key: ends of inner before outer by key length, then starts, then the asking keys.
    ends = own.select("_key").join(outer, "_key", "left").select(F.concat("_key", F.lit(_TOP)).alias("_at"), F.lit(0).alias("_kind"), (-F.length("_key")).alias("_tie"), F.struct("_around").alias("_event"))
    begins = own.select(F.col("_key").alias("_at"), F.lit(1).alias("_kind"), F.lit(0).alias("_tie"), F.struct(F.col("_top").alias("_around")).alias("_event"))
    events = ends.unionByName(begins)
    stream = events.select("_at", "_kind", "_tie", "_event", F.lit(None).cast("string").alias("_host"), F.lit(None).cast("string").alias("_path")).unionByName(
        keys.select(F.col("_key").alias("_at"), F.lit(2).alias("_kind"), F.lit(0).alias("_tie"), F.lit(None).cast(events.schema["_event"].dataType).alias("_event"), "_host", "_path"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(stream.repartitionByRange(n, "_at", "_kind", "_tie", "_host").withColumn("_range", F.spark_partition_id()), "url_sweep")

    order = ("_at", "_kind", "_tie")
    # One row for each range: the top of the stack that it leaves to the next one.
    left_open = ranged.filter(F.col("_kind") < 2).groupBy("_range").agg(F.max_by("_event", F.struct(*order)).alias("_last"))
    every = ranged.groupBy("_range").agg(F.lit(1).alias("_one")).drop("_one").join(left_open, "_range", "left")
    carried = every.select("_range", F.last("_last", True).over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    swept = ranged.withColumn("_seen", F.last("_event", True).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    found = (swept.filter(F.col("_kind") == 2).join(F.broadcast(carried), "_range")
             .select("_host", "_path", F.coalesce("_seen", "_carried")["_around"].alias("_top")).filter(F.col("_top").isNotNull()))
    best = found.groupBy("_host", "_path").agg(F.max("_top").alias("_top"))
    return asked.join(best, ["_host", "_path"], "left").select(
        F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_top.rule").alias("rule"), F.coalesce("_top.verdict", F.lit(default)).alias("verdict"))
