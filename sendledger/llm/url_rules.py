"""URL rules by a sorted sweep over reversed-host keys.

A rule (host, path) covers the host, its subdomains and every path below. Its key is the
host's labels in reverse order followed by the path, so the keys that it covers are
one interval, and the intervals of different rules are nested or apart. A url gets one
key for each of its parent domains (as many as the longest rule has labels). Rule
starts, rule ends and url keys are sorted together; after an end the rule around it is
active again, so the stack of nested rules is the chain of parents. The sweep runs in
range partitions: each begins with the rule that is active at the end of the one before,
taken from a table with one row per partition. Built-in functions only.

Defined results: a null url, or one without ``://``, has an empty host and path. Of
the rules that fit, the longest (host and path) wins, of equally long ones that with
the longer host; a rule given as both allow and block blocks. Nulls in a rule's
host or path are empty, a rule without verdict is ignored. Where no rule fits, the rule
is null and the verdict is ``default``. Repeated pages are judged alike. Empty tables give
an empty result or the default; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from sendledger.llm.common import ascii_lower, stored

_NAMES = "host string, path string, verdict string"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url, both empty where there is no ``://``."""
    sound = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    rest = F.substr(url, F.instr(url, "://") + 3)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"(?s)^([^?#]*)", 1)
    return F.when(sound, ascii_lower(host)).otherwise(""), F.when(sound, path).otherwise("")


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\.", -1))


def _key(labels: Column, path: Column) -> Column:
    # a host holds no slash, so no key runs from one host into a longer label
    return F.concat(F.array_join(labels, "."), F.lit("/"), path)


def _breaks(rules: DataFrame) -> DataFrame:
    """(key, active): where the active rule changes, and what it is from there on."""
    empty = F.lit("")
    each = (
        rules.where("verdict IS NOT NULL")
        .select(ascii_lower(F.coalesce("host", empty)).alias("host"), F.coalesce("path", empty).alias("path"), "verdict")
        .groupBy("host", "path")
        .agg(F.max(F.col("verdict") == "block").alias("blocks"))
        .select(
            _key(_labels(F.col("host")), F.col("path")).alias("key"),
            F.struct(
                (F.length("host") + F.length("path")).alias("length"),
                F.length("host").alias("host_length"),
                F.concat("host", "path").alias("rule"),
                F.when(F.col("blocks"), "block").otherwise("allow").alias("verdict"),
            ).alias("active"),
        )
    )
    places = F.sequence(F.lit(0), F.length("key") - 1)
    shorter = each.select("key", F.explode(places).alias("n")).select("key", F.left("key", F.col("n")).alias("prefix"))
    around = shorter.join(each.select(F.col("key").alias("prefix"), "active"), "prefix")
    parents = around.groupBy("key").agg(F.max_by("active", F.length("prefix")).alias("parent"))
    nothing = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in
                         (("length", "int"), ("host_length", "int"), ("rule", "string"), ("verdict", "string"))])
    starts = each.select(F.encode("key", "utf-8").alias("key"), "active")
    # no UTF-8 text has the byte FF, so an end sorts after every key below its rule
    ends = each.join(parents, "key", "left").select(
        F.concat(F.encode("key", "utf-8"), F.unhex(F.lit("FF"))).alias("key"),
        F.coalesce("parent", nothing).alias("active"),
    )
    return starts.unionByName(ends)


def _sweep(breaks: DataFrame, urls: DataFrame) -> DataFrame:
    """``urls`` (key, host, path) with the rule that is active at each key."""
    events = breaks.withColumn("kind", F.lit(0)).unionByName(
        urls.withColumn("kind", F.lit(1)), allowMissingColumns=True
    )
    order = ["key", "kind", "host", "path"]
    dealt = stored(events.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy(*order)
    swept = dealt.withColumn("here", F.last("active", True).over(inside))
    ends = dealt.groupBy("part").agg(F.max_by("active", F.when(F.col("kind") == 0, F.col("key"))).alias("at_end"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    carried = ends.select("part", F.last("at_end", True).over(before).alias("carried"))
    return (
        swept.where("kind = 1")
        .join(carried, "part")
        .select("host", "path", F.coalesce("here", "carried").alias("active"))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict."""
    depth, reach = rules.where("verdict IS NOT NULL").agg(
        F.max(F.size(_labels(F.coalesce("host", F.lit(""))))), F.max(F.length("path"))
    ).first()
    host, path = url_parts(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    if depth is None:
        return parsed.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    # no rule looks beyond its own length
    parsed = parsed.withColumn("start", F.left("path", F.lit(max(reach or 0, 1))))
    labels = _labels(F.col("host"))
    keys = (
        parsed.select("host", F.col("start").alias("path"))
        .distinct()
        .withColumn("n", F.explode(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(depth)))))
        .select("host", "path", F.encode(_key(F.slice(labels, F.lit(1), F.col("n")), F.col("path")), "utf-8").alias("key"))
    )
    best = (
        _sweep(_breaks(rules), keys)
        .where("active.rule IS NOT NULL")
        .groupBy("host", "path")
        .agg(F.max("active").alias("active"))
        .select("host", F.col("path").alias("start"), "active.rule", "active.verdict")
    )
    judged = parsed.join(best, ["host", "start"], "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def rule_table(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules given as (host, path, verdict)."""
    return spark.createDataFrame(rules, _NAMES)
