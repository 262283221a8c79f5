"""URL filter: a sort-merge range join of urls with host and path rules.

A host's canonical key is its labels in reverse, each followed by a dot, so a rule's host
and all its subdomains are one interval of keys. In a sweep over the sorted keys of hosts
and the starts and ends of these intervals, the stack of active rule hosts is carried
along: at a start the host is pushed, at an end its parent is on top again. Behind each
active host the path follows in the key, and there a rule's path prefix is an interval
too: the same sweep over keys of rule host and path finds the longest active rule.
Sweeps are cut into ranges of keys; each range begins with the stack left open before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, once, salted

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null and where there is no `://`."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def host_key(host: Column) -> Column:
    """The labels in reverse, each with a dot behind it: the host's subdomains begin with its key."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_key(host: Column, path: Column) -> Column:
    """Keys of a host and all paths that begin with this one; no host's key holds the separator."""
    return F.concat(host_key(host), F.lit("/"), path)


def clean_rules(rules: DataFrame) -> DataFrame:
    """(host, path, verdict): rules without host or verdict are passed over, a null path is empty;
    of the same rule with several verdicts the last by the alphabet holds (block over allow)."""
    given = rules.filter("host is not null and verdict is not null")
    given = given.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    return given.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))


def _events(nodes: DataFrame) -> DataFrame:
    """From (key, top, parent) the start, where top is pushed, and the end, where parent is on top again."""
    start = F.struct(F.encode("key", "UTF-8").alias("key"), F.lit(1).alias("kind"), F.col("top").alias("top"))
    end = F.struct(F.concat(F.encode("key", "UTF-8"), F.lit(b"\xff")).alias("key"), F.lit(0).alias("kind"), F.col("parent").alias("top"))
    return nodes.select(F.explode(F.array(start, end)).alias("_")).select("_.*")


def host_events(rules: DataFrame) -> DataFrame:
    """Events of the hosts of `rules`; a top is the stack of rule hosts, outermost first."""
    hosts = rules.select("host").distinct()
    labels = F.split("host", r"\.")
    above = hosts.select("host", F.explode(F.sequence(F.lit(1), F.size(labels))).alias("from"))
    above = above.select("host", "from", F.array_join(F.slice(labels, F.col("from"), F.size(labels)), ".").alias("up"))
    chain = above.join(hosts.select(F.col("host").alias("up")), "up", "left_semi").groupBy("host").agg(F.sort_array(F.collect_list(F.struct(F.negate("from").alias("k"), "up"))).alias("_"))
    top = F.transform("_", lambda x: x["up"])
    return _events(chain.select(host_key(F.col("host")).alias("key"), F.struct(top.alias("hosts")).alias("top"), F.struct(F.slice(top, 1, F.size("_") - 1).alias("hosts")).alias("parent")))


def path_events(rules: DataFrame) -> DataFrame:
    """Events of the rules; a top is the rule that holds, from the longest path prefix of its host."""
    rule = F.concat("host", "path")
    top = F.struct(F.length(rule).alias("size"), F.length("host").alias("host_size"), rule.alias("rule"), F.col("verdict").alias("verdict"))
    nodes = rules.select("host", "path", top.alias("top"))
    shorter = nodes.select("host", "path", F.explode(F.sequence(F.lit(0), F.length("path"))).alias("n")).filter("n < length(path)")
    shorter = shorter.select("host", "path", F.expr("substring(path, 1, n)").alias("prefix"))
    outer = nodes.select("host", F.col("path").alias("prefix"), F.col("top").alias("outer"))
    parents = shorter.join(outer, ["host", "prefix"]).groupBy("host", "path").agg(F.max("outer").alias("parent"))
    none = F.struct(F.lit(None).cast("int").alias("size"), F.lit(None).cast("int").alias("host_size"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    nodes = nodes.join(parents, ["host", "path"], "left")
    return _events(nodes.select(rule_key(F.col("host"), F.col("path")).alias("key"), "top", F.coalesce("parent", none).alias("parent")))


def sweep(points: DataFrame, events: DataFrame, ranges: int) -> DataFrame:
    """`points` (key and other columns) with `top`: what is on the stack at their key, null if nothing.

    Points and events are cut into ranges of keys; a range begins with what the last event
    before it left on the stack: one row for each range.
    """
    both = points.withColumn("kind", F.lit(2)).unionByName(events, allowMissingColumns=True)
    dealt = cut_lineage(both.repartitionByRange(ranges, "key").withColumn("range", F.spark_partition_id()))
    left = dealt.groupBy("range").agg(F.max_by("top", F.when(F.col("kind") < 2, F.struct("key", "kind"))).alias("last"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each range
    opened = left.select("range", F.last("last", ignorenulls=True).over(before).alias("opened"))
    running = Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = dealt.withColumn("now", F.last("top", ignorenulls=True).over(running)).filter("kind = 2").join(F.broadcast(opened), "range")
    return swept.select(*[c for c in points.columns], F.coalesce("now", "opened").alias("top"))


def judge(df: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", ranges: int | None = None) -> DataFrame:
    """Adds host, path, rule and verdict: those of the longest rule that fits, else null and `default`.

    A rule fits its host and all subdomains, if the path starts with the rule's. Of rules
    of the same length the one with the longer host holds. Columns of these names are
    replaced; null urls have the host and path "" and are judged like any other; repeated
    rows stay. ranges: of the sweeps (none: as many as shuffle partitions).
    """
    names = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    host, path = host_and_path(F.col(url))
    split = df.select(F.struct(*[f"`{c}`" for c in names]).alias("_in"), once(host).alias("host"), once(path).alias("path"))
    rules = cut_lineage(clean_rules(rules))
    urls = cut_lineage(split.groupBy("host", "path").agg(F.count(F.lit(1)).alias("rows")))
    hosts = urls.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    active = sweep(hosts.select(F.encode(host_key(F.col("host")), "UTF-8").alias("key"), "host", "n"), host_events(rules), ranges)
    active = cut_lineage(active.filter(F.size("top.hosts") > 0).select("host", "n", F.col("top.hosts").alias("above")))
    spread = F.xxhash64("host", "path")
    pairs = salted(urls.select("host", "path"), active, ["host"], spread).select("host", "path", F.explode("above").alias("above"))
    pairs = cut_lineage(pairs)
    places = pairs.groupBy("above", "path").agg(F.count(F.lit(1)).alias("n"))
    found = sweep(places.select(F.encode(rule_key(F.col("above"), F.col("path")), "UTF-8").alias("key"), "above", "path", "n"), path_events(rules), ranges)
    found = cut_lineage(found.filter("top.rule is not null").select("above", "path", "n", "top"))
    best = salted(pairs, found, ["above", "path"], spread).groupBy("host", "path").agg(F.max("top").alias("top"))
    best = cut_lineage(best.join(urls, ["host", "path"]).select("host", "path", "top", F.col("rows").alias("n")))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20)).cast("int")  # which task a row goes to makes no difference
    out = salted(split, best, ["host", "path"], salt, "left")
    return out.select("_in.*", "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict"))
