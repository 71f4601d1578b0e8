"""URL rules by a sort-merge range join over reversed-host keys. DataFrame functions only.

A host key is the host's labels in reverse, each followed by a dot (`blog.example.net` -> `net.example.blog.`), so a
rule's host and its subdomains are exactly the keys that start with the rule's key: one interval of the sorted keys.
Path prefixes are intervals of the sorted paths in the same way. `prefix_stacks` sweeps sorted keys and intervals
together and keeps the stack of nested intervals that are open at each key.

Defined results: a null url, or one without `://`, has an empty host and path; the host is taken as it stands (a port or
user name stays in it). Rules that repeat count once; rules with a null host or path never fit. No rule: `default`.
Of the rules that fit, the one with the most characters of host and path wins, then the longer host, then the
smallest rule text, then `allow`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, UPPER

LAST = "\U0010ffff"


def url_host(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def prefix_stacks(points: DataFrame, starts: DataFrame, rows_per_sweep: int = 100_000) -> DataFrame:
    """For each distinct point (part, key): `stack`, the starts of its part that are prefixes of key, outermost first.

    Points of a part that has no starts don't come back. A part with more than rows_per_sweep points is swept in
    several salted pieces, each with all starts of that part, so that no task sorts a hot part alone.
    """
    points, starts = points.select("part", "key").distinct(), starts.select("part", "key").distinct()
    pieces = points.groupBy("part").agg(F.ceil(F.count("*") / rows_per_sweep).cast("int").alias("pieces"))
    # nesting depth of a start: intervals opened and not yet closed, in key order
    edge = starts.select("part", "key", F.lit(1).alias("step")).union(starts.select("part", F.concat("key", F.lit(LAST)), F.lit(-1)))
    by_key = Window.partitionBy("part").orderBy("key", "step").rowsBetween(Window.unboundedPreceding, 0)
    deep = edge.withColumn("depth", F.sum("step").over(by_key)).filter("step = 1").select("part", "key", "depth")
    most = deep.agg(F.max("depth")).first()[0] or 0  # one number: how deep rules nest
    deep = deep.join(pieces, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), "key", "depth")
    kept = points.join(pieces.join(starts.select("part").distinct(), "part", "left_semi"), "part")
    kept = kept.select("part", F.pmod(F.xxhash64("key"), F.col("pieces")).cast("int").alias("piece"), "key", F.lit(None).cast("bigint").alias("depth"))
    sweep = Window.partitionBy("part", "piece").orderBy("key", F.col("depth").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    slots = [F.last(F.when(F.col("depth") == d, F.col("key")), ignorenulls=True).over(sweep).alias(f"slot{d}") for d in range(1, most + 1)]
    rows = deep.unionByName(kept).select("part", "key", "depth", *slots).filter(F.col("depth").isNull())
    # the newest start of a depth is still open exactly if it is a prefix of the key
    stack = F.array(*[F.col(f"slot{d}") for d in range(1, most + 1)]) if most else F.array().cast("array<string>")
    return rows.select("part", "key", F.filter(stack, lambda s: F.coalesce(F.col("key").startswith(s), F.lit(False))).alias("stack"))


def url_verdicts(urls: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """Adds host, path, rule and verdict to every row of urls; columns of these names are replaced.

    rules: host, path, action. Each distinct host is swept once against the rules' hosts, then each distinct path
    against the paths of the rule hosts that its host lies under; the rows get their verdict by one join on (host, path).
    """
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("action").alias("action")).dropna(subset=["r_host", "r_path"])
    rules = rules.groupBy("r_host", "r_path").agg(F.min("action").alias("action")).withColumn("r_key", host_key(F.col("r_host")))
    rows = urls.drop("host", "path", "rule", "verdict").withColumn("host", url_host(F.col(url))).withColumn("path", url_path(F.col(url)))
    distinct = rows.select("host", "path").distinct()
    top = lambda key: F.substring_index(key, ".", 1)
    hosts = distinct.select("host").distinct().withColumn("h_key", host_key(F.col("host")))
    under = prefix_stacks(hosts.select(top("h_key").alias("part"), F.col("h_key").alias("key")), rules.select(top(F.col("r_key")).alias("part"), F.col("r_key").alias("key")))
    under = hosts.join(under.select(F.col("key").alias("h_key"), F.explode("stack").alias("r_key")), "h_key").select("host", "r_key")
    pairs = distinct.join(under, "host")
    fits = prefix_stacks(pairs.select(F.col("r_key").alias("part"), F.col("path").alias("key")), rules.select(F.col("r_key").alias("part"), F.col("r_path").alias("key")))
    fits = fits.select(F.col("part").alias("r_key"), F.col("key").alias("path"), F.explode("stack").alias("r_path"))
    fits = fits.join(rules, ["r_key", "r_path"])
    ranked = pairs.join(fits, ["r_key", "path"]).select("host", "path", F.struct(
        (-F.length("r_host") - F.length("r_path")).alias("l"), (-F.length("r_host")).alias("h"), F.concat("r_host", "r_path").alias("rule"), F.col("action").alias("verdict")).alias("w"))
    best = ranked.groupBy("host", "path").agg(F.min("w").alias("w")).select("host", "path", F.col("w.rule").alias("rule"), F.col("w.verdict").alias("verdict"))
    return rows.join(best, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
