"""Allow and block rules over urls by a sort-merge range join.

A rule names a host and the beginning of a path; it fits that host and all its
subdomains.  The key of a rule is its host's labels from last to first, ``#``
(which neither hosts nor paths can hold) and its path.  A url has one key for
each number of trailing labels that any rule has, so a rule fits where its key
begins the url's key: an interval of the keys in byte order.  Intervals of
prefixes are nested or disjoint.

Rule starts, url keys and rule ends are ranged by key and swept in order.  The
running number of open rules is the height of the stack, and the rule last
opened at that height is its top.  A range starts with the rules open there,
which are those whose keys begin its first key; they are found by equality.
Keys that many urls share are spread over ranges by a hash of the url.
Everything is DataFrame functions; only urls and keys are read and moved.

Defined results: the host is what follows the first ``://`` up to ``/``,
``?``, ``#`` or the end, A-Z lower-cased; the path goes on from there up to
``?``, ``#`` or the end; both are empty for a null url or one without
``://``.  The rule of the most characters wins, then that of the longer host.
Where rules of one host and path disagree, block wins.  Rules with a null host
or path fit nothing.  A url without rule gets ``default``.  Repeated rows are
judged each, empty tables give no rows, and of the input only the columns in
``keep`` are returned (those named as an output give way to it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelweave.llm.folders import Folder

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OPEN, _URL, _CLOSE = 0, 1, 2
OUTPUTS = ["host", "path", "rule", "verdict"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(labels: Column, path: Column) -> Column:
    return F.encode(F.concat(F.array_join(labels, "."), F.lit("#"), path), "UTF-8")


def rule_keys(rules: DataFrame) -> DataFrame:
    """key, labels, rule, verdict and sizes of the distinct rules; ``rules``: host, path, verdict."""
    host = F.translate("host", _UPPER, _LOWER)
    one = rules.filter("host IS NOT NULL AND path IS NOT NULL").groupBy(host.alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    back = F.reverse(F.split("host", r"\."))
    return one.select(_key(back, F.col("path")).alias("key"), F.size(back).alias("labels"), F.concat("host", "path").alias("rule"), "verdict",
                      (F.length("host") + F.length("path")).alias("chars"), F.length("host").alias("host_chars"))


def _events(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Starts and ends of rules, and a key of each url for each number of labels that rules have."""
    depths = [r[0] for r in rules.select("labels").distinct().collect()]  # small numbers, at most one for each length of a host in labels
    back = F.reverse(F.split("host", r"\."))
    keyed = urls.select("host", "path", back.alias("_back")).select(
        "host", "path", F.explode(F.filter(F.array(*[F.lit(d) for d in depths]).cast("array<int>"), lambda d: d <= F.size("_back"))).alias("_d"), "_back")
    at_url = keyed.select(_key(F.slice("_back", F.lit(1), F.col("_d")), F.col("path")).alias("key"), F.lit(_URL).alias("kind"), "host", "path")
    none = F.lit(None).cast("string")
    opens = rules.select("key", F.lit(_OPEN).alias("kind"), none.alias("host"), none.alias("path"), F.struct("chars", "host_chars", "rule", "verdict").alias("top"))
    closes = opens.select(F.concat("key", F.unhex(F.lit("FF"))).alias("key"), F.lit(_CLOSE).alias("kind"), "host", "path", F.lit(None).cast(opens.schema["top"].dataType).alias("top"))
    return at_url.withColumn("top", F.lit(None).cast(opens.schema["top"].dataType)).union(opens).union(closes)


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", keep: list[str] | None = None, default: str = "allow") -> DataFrame:
    """``keep`` of every row, with host, path, rule and verdict."""
    spark = pages.sparkSession
    folder = Folder(spark, "urlfilter")
    host, path = host_and_path(F.col(url))
    kept = [c for c in (keep if keep is not None else pages.columns) if c.lower() not in OUTPUTS]
    base = pages.select(*kept, host.alias("host"), path.alias("path"))
    keyed = folder.write(rule_keys(rules), "rules")
    events = _events(base.select("host", "path").distinct(), keyed)
    ranged = events.repartitionByRange("key", "kind", F.xxhash64("host", "path")).withColumn("part", F.spark_partition_id())
    ranged = folder.write(ranged, "ranges")  # the ranges stand still from here on
    # the rules open where a range begins
    first = ranged.groupBy("part").agg(F.min(F.struct("key", "kind")).alias("first"))
    lengths = [r[0] for r in keyed.select(F.octet_length("key")).distinct().collect()]  # no more than the longest rule has bytes
    cut = F.transform(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.octet_length("first.key")), lambda n: F.substr(F.col("first.key"), F.lit(1), n))
    heads = first.select("part", "first", F.explode(cut).alias("key"))
    heads = heads.filter(f"key <> first.key OR first.kind > {_OPEN}").drop("first")
    carried = heads.join(ranged.filter(f"kind = {_OPEN}").drop("part"), "key").select("key", "kind", "host", "path", "top", "part")
    swept = ranged.unionByName(carried)
    order = W.partitionBy("part").orderBy("key", "kind")
    step = F.when(F.col("kind") == _OPEN, 1).when(F.col("kind") == _CLOSE, -1).otherwise(0)
    swept = swept.withColumn("height", F.sum(step).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    at_height = W.partitionBy("part", "height").orderBy("key", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    # an end leaves the height of the rule around it, whose start is still the last one there
    found = swept.withColumn("top", F.last("top", ignorenulls=True).over(at_height)).filter(f"kind = {_URL} AND height > 0")
    best = folder.write(found.groupBy("host", "path").agg(F.max("top").alias("top")), "best")
    out = base.join(best, ["host", "path"], "left")
    return out.select(*kept, "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict"))
