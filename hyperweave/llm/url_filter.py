"""URL filters by a sort-merge range join over reversed-host keys, in DataFrame operations only.

A rule is a host and a path; it fits its host and all subdomains if the url's path starts with the rule's. Under the
key "reversed host" + "/" + path (``example.org`` + ``/es/`` -> ``org.example//es/``) the urls that a rule fits form an
interval: those keys that start with the rule's. A url has a key for each suffix of its host that a rule could name.
No host has a slash, so ``org/`` does not begin the key of ``organic``.

Rules and url keys are swept in sorted order. As intervals of prefixes are nested or apart, the rules that are active
at a place are a stack: every rule carries the stack at its opening (itself and the rules that hold it), a url takes
the stack of the last opening before it and pops what no longer holds it; the longest that is left is its match.

Scale: the sweep runs in buckets, ranges of keys bounded by a sample of keys of fixed size, so no task sees more than
its range; a bound opens with the stack of the rules that hold it. A key that fills several ranges (one hot page or
host path) is dealt over them by a hash of the row. Keys are cut to the longest rule's length, which changes no match;
a url's host and path travel with its first key only, the others carry two hashes of them. The number of ranges follows
the number of partitions; a key finds its range by bisection of the bounds, one array literal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hyperweave.llm.common import hash_share, shuffle_partitions, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
DEFAULT_VERDICT = "allow"
SAMPLE_PER_BUCKET = 32


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty for null or without ``://``."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, text.substr(at + 3, F.length(text))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def _suffix_keys(host: Column, path: Column, depth: int, length: int) -> Column:
    """Keys of the host's last 1, 2, ... labels, with the path, cut to ``length``; none for an empty host."""
    labels = F.reverse(F.split(host, r"\."))
    n = F.least(F.size(labels), F.lit(depth))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), n), lambda k: F.substring(F.concat(F.array_join(F.slice(labels, F.lit(1), k), "."), F.lit("/"), path), 1, length))
    )


def _bucket(key: Column, row: Column, bounds: list[str]) -> Column:
    """How many bounds ``key`` has reached, by bisection; equal bounds share their key's rows by a hash."""
    if not bounds:
        return F.lit(0)
    listed, size = F.array(*map(F.lit, bounds)), len(bounds)
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(size.bit_length()))])
    reached = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= size) & (F.get(listed, at + step - 1) <= key), at + step).otherwise(at))
    if len(set(bounds)) == size:
        return reached
    times = F.array(F.lit(0), *[F.lit(bounds.count(v)) for v in bounds])
    # in an array of one, so that the place is found once
    return F.transform(F.array(reached), lambda at: F.when((F.get(times, at) > 1) & (F.get(listed, at - 1) == key), at - F.pmod(F.xxhash64(row), F.get(times, at)).cast("int")).otherwise(at))[0]


def _stacks(keys: DataFrame, rules: DataFrame, lengths: list[int]) -> DataFrame:
    """``keys(key)`` with the stack of rules that hold them, shortest first: an equi-join on the prefixes of rule lengths."""
    prefixes = keys.select("key", F.explode(F.filter(F.array(*[F.when(F.length("key") >= n, F.substring("key", 1, n)) for n in lengths]), lambda p: p.isNotNull())).alias("rule_key"))
    held = prefixes.join(rules, "rule_key").groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.length("rule_key").alias("n"), "rule_key", "rule", "verdict"))).alias("stack"))
    return keys.join(held, "key", "left").withColumn("stack", F.coalesce("stack", F.array().cast(held.schema["stack"].dataType)))


def filter_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT_VERDICT, buckets: int | None = None) -> DataFrame:
    """(id, host, path, rule, verdict) for each row of ``pages``; ``rules`` has (host, path, verdict) strings.

    The longest rule (host and path together) that fits a url wins; of equal ones the last in the order
    of keys. A url that no rule fits, null ones and those without ``://`` included, gets a null rule and ``default``.
    A null id stays null; repeated rows stay repeated; other columns are not read. Rules with null parts or an empty
    host are dropped, repeated ones count once (of contradicting ones ``block`` holds). No rules: all get ``default``.
    Very long urls are keyed by their first bytes. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.col("path").alias("path"), F.col("verdict")).where("host <> '' AND path IS NOT NULL AND verdict IS NOT NULL")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rules = rules.select(F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "."), F.lit("/"), "path").alias("rule_key"), F.concat("host", "path").alias("rule"), "verdict", F.size(F.split("host", r"\.")).alias("labels"))
    lengths, depth = rules.agg(F.sort_array(F.collect_set(F.length("rule_key"))), F.max("labels")).first()
    depth = depth or 1
    host, path = split_url(F.col(f"`{url_col}`"))
    split = pages.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path"))
    split = split.select("*", F.xxhash64("host", "path").alias("h1"), F.xxhash64(F.lit(1), F.col("path"), F.col("host")).alias("h2"))
    match_type = "struct<n:int,rule_key:string,rule:string,verdict:string>"
    if not lengths:
        found = split.select("*", F.lit(None).cast(match_type).alias("match"))
    else:
        # the key's length is no rule's: cut behind the longest rule
        keys = _suffix_keys(F.col("host"), F.col("path"), depth, max(lengths) + 1)
        probes = split.select("id", "h1", "h2", "host", "path", F.posexplode_outer(keys).alias("probe", "key"))
        once = lambda c: F.when(F.coalesce("probe", F.lit(0)) == 0, F.col(c)).alias(c)
        probes = probes.select("id", "h1", "h2", once("host"), once("path"), "probe", "key")
        wanted = buckets or 2 * shuffle_partitions(spark)
        some = probes.where(F.col("key").isNotNull() & hash_share(F.xxhash64("id", "h1", "h2"), pages.count(), 2 * SAMPLE_PER_BUCKET * wanted + 100))
        sample = some.select("key", F.xxhash64("id", "h1", "h2").alias("h")).orderBy("h", "key").limit(SAMPLE_PER_BUCKET * wanted)
        drawn = sorted(r[0] for r in sample.select("key").collect())  # bounded by the limit
        bounds = [drawn[i * len(drawn) // wanted] for i in range(1, wanted)] if drawn else []
        ranged = ["id", "h1", "h2", "host", "path", "probe"]
        nulls = [F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in ranged]
        openings = _stacks(rules.select(F.col("rule_key").alias("key")).distinct(), rules, lengths)
        openings = openings.select(*nulls, "key", _bucket(F.col("key"), F.col("key"), bounds).alias("bucket"), "stack")
        starts = _stacks(spark.range(1).select(F.explode(F.array(*map(F.lit, dict.fromkeys(["", *bounds])))).alias("key")), rules, lengths)
        places = spark.range(1).select(F.posexplode(F.array(*map(F.lit, ["", *bounds]))).alias("bucket", "key"))
        starts = places.join(starts, "key", "left").select(*nulls, "key", "bucket", F.coalesce("stack", F.array().cast(starts.schema["stack"].dataType)).alias("stack"))
        # A rule at a bound opens in the last of the ranges of that key; the bound's own stack has it as well.
        urls = probes.select(*ranged, "key", F.when(F.col("key").isNull(), F.pmod(F.xxhash64("id", "h1"), F.lit(len(bounds) + 1)).cast("int")).otherwise(_bucket(F.col("key"), F.struct("id", "h1", "h2"), bounds)).alias("bucket"), F.lit(None).cast(openings.schema["stack"].dataType).alias("stack"))
        events = openings.unionByName(starts).unionByName(urls)
        sweep = Window.partitionBy("bucket").orderBy("key", F.col("probe").isNotNull(), F.size(F.coalesce("stack", F.array().cast(openings.schema["stack"].dataType)))).rowsBetween(Window.unboundedPreceding, 0)
        swept = events.withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where("probe IS NOT NULL OR host = ''")
        match = F.try_element_at(F.filter("stack", lambda r: F.col("key").startswith(r["rule_key"])), F.lit(-1))
        swept = swept.select("id", "h1", "h2", "host", "path", F.coalesce("probe", F.lit(0)).alias("probe"), match.alias("match"))
        # the longest of a url's keys; rows that are repeated are counted at their first key and come back
        best = F.max(F.when(F.col("match").isNotNull(), F.struct(F.col("match.n"), F.col("match.rule_key"), F.col("match.rule"), F.col("match.verdict"))))
        found = swept.groupBy("id", "h1", "h2").agg(F.max("host").alias("host"), F.max("path").alias("path"), best.alias("match"), F.sum(F.when(F.col("probe") == 0, 1).otherwise(0)).cast("int").alias("times"))
        found = found.select("id", "host", "path", "match", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("col")
    return found.select(F.col("id").alias(id_col), "host", "path", F.col("match.rule").alias("rule"), F.coalesce("match.verdict", F.lit(default)).alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every page's url under the production rules."""
    return filter_urls(table(spark, sf_dir, "pages"), spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, RULES))} AS rules(host, path, verdict)"))


OP4_SQL = f"""
WITH rules(rhost, rpath, rverdict) AS (VALUES {", ".join(str(r) for r in RULES)}),
rest AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS row FROM rest),
fits AS (SELECT row, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(rverdict, length(rhost || rpath)) AS verdict
         FROM split JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY row)
SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT_VERDICT}') AS verdict FROM split LEFT JOIN fits USING (row)
"""
