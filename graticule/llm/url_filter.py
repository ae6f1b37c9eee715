"""Verdicts on URLs by rules on hosts and paths, with DataFrame functions only.

A rule is a host, a path and a verdict. It fits its host and all subdomains if the URL's path starts with the rule's; the longest rule
that fits decides (host and path together), then the longer host, then block before allow. Where none fits the verdict is `default`.

Each URL is expanded into expressions: every suffix of its host by every prefix of its path that a rule could have. Expressions and
rules meet on the first PREFIX bytes of their SHA-256 digests; a meeting counts once the whole digests agree. One row of facts about the
rules bounds the expansion: their longest path, their most host labels, and the lengths of those paths that do not end in a slash (other
paths need prefixes up to a slash only). A prefix longer than any rule's path fits none, so nothing is lost. Rules are counted: up to
SENT they go to every executor. Beyond, they meet the expressions by a shuffle in which each rule stands SALT times and each
expression goes to one of these, so that one host with a third of all URLs is dealt out.

Defined results: a null URL, and one without `://`, has an empty host and path, which only a rule for the empty host fits; one row for
each row, repeated rows and null ids included; rules with a null host or verdict fit nothing, a null path counts as the empty one, which
every path starts with; repeated rules count once; no rules: the default everywhere; empty tables give empty results; only the key and
the URL are read, so other columns may have any names. Long URLs cost the expressions that rules' lengths allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a digest that expressions and rules meet on; rules that are sent at most (some 200 bytes each); copies of a rule beyond.
PREFIX, SENT, SALT = 4, 100_000, 32

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; and from there up to `?`, `#` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    """The digest of an expression; the host's length keeps host and path apart."""
    return F.sha2(F.concat(F.length(host).cast("string"), F.lit(":"), host, path), 256)


def _rules(rules: DataFrame, prefix: int) -> DataFrame:
    own = rules.select(F.translate(F.col("host"), _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host IS NOT NULL AND verdict IN ('allow', 'block')")
    order = F.struct(
        (F.length("host") + F.length("path")).alias("length"), F.length("host").alias("host_length"), (F.col("verdict") == "block").alias("block"),
        F.concat("host", "path").alias("rule"), F.col("verdict"),
    )
    own = own.groupBy("host", "path").agg(F.max(order).alias("order"))
    digest = _digest(F.col("host"), F.col("path"))
    return own.select("host", "path", digest.alias("digest"), F.substring(digest, 1, 2 * prefix).alias("short"), "order")


def _facts(rules: DataFrame) -> DataFrame:
    """One row: most_path, most_labels, and lengths of paths without a slash at their end (as many as there are different lengths)."""
    odd = F.when(~F.col("path").endswith("/") & (F.col("path") != ""), F.length("path"))
    return rules.agg(
        F.coalesce(F.max(F.length("path")), F.lit(0)).alias("most_path"), F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(0)).alias("most_labels"),
        F.sort_array(F.collect_set(odd)).alias("lengths"),
    )


def _expressions(host: Column, path: Column) -> Column:
    """Structs (host, path) of the suffixes and prefixes that a rule can have; needs the columns of _facts."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.greatest(n - F.col("most_labels") + 1, F.lit(1)), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    parts = F.split(F.substring(path, F.lit(1), F.col("most_path")), "/")
    slashes = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    odd = F.transform(F.filter("lengths", lambda k: k <= F.length(path)), lambda k: F.substring(path, F.lit(1), k))
    prefixes = F.concat(F.array(F.lit("")), slashes, odd)
    some = F.when(F.col("most_labels") > 0, suffixes).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(some, lambda s: F.transform(prefixes, lambda p: F.struct(s.alias("host"), p.alias("path")))))


def judge(urls: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow", prefix: int = PREFIX, sent: int = SENT, salt: int = SALT) -> DataFrame:
    """(key, host, path, rule, verdict) of each row; rule is null where none of the rules (host, path, verdict) fits. See the module."""
    from .common import materialise

    known = materialise(_rules(rules, prefix), "url-rules")
    host, path = host_and_path(F.col("_url"))
    own = urls.select(F.col(key).alias("_key"), F.col(url).cast("string").alias("_url")).select("_key", host.alias("_host"), path.alias("_path"))
    # The expression with number -1 stands for the row itself: it meets no rule, and repeated rows are counted by it.
    spread = own.crossJoin(F.broadcast(_facts(known)))
    spread = spread.select("_key", "_host", "_path", F.explode(F.concat(F.array(F.lit(None).cast("struct<host:string,path:string>")), _expressions(F.col("_host"), F.col("_path")))).alias("_e"))
    digest = _digest(F.col("_e.host"), F.col("_e.path"))
    spread = spread.select("_key", "_host", "_path", F.col("_e").isNull().alias("_self"), digest.alias("_digest"), F.substring(digest, 1, 2 * prefix).alias("_short"))
    few = known.count() <= sent
    if few:
        met = spread.join(F.broadcast(known.select("short", "digest", "order")), F.col("_short") == F.col("short"), "left")
    else:
        copies = known.select("short", "digest", "order", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias("copy"))
        salted = spread.withColumn("_copy", F.pmod(F.monotonically_increasing_id(), F.lit(salt)).cast("int"))
        met = salted.join(copies, (F.col("_short") == F.col("short")) & (F.col("_copy") == F.col("copy")), "left")
    fits = F.max(F.when(F.col("digest") == F.col("_digest"), F.col("order"))).alias("_best")
    # Several rules can share a short prefix, but a row's own expression meets none: so it counts the row once.
    best = met.groupBy("_key", "_host", "_path").agg(fits, F.count(F.when(F.col("_self"), 1)).alias("_times"))
    each = best.select("*", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
    return each.select(F.col("_key").alias(key), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
