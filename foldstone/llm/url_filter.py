"""URL filters (operator 5): a blocked Bloom filter passes possible hits to an exact join with the list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldstone.llm.native import blocked_filter, lower_ascii, possible_hits
from foldstone.session import stage

# What a url gets that is on no list.
UNLISTED = "allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased. Path: from there up to ``? #`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _candidates(labels: int, depth: int) -> Column:
    """Canonical forms that a listed entry could have: up to so many last host labels, up to so many leading folders."""
    names = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.greatest(F.size(names) - labels + 1, F.lit(1)), F.size(names)), lambda i: F.array_join(F.slice(names, i, F.size(names)), "."))
    folders = F.split("path", "/")
    last = F.least(F.size(folders) - 1, F.lit(depth))
    starts = F.when(last < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), last), lambda i: F.concat(F.array_join(F.slice(folders, 1, i), "/"), F.lit("/"))))
    paths = F.array_distinct(F.concat(starts, F.array(F.col("path"))))
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per page: page_id, url, host, path, rule, verdict.

    ``rules`` has (rule, verdict); a rule is ``host/path``, where the path is a whole path or ends with ``/``. It fits its
    host and all hosts below it when the url's path is that path or lies below it; the longest rule wins. Only canonical
    forms that the Bloom filter lets pass are joined with the list. A url on no list, also null and one without ``://``
    (host and path empty), has no rule and is allowed. Repeated pages each get a row; an empty table gives an empty result.
    """
    host, path = host_and_path(F.col("url"))
    parsed = stage(pages.select("page_id", "url", host.alias("host"), path.alias("path")))
    listed = stage(rules.select("rule", "verdict").dropDuplicates(["rule"]))
    # Two numbers about the list bound how many forms of a url can be listed at all.
    labels, depth = listed.agg(F.max(F.size(F.split(F.split("rule", "/")[0], r"\."))), F.max(F.size(F.split("rule", "/")) - 1)).first()
    bits = blocked_filter(listed.select(F.xxhash64("rule").alias("h")), "h")
    forms = parsed.select("page_id", "url", F.explode(_candidates(labels or 1, depth or 1)).alias("form"))
    hits = possible_hits(forms, F.xxhash64("form"), bits).join(listed, F.col("form") == F.col("rule"))
    best = stage(hits.groupBy("page_id", "url").agg(F.max_by(F.struct("rule", "verdict"), F.length("rule")).alias("best")))
    same = F.col("p.page_id").eqNullSafe(F.col("b.page_id")) & F.col("p.url").eqNullSafe(F.col("b.url"))
    joined = parsed.alias("p").join(best.alias("b"), same, "left")
    return joined.select("p.page_id", "p.url", "p.host", "p.path", F.col("b.best.rule").alias("rule"), F.coalesce("b.best.verdict", F.lit(UNLISTED)).alias("verdict"))
