"""robots.txt files as a rule table, and the filter of crawl targets by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentflow.functions import urls
from contentflow.functions.binding import staged


def disallowed_paths(body: Column, agent: str) -> Column:
    """Disallow values that apply to ``*`` or the agent; the last agent line read decides."""
    state = "struct<applies:boolean,rules:array<string>>"
    lines = F.filter(
        F.transform(F.split(body, r"\r?\n"), lambda line: F.trim(F.regexp_replace(line, r"#.*", ""))),
        lambda line: line.contains(":"),
    )

    def step(done: Column, line: Column) -> Column:
        key = F.lower(F.trim(F.substring_index(line, ":", 1)))
        value = F.trim(F.regexp_replace(line, r"^[^:]*:", ""))
        applies = F.when(key == "user-agent", F.lower(value).isin("*", agent.lower())).otherwise(done["applies"])
        rules = F.when((key == "disallow") & done["applies"], F.concat(done["rules"], F.array(value))).otherwise(done["rules"])
        return F.struct(applies.alias("applies"), rules.alias("rules")).cast(state)

    start = F.struct(F.lit(False).alias("applies"), F.array().cast("array<string>").alias("rules")).cast(state)
    return F.aggregate(lines, start, step)["rules"]


def robots_rules(raw: DataFrame, agent: str = "contentflow") -> DataFrame:
    """``(origin, rule)`` of the newest robots file per origin; a failed fetch allows everything.

    A file is folded inside its row, so only finished rules are shuffled.
    """
    ok = raw.where((F.col("status") >= 200) & (F.col("status") < 300))
    newest = staged(ok, origin=urls.url_origin(F.col("url"))).groupBy("origin").agg(F.max_by("text", "seq").alias("text"))
    rules = newest.select("origin", F.explode(disallowed_paths(F.col("text"), agent)).alias("rule"))
    return rules.where(F.col("rule") != "").distinct()


def filter_robots(targets: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Targets no rule of their origin forbids.

    An anti join on the origin with a prefix test as residual; adaptive
    execution splits the targets of an origin that has too many.
    """
    address = F.col(url)
    query = F.when(urls.url_query(address) != "", F.concat(F.lit("?"), urls.url_query(address))).otherwise(F.lit(""))
    keyed = staged(targets, target_origin=urls.url_origin(address), target_path=F.concat(urls.url_path(address), query))
    banned = (F.col("target_origin") == F.col("origin")) & F.col("target_path").startswith(F.col("rule"))
    return keyed.join(rules, banned, "left_anti").drop("target_origin", "target_path")
