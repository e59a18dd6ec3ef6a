"""Host-level quality rules.

Each document is measured once, in its own row. Failures of every rule are
summed by host, the host's rate is shrunk towards a beta prior fitted to all
hosts by moments, and a host whose shrunk rate passes a limit fails with all
its documents. Sums leave each map task as one row per host, so a host with a
third of all documents costs no more than any other.

Defined results: a null or blank text has no words and fails as too short; a
null host has no verdict of its own; repeated rows count each; other columns
are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentflow.llm.tables import looked_up, words, written

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host fails when the shrunk rate of any rule is above this.
HOST_LIMIT = 0.5
#: Repeated windows up to which each window of a text is looked up among them.
FEW = 32

#: Rules whose failures are summed by host, over the measured columns.
RULES: dict[str, str] = {
    "short": f"n_words < {MIN_WORDS}",
    "repetitive": f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
    "symbols": "5 * n_symbols > word_chars",
    "lines": "2 * n_dup_lines > n_lines",
}


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` with the counts of each text, from array functions on the row alone."""
    rows = docs.withColumns({"_body": F.coalesce(F.col(text), F.lit("")), "_words": words(F.col(text))})
    lines = F.filter(F.split("_body", "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    rows = rows.withColumns({"_hashes": F.transform("_words", lambda w: F.xxhash64(w)), "_lines": lines})
    # The hash at a word covers it and the next two; the last two words start no window and hash fewer.
    rows = rows.withColumn("_hashes", F.transform("_hashes", lambda h, i: F.xxhash64(h, F.get("_hashes", i + 1), F.get("_hashes", i + 2))))
    rows = rows.withColumn("_sorted", F.sort_array("_hashes"))
    rows = rows.withColumn("_twice", F.array_distinct(F.filter("_sorted", lambda h, i: h == F.get("_sorted", i + 1))))
    # Few repeated windows are looked up one by one; many are found by sorting hashes with their places.
    places = F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_places", F.when(F.size("_twice") > FEW, places))
    one_by_one = F.filter(F.transform("_hashes", lambda h, i: F.when(F.array_contains("_twice", h), i)), lambda i: i.isNotNull())
    sorted_out = F.filter("_places", lambda w, k: (w["h"] == F.get("_places", k + 1)["h"]) | (w["h"] == F.get("_places", k - 1)["h"]))
    rows = rows.withColumn(
        "_again",
        F.when(F.size("_twice") == 0, F.array().cast("array<int>"))
        .when(F.size("_twice") <= FEW, one_by_one)
        .otherwise(F.sort_array(F.transform(sorted_out, lambda w: w["i"]))),
    )
    covered = F.aggregate(
        "_again",
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("total")),
        lambda seen, i: F.struct(i.alias("last"), (seen["total"] + F.least(F.lit(3), i - seen["last"])).cast("bigint").alias("total")),
        lambda seen: seen["total"],
    )
    return rows.withColumns({
        "n_words": F.size("_words").cast("bigint"),
        "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
        "n_symbols": F.length(F.regexp_replace("_body", f"[^{SYMBOLS}]+", "")).cast("bigint"),
        "n_lines": F.size("_lines").cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "n_repeat_words": covered,
    }).drop("_body", "_words", "_hashes", "_sorted", "_twice", "_places", "_lines", "_again")


def shrunk_rates(rows: DataFrame, host: str, failures: list[str]) -> DataFrame:
    """Per host and rule: ``rate_<rule>``, the failure rate under a beta prior with the mean and variance of all hosts' rates."""
    hosts = rows.where(F.col(host).isNotNull()).groupBy(host).agg(F.count("*").alias("n"), *[F.sum(f).alias(f) for f in failures])
    moments = hosts.agg(
        *[F.coalesce(F.sum(f) / F.sum("n"), F.lit(0.0)).alias(f"mean_{f}") for f in failures],
        *[F.coalesce(F.var_pop(F.col(f) / F.col("n")), F.lit(0.0)).alias(f"var_{f}") for f in failures],
    ).first()

    def rate(f: str) -> Column:
        mean, variance = F.lit(moments[f"mean_{f}"]), F.lit(moments[f"var_{f}"])
        # Moments of a beta; hosts that hardly differ give a strong prior, bounded to keep it finite.
        strength = F.greatest(F.lit(1.0), F.least(F.lit(1e6), mean * (1 - mean) / F.greatest(variance, F.lit(1e-9)) - 1))
        return ((F.col(f) + strength * mean) / (F.col("n") + strength)).alias(f"rate_{f}")

    return hosts.select(host, "n", *[rate(f) for f in failures])


def host_verdicts(docs: DataFrame, host: str = "source", key: str = "doc_id", text: str = "text", limit: float = HOST_LIMIT) -> DataFrame:
    """One row per document: its counts, ``base_failed``, the host's largest shrunk rate, and ``kept``."""
    rows = measured(docs.select(key, host, text), text).drop(text)
    failures = {f"fail_{name}": F.expr(rule).cast("bigint") for name, rule in RULES.items()}
    rows = written(rows.withColumns(failures), "rules")
    rates = shrunk_rates(rows, host, list(failures))
    failed = rates.select(host, F.greatest(*[F.col(f"rate_{f}") for f in failures]).alias("host_rate"))
    failed = written(failed.where(F.col("host_rate") > limit), "hosts")
    base = (F.col("fail_short") + F.col("fail_repetitive")) > 0
    joined = looked_up(rows, failed, host, failed.count())
    return joined.select(
        key, host, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"),
        F.col("host_rate").isNotNull().alias("host_failed"),
        (~base & F.col("host_rate").isNull()).alias("kept"),
    )
