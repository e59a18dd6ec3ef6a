"""One query per operator, applied to its whole table: ``name -> callable(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentflow.llm import (
    chat, classifier, decontaminate, hard_negatives, jaccard, language_id, language_model, mixing, pii, quality_rules, spelling, substrings, suffixes,
)
from contentflow.llm.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op10_quality_rules(spark, sf):
    """Base counts and the verdict of the rules on each document and on its host."""
    return quality_rules.host_verdicts(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_failed", "kept"
    )


@query
def op1_chat(spark, sf):
    """All conversations and one that says control strings, formatted and read back."""
    turns = chat.canonical_turns(table(spark, sf, "conversations"))
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    rows = chat.formatted(turns.unionByName(more))
    rows = rows.withColumns({"turns": chat.read_turns(F.col("formatted")), "loss": F.array_join(chat.read_loss(F.col("formatted"), F.col("loss_mask")), "")})
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


@query
def op7_mixing(spark, sf):
    """Every document with its raked weight, its probability and whether it is sampled."""
    return mixing.probabilities(table(spark, sf, "documents"))


@query
def op5_quality_classifier(spark, sf):
    """Every document's probability of quality 1."""
    return classifier.quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op6_substring_dedup(spark, sf):
    """What is left of every document without the passages of twenty words that occur earlier."""
    rows = substrings.removals(table(spark, sf, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op3_ngram_jaccard(spark, sf):
    """Every document's shingle count and the component of its near copies."""
    return jaccard.joined(table(spark, sf, "documents"))


@query
def op4_suffix_array(spark, sf):
    """The passages of fifty words and more that documents repeat."""
    return suffixes.passages(table(spark, sf, "documents"))


@query
def op9_language_model(spark, sf):
    """Every document's mean log score under the trigram counts of all others."""
    return language_model.scored(table(spark, sf, "documents"))


@query
def op2_decontamination(spark, sf):
    """Every place where a document holds a passage of a benchmark item."""
    return decontaminate.matches(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op8_pii(spark, sf):
    """Personal data of every document: the base spans and those the random field adds."""
    docs = table(spark, sf, "documents")
    rows = pii.spans(docs, pii.fitted(docs))
    return rows.select("doc_id", *[f"n_{k}" for k in pii.KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")


@query
def op11_hard_negatives(spark, sf):
    """For each anchor and positive, the best rows of other labels that score 80 to 100 per cent of the positive."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(table(spark, sf, "embeddings"), F.col("id") % 100 == 0, label=label)


@query
def op12_spelling(spark, sf):
    """Every word with its near words counted, the form it is a variant of, and the last form."""
    return spelling.variants(table(spark, sf, "documents"))


@query
def op13_language_id(spark, sf):
    """The language of every document, learned outside the held-out fold."""
    return language_id.predicted(table(spark, sf, "documents"))
