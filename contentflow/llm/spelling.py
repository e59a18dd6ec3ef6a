"""Spelling variants by one-edit neighbourhoods over a reduced alphabet.

Words are counted over all texts. Every letter is hashed to one of a few
symbols, so a word becomes a reduced word; the full one-edit neighbourhood of
each distinct reduced word (deletions, replacements, insertions and the word
itself) is generated and joined to the reduced vocabulary. Two words that
differ by one edit have reduced words that differ by one edit or none, so no
pair is missed; words whose reduced words meet are verified on the original
letters. The number of symbols follows from the vocabulary: the fewest for
which reduced words stand for few words each. It decides the cost, not the
result. Neighbourhoods meet the vocabulary as 64-bit hashes, which can only add
candidates. A word's variants are counted and its form chosen by partial
aggregates, and roots are found by pointer jumping over written tables.

Defined results: null texts have no words, a null id counts as an empty one in
the deletions; every repeated row counts; words below the least length or count
are left out; very long texts and words are read whole; other columns are not
read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentflow.llm.exchange import partitions
from contentflow.llm.tables import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = LOWER + "".join(map(chr, range(0xC0, 0x100)))
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: One occurrence in so many loses a letter.
DELETIONS = 97
#: Numbers of symbols to choose from, and words that a word may share its reduced word with on average.
SYMBOLS, SHARED = (4, 5, 6, 8, 10, 12, 16), 6.0
ALPHABET = "abcdefghijklmnop"


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH) -> DataFrame:
    """(doc, run): the runs of letters of at least so many letters, A to Z in lower case."""
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    found = F.regexp_extract_all(lowered, F.lit(f"([A-Za-z\\u00C0-\\u00FF]{{{least},}})"), F.lit(1))
    return docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("doc"), F.explode(found).alias("run"))


def with_deletions(doc: Column, run: Column, one_in: int = DELETIONS) -> Column:
    """The run, or the run without a letter where the hash of document and run says so."""
    h = F.crc32(F.concat(doc, F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that occur often enough; counts leave each map task added up."""
    words = runs(docs, key, text).select(with_deletions(F.col("doc"), F.col("run")).alias("word"))
    return words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def reduced(word: Column, symbols: int) -> Column:
    """The word over so many symbols; a letter's symbol is a hash of its code point."""
    hashed = "".join(ALPHABET[(ord(c) * 2654435761 >> 7) % symbols] for c in LETTERS)
    return F.translate(word, LETTERS, hashed)


def symbols_for(words: DataFrame) -> int:
    """The fewest symbols for which words share their reduced word with few others, judged over all words."""
    sizes = words.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.xxhash64(reduced(F.col("word"), k)).alias("r")) for k in SYMBOLS])).alias("x"))
    shared = sizes.groupBy("x").count().groupBy("x.k").agg((F.sum(F.col("count") * F.col("count")) / F.sum("count")).alias("mean")).collect()
    return min([r["k"] for r in shared if r["mean"] <= SHARED], default=SYMBOLS[-1])


def neighbourhood(r: Column, symbols: int) -> Column:
    """Hashes of the reduced word and of all words one edit away from it."""
    places = F.sequence(F.lit(0), F.length(r))
    before, behind = lambda i: F.substr(r, F.lit(1), i), lambda i: F.substr(r, i + 1)
    each = F.array(*[F.lit(s) for s in ALPHABET[:symbols]])
    inserted = F.flatten(F.transform(places, lambda i: F.transform(each, lambda s: F.concat(before(i), s, behind(i)))))
    # Past the end both of these leave the word as it is.
    replaced = F.flatten(F.transform(places, lambda i: F.transform(each, lambda s: F.concat(before(i), F.when(i < F.length(r), s).otherwise(""), behind(i + 1)))))
    deleted = F.transform(places, lambda i: F.concat(before(i), behind(i + 1)))
    return F.array_distinct(F.transform(F.concat(inserted, replaced, deleted), lambda x: F.xxhash64(x)))


def near_pairs(words: DataFrame, symbols: int | None = None) -> DataFrame:
    """(word, n, near, near_n): every pair of words one edit apart, in both directions."""
    symbols = symbols or symbols_for(words)
    keyed = written(words.select("word", "n", reduced(F.col("word"), symbols).alias("r")).withColumn("key", F.xxhash64("r")), "reduced")
    # Each reduced word becomes a hundred rows: the few bytes of the vocabulary are dealt to all tasks beforehand.
    distinct = keyed.repartition(partitions(words.sparkSession), "key").groupBy("key").agg(F.min("r").alias("r"))
    around = distinct.select("key", F.explode(neighbourhood(F.col("r"), symbols)).alias("other"))
    met = around.join(distinct.select(F.col("key").alias("other")), "other")
    left = keyed.select("key", "word", "n").join(met, "key").select("word", "n", "other")
    right = keyed.select(F.col("key").alias("other"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return left.join(right, "other").where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every (word, form): forms followed to the last, twice as far in each round."""
    at = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        above = at.select(F.col("word").alias("up"), F.col("root").alias("higher"))
        step = at.join(above, at["root"] == above["up"], "left").select("word", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved"))
        step = written(step, "roots")
        if not step.agg(F.max("moved")).first()[0]:
            return step.select("word", "root")
        at = step.select("word", "root")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", symbols: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the vocabulary."""
    words = written(vocabulary(docs, key, text), "words")
    near = near_pairs(words, symbols).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best")
    )
    rows = words.join(near, "word", "left").withColumn("form_n", -F.col("best.less"))
    kept = F.col("form_n") >= 2 * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(kept, F.col("best.form")).alias("form"), F.when(kept, F.col("form_n")).alias("form_n"))
    rows = written(rows, "variants")
    return rows.join(roots(rows.where("form IS NOT NULL")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
