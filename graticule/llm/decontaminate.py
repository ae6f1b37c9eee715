"""Benchmark decontamination by winnowing, with DataFrame functions only.

The fingerprint of a position is the least hash of the GRAM-word grams in the window of RUN grams that
begins there. A window of SPAN = GRAM + RUN - 1 words has one fingerprint, so any span of SPAN words or more
that a document shares with an item gives both an equal one: none is missed. Of a document only positions
at which the fingerprint changes are kept, and every RUN-th, so that each stands for the RUN windows from
it on. Kept positions whose fingerprint an item has are extended to those windows, and each is compared
word by word. Items below SPAN words are one window each; positions of their length are compared directly.

Joins are with the fingerprints and windows of the items only. They are broadcast while their size, which is measured
first, is at most BROADCAST_BYTES: then all is one scan of the documents, which only hits leave. Beyond that Spark shuffles
the fingerprints of documents, without their words, and splits skewed partitions.

Defined results: null and empty texts have no words and no hits; rows of equal doc_id and text get equal
results, rows of equal doc_id and other text their own; very long texts are read whole; items of equal item_id count once; a null item_id
counts as no item, though its words are hit; empty tables give an empty result or no hits; only doc_id,
text and item_id are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, sent

GRAM, RUN = 5, 6
SPAN = GRAM + RUN - 1
#: Most bytes of fingerprints and windows of items that are broadcast; a row counts ROW_BYTES besides its words and ids.
BROADCAST_BYTES, ROW_BYTES = 96 << 20, 64

# What a word is, and the letters that are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text; null and empty texts have none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    # lower() and translate() agree on texts of one byte a character, and lower() is quicker.
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def _first(values: Column, n: Column) -> Column:
    return F.slice(values, 1, F.greatest(n, F.lit(0)))


def _grams(hashes: Column, n: int) -> Column:
    """The hash of the n-gram that begins at each position."""
    return F.transform(_first(hashes, F.size(hashes) - (n - 1)), lambda x, i: F.xxhash64(x, *(F.get(hashes, i + k) for k in range(1, n))))


def fingerprints(df: DataFrame) -> DataFrame:
    """df (with a column words) with columns hashes, of each word, and prints, of each window of SPAN words."""
    df = df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    df = df.withColumn("grams", _grams(F.col("hashes"), GRAM))
    grams = F.col("grams")
    least = F.transform(_first(grams, F.size(grams) - (RUN - 1)), lambda x, i: F.least(x, *(F.get(grams, i + k) for k in range(1, RUN))))
    return df.withColumn("prints", least).drop("grams")


def _windows(benchmark: DataFrame) -> tuple[DataFrame, DataFrame, list[int]]:
    """The items' fingerprints (size, print), their windows (w_size, w_hash, w_words, item_ids), and the sizes below SPAN."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words")).where(F.size("words") > 0)
    short = [r[0] for r in items.where(F.size("words") < SPAN).select(F.size("words").alias("n")).distinct().collect()]  # SPAN - 1 values at most
    n = F.least(F.size("words"), F.lit(SPAN))
    starts = items.select("item_id", "words", F.explode(F.sequence(F.lit(1), F.size("words") - n + 1)).alias("at"))
    windows = starts.select("item_id", F.slice("words", F.col("at"), n).alias("w_words")).groupBy("w_words").agg(F.collect_set("item_id").alias("item_ids"))
    windows = windows.select(F.size("w_words").alias("w_size"), F.xxhash64(F.array_join("w_words", " ")).alias("w_hash"), "w_words", "item_ids")
    long = fingerprints(items.where(F.size("words") >= SPAN)).select(F.lit(SPAN).alias("size"), F.explode_outer("prints").alias("print"))
    brief = items.where(F.size("words") < SPAN).select(F.size("words").alias("size"), F.xxhash64(F.array_join("words", " ")).alias("print"))
    return long.unionByName(brief).distinct(), windows, sorted(short)


def _marks(size: int) -> Column:
    """(size, at, print) of every place in words, for items of that size."""
    mark = lambda _, i: F.struct(F.lit(size).alias("size"), i.alias("at"), F.xxhash64(F.array_join(F.slice("words", i + 1, size), " ")).alias("print"))
    return F.transform(_first(F.col("words"), F.size("words") - (size - 1)), mark)


def _marked(docs: DataFrame, short: list[int]) -> DataFrame:
    """doc_id, th, words and marks (size, at, print) of documents. A first mark of size 0 stands for the document itself."""
    df = fingerprints(docs.select("doc_id", F.xxhash64("text").alias("th"), words(F.col("text")).alias("words")))
    v = F.col("prints")
    kept = F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda i: (i % RUN == 0) | (F.get(v, i) != F.get(v, i - 1)))
    marks = F.when(F.size(v) > 0, F.transform(kept, lambda i: F.struct(F.lit(SPAN).alias("size"), i.alias("at"), F.get(v, i).alias("print"))))
    none = F.array().cast("array<struct<size:int,at:int,print:bigint>>")
    itself = F.array(F.struct(F.lit(0).alias("size"), F.lit(-1).alias("at"), F.lit(0).cast("long").alias("print")))
    # The marks are a column of their own and are exploded with explode_outer, which adds no filter on them: so the explosion, the
    # joins and the extension are compiled into one stage, in which the words of a document are referred to and not copied for each row.
    return df.select("doc_id", "th", "words", F.concat(itself, F.coalesce(marks, none), *(_marks(m) for m in short)).alias("marks"))


def _spread(met: DataFrame) -> DataFrame:
    """The windows that fingerprints which were met stand for, with their words."""
    last = F.when(F.col("size") == SPAN, F.least(F.col("at") + (RUN - 1), F.size("words") - SPAN)).otherwise(F.col("at"))
    spread = met.select("doc_id", "th", "words", "size", F.explode_outer(F.sequence("at", last)).alias("start"))
    spread = spread.select("doc_id", "th", F.size("words").alias("n_words"), "size", "start", F.slice("words", F.greatest(F.col("start") + 1, F.lit(1)), F.col("size")).alias("own_words"))
    return spread.withColumn("own_hash", F.xxhash64(F.array_join("own_words", " ")))


_SAME = "size = w_size AND own_hash = w_hash AND own_words = w_words"


def _hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, th, n_words and the hit windows (size, start, item_ids) of documents. Every document has a row of size 0 as well."""
    prints, windows, short = _windows(benchmark)
    prints, windows = prints.withColumn("met", F.lit(True)), windows.withColumn("hit", F.lit(True))
    size = F.sum(F.octet_length(F.array_join("w_words", " ")) + 16 * F.size("w_words") + F.octet_length(F.array_join("item_ids", " ")) + 16 * F.size("item_ids") + ROW_BYTES)
    if prints.count() * ROW_BYTES + (windows.agg(size).first()[0] or 0) <= BROADCAST_BYTES:
        marked = _marked(docs, short).select("doc_id", "th", "words", F.explode_outer("marks").alias("m")).select("doc_id", "th", "words", "m.size", "m.at", "m.print")
        met = marked.join(F.broadcast(prints), ["size", "print"], "left").where("met OR size = 0")
        found = _spread(met).join(F.broadcast(windows), F.expr(_SAME), "left").where("hit OR size = 0")
    else:
        # No words travel with the fingerprints; those of documents with hits are joined again, once a document.
        marked = _marked(docs, short).select("doc_id", "th", F.size("words").alias("n_words"), F.explode_outer("marks").alias("m")).select("doc_id", "th", "n_words", "m.size", "m.at", "m.print")
        itself = marked.where("size = 0").select("doc_id", "th", "n_words", "size", F.col("at").alias("start"), F.lit(None).cast("array<string>").alias("item_ids"))
        met = marked.where("size > 0").join(prints, ["size", "print"], "left_semi").groupBy("doc_id", "th").agg(F.collect_set(F.struct("size", "at")).alias("marks"))
        own = docs.select(F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_th"), "text").dropDuplicates(["own_id", "own_th"])
        joined = met.join(own, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("th") == F.col("own_th"))).select("doc_id", "th", words(F.col("text")).alias("words"), "marks")
        spread = _spread(joined.select("doc_id", "th", "words", F.explode_outer("marks").alias("m")).select("doc_id", "th", "words", "m.size", "m.at"))
        found = spread.join(windows, F.expr(_SAME)).select("doc_id", "th", "n_words", "size", "start", "item_ids").unionByName(itself)
    return found.select("doc_id", "th", "n_words", "size", "start", "item_ids")


def _covered(spans: Column) -> Column:
    """Words inside any of the (start, end) spans."""
    state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(s["end"] - F.greatest(s["start"], acc["reach"]), F.lit(0))).alias("n"), F.greatest(acc["reach"], s["end"]).alias("reach"))
    return F.aggregate(F.array_sort(spans), state, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, item_ids (sorted) and contaminated."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spans = F.collect_set(F.when(F.col("size") > 0, F.struct("start", (F.col("start") + F.col("size")).alias("end"))))
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids"))))
    found = _hits(own, benchmark).groupBy("doc_id", "th").agg(F.max("n_words").alias("n_words"), F.count_if(F.col("size") == 0).cast("int").alias("rows"), spans.alias("spans"), items.alias("item_ids"))
    found = found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), _covered(F.col("spans")).cast("long").alias("n_hit"), "item_ids", F.explode_outer(F.array_repeat(F.lit(True), F.col("rows"))).alias("row"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids", (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows of which any word is hit; a null or empty text stays."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = materialise(_hits(own, benchmark).where("size > 0").select(F.col("doc_id").alias("_hit_id"), F.col("th").alias("_hit_th")).distinct(), "hit")
    # Hit documents are counted: if they are few, texts are not moved.
    return docs.join(sent(found), docs["doc_id"].cast("long").eqNullSafe(F.col("_hit_id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("_hit_th")), "left_anti")
