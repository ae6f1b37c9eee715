"""Sparse count tables (doc, term, cnt): terms, distances, quality measures, normalisation, marker labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.storage import materialise


#: Terms that are sent to every executor at most, some 30 bytes each; docs of a block, products that a task holds at once, and bytes of blocks that are sent.
SENT_TERMS, BLOCK, CELLS, SENT_BYTES = 1_000_000, 128, 1 << 21, 64 << 20


def terms(texts: DataFrame, least_docs: int = 1, pattern: str = "[a-z0-9_]{2,}", stop: list[str] | None = None) -> DataFrame:
    """(doc, term, cnt) of texts (doc, text): lower-cased words that occur in least_docs texts or more.

    Counts are written once. The terms that stay are sent to every executor if there are SENT_TERMS of them at most; beyond, they are joined by a shuffle.
    """
    words = texts.select("doc", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0))).alias("term"))
    if stop:
        words = words.where(~F.col("term").isin(stop))
    counted = words.groupBy("doc", "term").agg(F.count("*").alias("cnt"))
    if least_docs <= 1:
        return counted
    counted = materialise(counted, "counts")
    common = materialise(counted.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= least_docs).select("term"), "terms")
    small = common.count() <= SENT_TERMS
    return counted.join(F.broadcast(common) if small else common, "term", "left_semi").select("doc", "term", "cnt")


def _packed_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of BLOCK docs with their terms and roots of shares."""
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            some = b.slice(at, BLOCK)
            lists = some.column("terms").combine_chunks() if isinstance(some.column("terms"), pa.ChunkedArray) else some.column("terms")
            sizes = pc.fill_null(pc.list_value_length(lists), 0)
            flat = lists.flatten()
            row = {"docs": pa.array([some.column("doc").to_pylist()], pa.list_(some.column("doc").type)), "sizes": pa.array([sizes.to_pylist()], pa.list_(pa.int64()))}
            row |= {name: pa.array([flat.field(name).to_pylist()], pa.list_(flat.field(name).type)) for name in ("term", "p")}
            yield pa.RecordBatch.from_arrays(list(row.values()), names=["docs", "sizes", "terms", "ps"])


def _similarities(a: dict, b: dict) -> np.ndarray:
    """Sums of products of the roots that the docs of two blocks have for the same terms; a few docs of the second at a time."""
    codes = pd.factorize(np.array([*a["terms"], *b["terms"]], object))[0]
    rows_a = np.repeat(np.arange(len(a["docs"])), a["sizes"])
    codes_a, codes_b, p_a, p_b = codes[: len(rows_a)], codes[len(rows_a) :], np.array(a["ps"], float), np.array(b["ps"], float)
    ends = np.cumsum(b["sizes"])
    out, first = np.zeros((len(a["docs"]), len(b["docs"]))), 0
    while first < len(ends):
        start = ends[first] - b["sizes"][first]
        last = max(first + 1, int(np.searchsorted(ends, start + CELLS // len(a["docs"]), "right")))
        mine, place = np.unique(codes_b[start : ends[last - 1]], return_inverse=True)
        if len(mine):
            met = np.minimum(np.searchsorted(mine, codes_a), len(mine) - 1)
            same = mine[met] == codes_a
            dense = np.zeros((len(a["docs"]), len(mine)))
            dense[rows_a[same], met[same]] = p_a[same]
            products = dense[:, place] * p_b[start : ends[last - 1]]
            full = np.flatnonzero(np.array(b["sizes"][first:last]) > 0)
            out[:, first + full] = np.add.reduceat(products, (ends - b["sizes"])[first + full] - start, axis=1)
        first = last
    return out


def hellinger(counts: DataFrame, docs: DataFrame) -> DataFrame:
    """(i, j, dist) of all pairs of docs (doc); a text without terms is at distance 1 to all. Docs are packed in blocks, and a task compares two of them: a term that all docs have is no one key's, and no pair is a row before its distance is known."""
    share = F.sqrt(F.col("cnt") / F.sum("cnt").over(W.partitionBy("doc")))
    lists = counts.select(F.col("doc").alias("_doc"), F.struct("term", share.alias("p")).alias("s")).groupBy("_doc").agg(F.collect_list("s").alias("terms"))
    rows = docs.select("doc").join(lists, F.col("doc") == F.col("_doc"), "left").select("doc", "terms")
    kind, term = dict(docs.dtypes)["doc"], dict(counts.dtypes)["term"]
    blocks = materialise(rows.mapInArrow(_packed_docs, f"docs array<{kind}>, sizes array<long>, terms array<{term}>, ps array<double>"), "blocks")
    other = blocks.select(*(F.col(c).alias(f"{c}_b") for c in blocks.columns))
    n, size = blocks.agg(F.count("*"), F.coalesce(F.sum(F.size("ps")), F.lit(0))).first()
    pairs = blocks.repartition(max(1, n)).crossJoin(F.broadcast(other) if size * 40 <= SENT_BYTES else other)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types = [batch.schema.field(c).type.value_type for c in ("docs", "docs_b")]
            for row in batch.to_pylist():
                a, b = {c: row[c] for c in ("docs", "sizes", "terms", "ps")}, {c: row[f"{c}_b"] for c in ("docs", "sizes", "terms", "ps")}
                dist = np.sqrt(np.clip(1 - _similarities(a, b), 0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(a["docs"], types[0]).take(pa.array(np.repeat(np.arange(len(a["docs"])), len(b["docs"])))), pa.array(b["docs"], types[1]).take(pa.array(np.tile(np.arange(len(b["docs"])), len(a["docs"])))), pa.array(dist.ravel())], names=["i", "j", "dist"])

    return pairs.mapInArrow(run, f"i {kind}, j {kind}, dist double")


def quality(counts: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """(doc, n_terms, total, log_total, pct_<group>...): terms with a count, their sum, and the percentage in each group."""
    shares = [(100.0 * F.sum(F.when(c, F.col("cnt")).otherwise(0)) / F.sum("cnt")).alias(f"pct_{name}") for name, c in groups.items()]
    return counts.groupBy("doc").agg(F.count_if(F.col("cnt") > 0).alias("n_terms"), F.sum("cnt").alias("total"), F.log1p(F.sum("cnt")).alias("log_total"), *shares)


def filter_counts(counts: DataFrame, least_terms: int = 100, least_docs: int = 3) -> DataFrame:
    """counts of docs with least_terms terms or more, then of terms in least_docs of those or more."""
    docs = counts.groupBy("doc").agg(F.count("*").alias("n")).where(F.col("n") >= least_terms).select("doc")
    left = counts.join(docs, "doc", "left_semi")
    kept = left.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= least_docs).select("term")
    return left.join(kept, "term", "left_semi").select(*counts.columns)


def normalise_total(counts: DataFrame) -> DataFrame:
    """counts with value: log(1 + cnt scaled to the median of the docs' totals)."""
    totals = counts.groupBy("doc").agg(F.sum("cnt").alias("total"))
    median = totals.agg(F.percentile("total", F.lit(0.5)).alias("median"))
    joined = counts.join(totals, "doc").crossJoin(F.broadcast(median))
    return joined.select(*counts.columns, F.log1p(F.col("cnt") * F.col("median") / F.col("total")).alias("value"))


def variable_terms(counts: DataFrame, most: int = 2000, batch: str | None = None) -> DataFrame:
    """(term, dispersion, rank) of the terms with the largest variance over mean, of each batch."""
    keys = [batch] if batch else []
    spread = counts.groupBy(*keys, "term").agg((F.variance("cnt") / F.avg("cnt")).alias("dispersion"))
    order = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))).orderBy(F.desc_nulls_last("dispersion"), "term")
    if not keys:
        return spread.orderBy(F.desc_nulls_last("dispersion"), "term").limit(most).withColumn("rank", F.row_number().over(order))
    return spread.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def steady_sum(column: Column | str) -> Column:
    """The sum of doubles, the same in whatever order rows come, so that groups of equal values have equal sums: as decimals of 18 places below a thousand
    million, others (not finite ones, too) as doubles."""
    value = (F.col(column) if isinstance(column, str) else column).cast("double")
    plain = F.abs(value) < 1e9
    exact = F.sum(F.when(plain, value).cast("decimal(38,18)")).cast("double")
    rest = F.sum(F.when(~plain, value))
    return F.when(rest.isNull(), exact).otherwise(F.coalesce(exact, F.lit(0.0)) + rest)


def above_percentile(values: DataFrame, key: str, value: str, share: float = 0.75) -> DataFrame:
    """values with high: whether a value is above that percentile of its key's positive values."""
    limits = values.where(F.col(value) > 0).groupBy(key).agg(F.percentile(value, F.lit(share)).alias("limit"))
    return values.join(limits, key, "left").withColumn("high", F.coalesce(F.col(value) > F.col("limit"), F.lit(False)))


def marker_masks(values: DataFrame, markers: dict[str, str], share: float = 0.75) -> DataFrame:
    """(doc, a boolean for each name): whether the value of the name's term is high in a doc (see above_percentile)."""
    high = above_percentile(values.where(F.col("term").isin(list(markers.values()))), "term", "value", share)
    return values.select("doc").distinct().join(high.groupBy("doc").agg(*(F.max(F.when(F.col("term") == t, F.col("high"))).alias(name) for name, t in markers.items())), "doc", "left").select("doc", *(F.coalesce(name, F.lit(False)).alias(name) for name in markers))


def label_job(values: DataFrame, markers: list[tuple[str, str]], other: str = "Other") -> DataFrame:
    """(label, code, n, share, n_multiple): how many docs have each label (see marker_labels), its code in the order of labels, and how many of them have several markers. Markers whose term no doc has are skipped; without any left it is an error."""
    met = {r["term"] for r in values.where(F.col("term").isin([t for t, _ in markers])).select("term").distinct().collect()}  # one for each marker at most
    known = [m for m in markers if m[0] in met]
    if not known:
        raise ValueError("no marker occurs")
    labels = marker_labels(values, known, other)
    counted = labels.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("n_positive") > 1).alias("n_multiple"))
    w = W.orderBy("label")  # a row for each label
    return counted.select("label", (F.row_number().over(w) - 1).alias("code"), "n", (F.col("n") / F.sum("n").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("share"), "n_multiple")


def marker_labels(values: DataFrame, markers: list[tuple[str, str]], other: str = "Other", share: float = 0.75) -> DataFrame:
    """(doc, label, n_positive): the label of the marker term that is high in a doc (see above_percentile); of several, that of the largest value, the first on ties."""
    if not markers:
        raise ValueError("no markers")
    spark = values.sparkSession
    table = spark.createDataFrame([(t, label, k) for k, (t, label) in enumerate(markers)], "term string, label string, place int")
    high = above_percentile(values.join(F.broadcast(table), "term"), "term", "value", share).where("high")
    best = high.groupBy("doc").agg(F.max_by("label", F.struct("value", -F.col("place"))).alias("label"), F.count("*").alias("n_positive"))
    return values.select("doc").distinct().join(best, "doc", "left").select("doc", F.coalesce("label", F.lit(other)).alias("label"), F.coalesce("n_positive", F.lit(0)).alias("n_positive"))
