"""The inverted index as plain tables.

postings (term, doc_id, tf, positions), docs (doc_id, url, title, text, length), terms (term, df) and one row of corpus
statistics. Document ids follow ingest order; length is the number of tokens without stopwords; a document without tokens
is in docs, counts in the statistics and has no postings.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import combined_text, postings
from gleaner.sources.scratch import stored


def doc_lengths(docs: DataFrame, posted: DataFrame) -> DataFrame:
    """(doc_id, length), 0 where a document has no postings."""
    sums = posted.groupBy("doc_id").agg(F.sum("tf").alias("length"))
    return docs.select("doc_id").join(sums, "doc_id", "left").select("doc_id", F.coalesce("length", F.lit(0)).cast("bigint").alias("length"))


def doc_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: n_docs, total_length, avgdl (0.0 if there are no documents)."""
    return lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_length")).withColumn(
        "avgdl", F.coalesce(F.try_divide(F.col("total_length").cast("double"), F.col("n_docs").cast("double")), F.lit(0.0))
    )


def vocabulary_size(posted: DataFrame) -> DataFrame:
    return posted.agg(F.count_distinct("term").alias("unique_terms"))


def assign_ids(docs: DataFrame, order: str, start: int = 0, id_column: str = "doc_id") -> DataFrame:
    """Ids start + 1, start + 2, ... in the order of ``order``.

    A range partitioning gives each partition its share of the order; places within partitions and the partitions' first
    numbers make the ids, so that no task sees all rows. The rows are sorted and numbered where the ranges put them, and
    stored with their places: they are shuffled once."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()  # the partition, and below it 33 bits of the place in it
    dealt = stored(docs.repartitionByRange(n, F.col(order)).sortWithinPartitions(order).withColumn("_at", at), "ranges")
    dealt = dealt.withColumn("_part", F.shiftright("_at", 33))
    starts = _starts(dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")))
    return dealt.join(F.broadcast(starts), "_part").withColumn(id_column, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + start + 1).drop("_part", "_at", "_start")


def _starts(sums: DataFrame) -> DataFrame:
    """sums (_part, _n), a row for each partition -> (_part, _start): what lies before each."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))


def in_ranges(df: DataFrame, order: str, amount: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(``df`` with _part, in ranges of ``order``; and _part, _start: the amount, one for each row, before each range).

    The rows are stored with their range, as bounds come from samples and a second run may draw others. The starts are a
    row for each partition."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.repartitionByRange(n, F.col(order)).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("_part").agg(F.sum(F.lit(1) if amount is None else amount).alias("_n"))
    return dealt, _starts(sums)


@dataclass(frozen=True)
class Index:
    """df, totals: document frequencies and the row of statistics where they are stored; else they are counted."""

    docs: DataFrame
    postings: DataFrame
    df: DataFrame | None = None
    totals: DataFrame | None = None

    @classmethod
    def build(cls, docs: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> Index:
        """docs: doc_id, url, title, text; absent columns are empty. keep: stores the postings and gives them back, so that
        lengths and searches do not analyse the texts again. A length that docs have is taken; else the postings' sums are
        joined, for which the texts are shuffled."""
        have = set(docs.columns)
        docs = docs.withColumns({c: F.lit("") for c in ("url", "title") if c not in have})
        posted = keep(postings(docs.select("doc_id", combined_text(F.col("title"), F.col("text")).alias("text"))))
        docs = docs if "length" in have else docs.join(doc_lengths(docs, posted), "doc_id")
        return cls(docs.select("doc_id", "url", "title", "text", "length"), posted)

    @property
    def terms(self) -> DataFrame:
        return doc_frequency(self.postings) if self.df is None else self.df

    @property
    def stats(self) -> DataFrame:
        return corpus_stats(self.docs) if self.totals is None else self.totals

    def add(self, other: Index) -> Index:
        """The union; the other's ids must be new."""
        return Index(self.docs.unionByName(other.docs), self.postings.unionByName(other.postings))

    def restore(self, docs: DataFrame) -> Index:
        """docs (doc_id, url, title, text) under the ids that they had; what the index holds under these ids goes."""
        back, gone = Index.build(docs.drop("length")), docs.select("doc_id")
        return Index(*(own.join(gone, "doc_id", "left_anti").select(new.columns) for own, new in ((self.docs, back.docs), (self.postings, back.postings)))).add(back)


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` whose doc_id is in ``b``."""
    return a.join(b.select("doc_id"), "doc_id", "left_semi")


def intersect_all(lists: list[DataFrame]) -> DataFrame:
    """doc_ids that all lists hold: one aggregate instead of a chain of joins."""
    every = reduce(DataFrame.unionByName, (x.select("doc_id", F.lit(i).alias("g")) for i, x in enumerate(lists)))
    return every.groupBy("doc_id").agg(F.count_distinct("g").alias("n")).where(F.col("n") == len(lists)).select("doc_id")


def unite_all(lists: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, (x.select("doc_id") for x in lists)).distinct()
