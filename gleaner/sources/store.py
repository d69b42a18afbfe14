"""The index in Parquet, in segments.

A write adds one segment - its documents, its postings (range-partitioned and sorted by term, so that a search reads the row
groups of its terms alone), its terms' document frequencies and the ids that it takes out of earlier segments - and one row of
the manifest, with which it becomes visible. The row names the live segments and holds the sums of the whole: number of
documents, length, last id, and the last batch of each stream that is in. So a write costs what it adds, whatever the store
holds; a replaced document's frequencies are subtracted by the segment that replaces it. ``compact`` makes one segment of all.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import combined_text, length, term_counts
from gleaner.operators.dedup import digest
from gleaner.operators.index import Index, assign_ids

from .scratch import small_enough, stored

DOCS = "doc_id bigint, url string, title string, text string, length bigint, content_hash string, fetched_at timestamp"
POSTINGS = "doc_id bigint, term string, tf int, positions array<int>, length int"
TERMS = "term string, df bigint"
GONE = "doc_id bigint"
MANIFEST = "version bigint, segments array<string>, n_docs bigint, total_length bigint, last_id bigint, replaces array<string>, batches map<string,bigint>"
_EMPTY = {"version": 0, "segments": [], "n_docs": 0, "total_length": 0, "last_id": 0, "replaces": [], "batches": {}}
#: Replaced ids up to which they are broadcast to the readers of documents and postings.
BROADCAST_GONE = 1_000_000


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    path: str

    def manifest(self) -> dict:
        """The current row; that of an empty store if nothing was ever written."""
        try:
            row = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest").orderBy(F.desc("version")).first()
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            row = None
        return _EMPTY if row is None else row.asDict()

    def _read(self, kind: str, schema: str, segments: list[str]) -> DataFrame:
        """The rows of some segments, with the segment's name."""
        if not segments:
            return self.spark.createDataFrame([], f"{schema}, segment string")
        return self.spark.read.schema(f"{schema}, segment string").option("basePath", f"{self.path}/{kind}").parquet(*(f"{self.path}/{kind}/segment={s}" for s in segments))

    def _write(self, new: Index, now: dict, keep: list[str], gone: DataFrame | None = None, taken: tuple[int, int] = (0, 0), lost: DataFrame | None = None, batch: tuple[str, int] | None = None) -> None:
        """``new`` as a segment after those to ``keep``. gone: ids that it takes out of them, with ``taken`` documents and their
        length, and ``lost`` (term, df) their terms."""
        version = now["version"] + 1
        name = f"{version:012d}-{uuid.uuid4().hex[:8]}"
        at = {kind: f"{self.path}/{kind}/segment={name}" for kind in ("docs", "postings", "terms", "gone")}
        new.docs.select(*_names(DOCS)).write.option("compression", "zstd").parquet(at["docs"])
        new.postings.select(*_names(POSTINGS)).repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.option("compression", "zstd").parquet(at["postings"])
        own = self.spark.read.schema(POSTINGS).parquet(at["postings"])
        terms = own.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        if lost is not None:
            terms = terms.unionByName(lost.select("term", (-F.col("df")).alias("df"))).groupBy("term").agg(F.sum("df").alias("df"))
        terms.repartitionByRange("term").sortWithinPartitions("term").write.option("compression", "zstd").parquet(at["terms"])
        if gone is not None:
            gone.select("doc_id").write.option("compression", "zstd").parquet(at["gone"])
        added = self.spark.read.schema(DOCS).parquet(at["docs"]).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length"), F.coalesce(F.max("doc_id"), F.lit(0)).alias("last")).first()
        base = now if keep else _EMPTY
        row = {
            "version": version, "segments": [*keep, name], "n_docs": base["n_docs"] + added["n"] - taken[0], "total_length": base["total_length"] + added["length"] - taken[1],
            "last_id": max(base["last_id"], added["last"]), "replaces": [*base["replaces"], *([] if gone is None else [name])], "batches": {**now["batches"], **({batch[0]: batch[1]} if batch else {})},
        }
        self.spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    @staticmethod
    def _stamped(new: Index) -> Index:
        docs = new.docs.withColumn("content_hash", digest(F.col("text")))
        return Index(docs if "fetched_at" in docs.columns else docs.withColumn("fetched_at", F.current_timestamp()), new.postings)

    @staticmethod
    def _measured(docs: DataFrame) -> DataFrame:
        """docs (title, text) with their lengths, counted beside the texts, which need no shuffle for it."""
        return docs.withColumn("length", length(combined_text(F.col("title"), F.col("text"))))

    def save(self, index: Index) -> None:
        """``index`` in place of all."""
        self._write(self._stamped(index), self.manifest(), [])

    def load(self) -> Index:
        """The current version, read lazily."""
        now = self.manifest()
        segments = now["segments"]
        docs, postings, terms = (self._read(kind, schema, segments) for kind, schema in (("docs", DOCS), ("postings", POSTINGS), ("terms", TERMS)))
        if now["replaces"]:
            gone = self._read("gone", GONE, now["replaces"]).groupBy("doc_id").agg(F.max("segment").alias("_since"))
            gone = F.broadcast(gone) if small_enough(gone, BROADCAST_GONE) else gone
            docs, postings = (df.join(gone, "doc_id", "left").where(F.col("_since").isNull() | (F.col("segment") >= F.col("_since"))) for df in (docs, postings))
        if len(segments) > 1:
            terms = terms.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        totals = self.spark.createDataFrame([(now["n_docs"], now["total_length"], now["total_length"] / now["n_docs"] if now["n_docs"] else 0.0)], "n_docs bigint, total_length bigint, avgdl double")
        return Index(docs.select(*_names(DOCS)), postings.select(*_names(POSTINGS)), terms.select("term", "df"), totals)

    def scan(self) -> DataFrame:
        """Documents in the order of their ids."""
        return self.load().docs.orderBy("doc_id")

    def next_id(self) -> int:
        return self.manifest()["last_id"] + 1

    def last_batch(self, stream: str) -> int:
        """The last batch of a stream that is in; -1 if none is."""
        return self.manifest()["batches"].get(stream, -1)

    def append(self, docs: DataFrame, order: str, batch: tuple[str, int] | None = None) -> int:
        """docs (url, title, text): new ids after those of the store, whatever their URLs; the number of documents. batch:
        stream and number of the batch that they are; it becomes visible with them."""
        now = self.manifest()
        new = Index.build(assign_ids(self._measured(docs), order, now["last_id"]), partial(stored, label="postings"))
        self._write(self._stamped(new), now, now["segments"], batch=batch)
        return self.manifest()["n_docs"] - now["n_docs"]

    def upsert(self, docs: DataFrame, order: str) -> None:
        """docs (url, title, text): a known URL keeps its id and gets the new content, its old postings and their share of the
        frequencies go. The last of several rows of a URL counts."""
        now, old = self.manifest(), self.load()
        last = stored(docs.groupBy("url").agg(F.max_by(F.struct("title", "text", order), order).alias("d")).select("url", "d.*"), "upsert")
        # ids without texts first; the new texts then move once, to their ids
        known = stored(old.docs.select("url", "doc_id", "length").join(last.select("url"), "url", "left_semi"), "upsert-known")
        fresh = assign_ids(last.select("url", order).join(known.select("url"), "url", "left_anti"), order, now["last_id"])
        ids = known.select(F.col("url").alias("_url"), "doc_id").unionByName(fresh.select(F.col("url").alias("_url"), "doc_id"))
        new = Index.build(stored(self._measured(last.join(ids, F.col("url").eqNullSafe(F.col("_url")))).select("doc_id", "url", "title", "text", "length"), "docs"), partial(stored, label="postings"))
        taken = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first()
        replaced = old.docs.join(known.select("doc_id"), "doc_id", "left_semi")
        lost = term_counts(replaced.select(combined_text(F.col("title"), F.col("text")).alias("text"))).groupBy("term").agg(F.sum("df").alias("df"))
        self._write(self._stamped(new), now, now["segments"], known.select("doc_id"), (taken["n"], taken["length"]), lost)

    def clear(self) -> None:
        """An empty version; ids start again at 1."""
        self._write(Index(self.spark.createDataFrame([], DOCS), self.spark.createDataFrame([], POSTINGS)), self.manifest(), [])

    def compact(self) -> None:
        """One segment of all; ids stay."""
        self.save(self.load())

    def counts(self) -> DataFrame:
        return counts(self.load())


def counts(index: Index) -> DataFrame:
    """(name, n): rows of documents, terms and postings."""
    parts = (("documents", index.docs), ("terms", index.terms), ("postings", index.postings))
    out = None
    for name, df in parts:
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out
