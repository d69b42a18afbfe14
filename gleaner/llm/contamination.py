"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A short item inside a long document has a Jaccard similarity near 0, so sizes are matched first. Items are partitioned by
their number of shingles n, [2^j, 2^(j+1)), and documents are seen through windows of 2^(j+2) shingles with a stride of
half that: a passage as long as any item of the partition lies in one window. Window and item are compared by a
one-permutation MinHash of ``BINS`` bins; a single equal minimum makes a candidate. A window's minimum can only equal an
item's if the shingle itself is one, so shingles are first looked up among the items' minima and windows are only reduced
where one is found. Items of up to ``FEW`` shingles have too few minima for that, as a smaller shingle beside them in the
window may hide one: any shingle in common makes them a candidate. Candidates are verified over the whole document: shared shingles / shingles of the item.

Up to MOST_ITEMS items of MOST_BYTES of text in all go to all tasks as an index, and documents are not shuffled. More items
are joined: of each distinct text, the shingles that pass a table of the items' minima, and are themselves minima of a
window, are joined with the minima; the texts of candidates are read once more to verify them.

An item of more than ``FEW`` shingles is a candidate unless smaller hashes of the text around hide all of its minima, of
which one is enough. Measured on items of 17, 20, 33, 64 and 200 shingles in four times as many others on either side: of
70,000 that were contained whole and 25,000 of which four fifths of the shingles were, none was missed. Items of one to four words are one shingle and match only texts of just these words.

Null or empty texts have no shingles and match nothing; repeated rows give repeated matches; very long texts are searched
whole; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored, tidy, whole_text
from .shingles import parts, shingles

THRESHOLD = 0.8
BINS = 64
FEW = 16
MOST_ITEMS, MOST_BYTES = 20_000, 64 << 20
_TABLE_BITS = 22
#: the partition of items of up to FEW shingles
_ANY = -1


class ItemIndex:
    """Items' shingles, and their minima by partition."""

    def __init__(self, ids: list, texts: pa.Array, bins: int = BINS) -> None:
        hashes, offsets = shingles(texts)
        self.ids: list = []
        self.sets: list[np.ndarray] = []
        self.bins = np.uint64(bins)
        minima: dict[int, list[tuple[int, int]]] = {}
        for i, key in enumerate(ids):
            own = np.unique(hashes[offsets[i] : offsets[i + 1]])
            if not len(own):
                continue
            _, first = np.unique(own % self.bins, return_index=True)  # own is sorted: the first of a bin is its minimum
            few = len(own) <= FEW
            minima.setdefault(_ANY if few else len(own).bit_length() - 1, []).extend((int(h), len(self.ids)) for h in (own if few else own[first]))
            self.ids.append(key)
            self.sets.append(own)
        self.parts = {}
        for j, pairs in minima.items():
            pairs.sort()
            self.parts[j] = np.array([h for h, _ in pairs], np.uint64), np.array([i for _, i in pairs])
        self.table = np.zeros(1 << _TABLE_BITS, dtype=bool)
        for keys, _ in self.parts.values():
            self.table[keys >> np.uint64(64 - _TABLE_BITS)] = True

    def candidates(self, hashes: np.ndarray, offsets: np.ndarray) -> set[tuple[int, int]]:
        """(row, item) pairs of which some window and the item have a minimum in common, or any shingle if the item has few."""
        found: set[tuple[int, int]] = set()
        at = np.flatnonzero(self.table[hashes >> np.uint64(64 - _TABLE_BITS)])
        row = np.searchsorted(offsets, at, "right") - 1
        for j, (keys, items) in self.parts.items():
            half = 1 << (j + 1)
            lo, hi = np.searchsorted(keys, hashes[at], "left"), np.searchsorted(keys, hashes[at], "right")
            for k in np.flatnonzero(hi > lo):
                r, h = int(row[k]), hashes[at[k]]
                new = [int(i) for i in items[lo[k] : hi[k]] if (r, int(i)) not in found]
                if j == _ANY:
                    found.update((r, i) for i in new)
                    continue
                if new and shows(hashes, int(offsets[r]), int(offsets[r + 1]), int(at[k]), half, self.bins):
                    found.update((r, i) for i in new)
        return found


def shows(hashes: np.ndarray, begin: int, end: int, at: int, half: int, bins: np.uint64) -> bool:
    """Whether one of the two windows (of two halves) of the text from begin to end that hold the shingle ``at`` has it as its
    bin's minimum."""
    h, window = hashes[at], (at - begin) // half
    for w in (window - 1, window):
        seen = hashes[begin + max(0, w) * half : min(end, begin + (w + 2) * half)]
        if w >= 0 and not np.any(seen[seen % bins == h % bins] < h):
            return True
    return False


SCHEMA = "doc_id bigint, item_id bigint, n_item bigint, n_shared bigint, containment double"


def _matches(docs: DataFrame, index: ItemIndex, threshold: float) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast((index.ids, index.sets, index.parts, index.table))
    bins = index.bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ItemIndex.__new__(ItemIndex)
        own.ids, own.sets, own.parts, own.table = held.value
        own.bins = bins
        for batch in batches:
            out: list[tuple] = []
            for first, part in parts(batch.column("text")):
                hashes, offsets = shingles(part)
                for r, i in sorted(own.candidates(hashes, offsets)):
                    shared = int(np.isin(own.sets[i], hashes[offsets[r] : offsets[r + 1]]).sum())
                    n = len(own.sets[i])
                    if shared >= threshold * n:
                        out.append((batch.column("doc_id")[first + r].as_py(), own.ids[i], n, shared, shared / n))
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "item_id", "n_item", "n_shared", "containment"])

    return docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "text").mapInArrow(run, SCHEMA)


def _index(items: DataFrame) -> ItemIndex | None:
    """Of all items, if they are few enough for one."""
    many = items.select(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    if many["n"] > MOST_ITEMS or many["bytes"] > MOST_BYTES:
        return None
    rows = items.selectExpr("CAST(item_id AS bigint) AS item_id", "text").toArrow()
    return ItemIndex(rows.column("item_id").to_pylist(), rows.column("text").combine_chunks())


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _minima_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item (key), text -> item, part and hash of each of its minima."""
    for batch in batches:
        own = ItemIndex(batch.column("item").to_pylist(), batch.column("text"))
        for j, (keys, of) in own.parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([own.ids[i] for i in of], pa.binary()), pa.array(np.full(len(of), j, np.int32)), pa.array(keys.view(np.int64))], ["item", "part", "hash"])


def _shown_of(held):
    """key, text -> key, part and hash of shingles that may be an item's minima and are a window's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, packed = held.value
        table, bins = np.unpackbits(packed).astype(bool), np.uint64(BINS)
        for batch in batches:
            for first, part in parts(batch.column("text")):
                hashes, offsets = shingles(part)
                at = np.flatnonzero(table[hashes >> np.uint64(64 - _TABLE_BITS)])
                row = np.searchsorted(offsets, at, "right") - 1
                out = {(int(r), j, int(hashes[k].view(np.int64))) for r, k in zip(row, at, strict=True) for j in kinds if j == _ANY or shows(hashes, int(offsets[r]), int(offsets[r + 1]), int(k), 1 << (j + 1), bins)}
                rows = list(zip(*out, strict=True)) or [()] * 3
                keys = batch.column("key").take(pa.array([first + r for r in rows[0]], pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64())], ["key", "part", "hash"])
        tidy()

    return run


def _verified_of(threshold: float):
    """key, text, item, wanted (text) -> key, item, n_item, n_shared of the pairs that match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            (a, at), (b, bt) = (shingles(batch.column(c)) for c in ("text", "wanted"))
            for i in range(len(batch)):
                need = np.unique(b[bt[i] : bt[i + 1]])
                shared = int(np.isin(need, a[at[i] : at[i + 1]]).sum())
                if len(need) and shared >= threshold * len(need):
                    out.append((i, len(need), shared))
            rows = list(zip(*out, strict=True)) or [()] * 3
            some = pa.array(rows[0], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key").take(some), batch.column("item").take(some), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64())], ["key", "item", "n_item", "n_shared"])
        tidy()

    return run


def _joined(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """Matches of distinct texts: key and item (md5 of the texts), n_item, n_shared."""
    items = stored(items.where(F.octet_length("text") > 0).select(_key(F.col("text")).alias("item"), "text").dropDuplicates(["item"]), "items")
    texts = docs.where(F.octet_length("text") > 0).select(_key(F.col("text")).alias("key"), "text").dropDuplicates(["key"])
    minima = stored(items.mapInArrow(_minima_of, "item binary, part int, hash bigint"), "item-minima")
    table = np.zeros(1 << _TABLE_BITS, dtype=bool)
    place = F.shiftrightunsigned("hash", 64 - _TABLE_BITS).cast("int").alias("place")
    table[minima.select(place).distinct().toArrow().column(0).to_numpy()] = True  # at most 2^22 rows
    kinds = [r["part"] for r in minima.select("part").distinct().collect()]  # at most 64
    held = docs.sparkSession.sparkContext.broadcast((kinds, np.packbits(table)))
    shown = texts.mapInArrow(_shown_of(held), "key binary, part int, hash bigint")
    pairs = stored(shown.join(minima, ["part", "hash"]).select("key", "item").distinct(), "item-candidates")
    both = texts.join(pairs, "key").join(items.withColumnRenamed("text", "wanted"), "item")
    return stored(both.select("key", "text", "item", "wanted").mapInArrow(_verified_of(threshold), "key binary, item binary, n_item bigint, n_shared bigint"), "item-matches")


def search(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text), (item_id, text) -> doc_id, item_id, n_item, n_shared, containment of each match."""
    if (index := _index(items)) is not None:
        return _matches(docs, index, threshold)
    found = _joined(docs, items, threshold)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _key(whole_text()).alias("key")).join(found, "key")
    rows = rows.join(items.select(F.col("item_id").cast("bigint").alias("item_id"), _key(whole_text()).alias("item")), "item")
    return rows.select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def remove(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that hold an item; all of their columns."""
    if (index := _index(items)) is not None:
        return _without(docs, index, threshold)
    key, = fresh(docs, "_key")
    gone = _joined(docs, items, threshold).select(F.col("key").alias(key)).distinct()
    return docs.withColumn(key, _key(whole_text())).join(gone, key, "left_anti").drop(key).select(*(F.col(f"`{c}`") for c in docs.columns))


def _without(docs: DataFrame, index: ItemIndex, threshold: float) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast((index.ids, index.sets, index.parts, index.table))
    bins, place = index.bins, docs.columns.index(next(c for c in docs.columns if c.lower() == "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ItemIndex.__new__(ItemIndex)
        own.ids, own.sets, own.parts, own.table = held.value
        own.bins = bins
        for batch in batches:
            keep = np.ones(len(batch), dtype=bool)
            for first, part in parts(batch.column(place)):
                hashes, offsets = shingles(part)
                for r, i in own.candidates(hashes, offsets):
                    if np.isin(own.sets[i], hashes[offsets[r] : offsets[r + 1]]).sum() >= threshold * len(own.sets[i]):
                        keep[first + r] = False
            yield batch.filter(pa.array(keep))
        tidy()

    return docs.mapInArrow(run, docs.schema)
