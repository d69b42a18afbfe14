"""N-gram Jaccard self-join with Bayesian candidate pruning.

Documents are sets of word shingles; a link joins two documents whose sets have a Jaccard similarity of ``threshold`` or
more. Rows of one shingle set are copies: they are one node, however many.

1. Each set gets ``BANDS * ROWS`` MinHash values; sets that agree in a whole band fall in one bucket. At a similarity of
   0.8 a pair agrees in no band with a probability of 1.3e-7.
2. Every set of a bucket is tied to the bucket's least set. The components of these ties, which are as many as the
   buckets' members and not their pairs, hold every pair of a bucket.
3. A component is cut into chunks; each pair of chunks is a block, so no task holds a large component. In a block, MinHash
   values are compared ``STEP`` at a time; a pair leaves once the posterior probability (uniform prior) that it reaches the
   threshold is below ``TOLERANCE``. The pairs left are verified exactly on their shingles.
4. A block gives for each set the number of its links and one tie to the least set that it reaches in the block: rows as
   many as its sets, with no link lost. Ties give the classes, sums the numbers.

Texts without words link to nothing and are classes of their own. Null texts are empty. Null doc_ids are counted; a class
of null doc_ids alone has a null id. Repeated rows are copies of each other. Very long texts are sets like others. An empty
table gives no rows, and columns of the caller, whatever their names, come back as they are or are not looked at.

What this costs: within a component all pairs of sets are compared (by signature, STEP values first), as the number of links
of each is asked for. A component is a class of near copies and what ties chain to it; so a class of n different texts takes
work in proportion to n squared, in blocks of bounded size over all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored, tidy, whole_text
from .components import components
from .shingles import mixed, parts, shingles

THRESHOLD = 0.8
BANDS, ROWS = 40, 5
STEP = 40
TOLERANCE = 1e-6
#: Sets of a chunk: CHUNK while that makes at most FEW chunks, at most LARGE sets and LARGE_BYTES of text in any case.
CHUNK, FEW, LARGE, LARGE_BYTES = 64, 32, 2048, 16 << 20
_TILE = 128
_WIDE = 1 << 16

_rng = np.random.default_rng(41)
_A = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_BAND = _rng.integers(0, 2**63, (ROWS + 1, BANDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def distinct_sets(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's shingles sorted and without repeats, and the new offsets."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    first = np.ones(len(hashes), dtype=bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[first], np.concatenate(([0], np.cumsum(np.bincount(row[first], minlength=len(offsets) - 1))))


def _by_row(ufunc: np.ufunc, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """ufunc over each row's values; rows must not be empty."""
    return ufunc.reduceat(values, offsets[:-1]) if len(values) else values[:0]


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash values (rows, BANDS * ROWS) of rows that are not empty."""
    out = np.empty((len(offsets) - 1, len(_A)), np.uint32)
    narrow = (hashes >> np.uint64(32)).astype(np.uint32)
    for k in range(len(_A)):
        out[:, k] = _by_row(np.minimum, narrow * _A[k] + _B[k], offsets)
    return out


def band_hashes(signature: np.ndarray) -> np.ndarray:
    values = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    total = np.broadcast_to(_BAND[ROWS], (len(signature), BANDS)).copy()
    for r in range(ROWS):
        total += mixed(values[:, :, r] + np.uint64(r)) * _BAND[r]
    return mixed(total).view(np.int64)


def set_ids(hashes: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    one = _by_row(np.add, mixed(hashes), offsets)
    two = _by_row(np.add, mixed(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)) * np.uint64(0x9E3779B97F4A7C15), offsets)
    return [a + b for a, b in zip((x.tobytes() for x in one.byteswap()), (x.tobytes() for x in two.byteswap()), strict=True)]


NODES = "doc_id bigint, key binary, set_id binary, n_shingles bigint, bands array<bigint>"


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, key, text -> NODES; bands only for the first row of a set in the task."""
    seen: set[bytes] = set()
    for batch in batches:
        n = len(batch)
        ids: list[bytes | None] = [None] * n
        count = np.zeros(n, np.int64)
        bands: list[np.ndarray | None] = [None] * n
        for first, part in parts(batch.column("text")):
            hashes, offsets = distinct_sets(*shingles(part))
            size = np.diff(offsets)
            count[first : first + len(part)] = size
            some = np.flatnonzero(size)
            if not len(some):
                continue
            starts = np.append(offsets[some], offsets[-1])
            own = set_ids(hashes, starts)
            new = []
            for k, (i, s) in enumerate(zip(some, own, strict=True)):
                ids[first + int(i)] = s
                if s not in seen:
                    seen.add(s)
                    new.append(k)
            if new:
                at = np.array(new)
                lengths = size[some[at]]
                inner = np.repeat(starts[at] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
                for k, row in zip(new, band_hashes(signatures(hashes[inner], np.append(0, np.cumsum(lengths)))), strict=True):
                    bands[first + int(some[k])] = row
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("key"), pa.array(ids, pa.binary()), pa.array(count), pa.array(bands, pa.list_(pa.int64()))],
            ["doc_id", "key", "set_id", "n_shingles", "bands"],
        )
    tidy()


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For n values compared, the number of matches below which the posterior of reaching the threshold is too small."""
    out = {}
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        tail, m = 0.0, 0
        for m in range(n + 1):  # P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m)
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
        out[n] = m
    return out


def _likely(a: np.ndarray, b: np.ndarray, least: dict[int, int], upper: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two signature matrices that no comparison has pruned; ``upper``: both are the same rows."""
    matches = np.zeros((len(a), len(b)), np.int16)
    for k in range(STEP):
        matches += a[:, k, None] == b[None, :, k]
    keep = matches >= least[STEP]
    if upper:
        keep &= np.triu(np.ones_like(keep), 1)
    i, j = np.nonzero(keep)
    m = matches[i, j].astype(np.int64)
    for n in range(2 * STEP, BANDS * ROWS + 1, STEP):
        m += (a[i, n - STEP : n] == b[j, n - STEP : n]).sum(axis=1)
        keep = m >= least[n]
        i, j, m = i[keep], j[keep], m[keep]
    return i, j


def _verified(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs reach the threshold, by their exact intersections."""
    size = np.array([len(s) for s in sets])
    rows, shared = np.unique(np.concatenate((i, j))), np.zeros(len(i), np.int64)
    if len(i) > 2 * len(rows):
        place = np.searchsorted(rows, np.arange(len(sets)))
        values, where = np.unique(np.concatenate([sets[r] for r in rows]), return_inverse=True)
        own = np.repeat(np.arange(len(rows)), size[rows])
        order = np.argsort(where, kind="stable")
        own, where = own[order], where[order]
        every = np.zeros((len(rows), len(rows)), np.float64)
        for first in range(0, len(values), _WIDE):  # so many distinct shingles at a time, whatever the sets' sizes
            a, b = np.searchsorted(where, (first, first + _WIDE))
            held = np.zeros((len(rows), min(_WIDE, len(values) - first)), np.float32)
            held[own[a:b], where[a:b] - first] = 1
            every += held @ held.T
        shared = every[place[i], place[j]].astype(np.int64)
    else:
        for k, (a, b) in enumerate(zip(i, j, strict=True)):
            shared[k] = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
    return shared >= threshold * (size[i] + size[j] - shared) - 1e-9


def links(hashes: np.ndarray, offsets: np.ndarray, side: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links among the sets of a block: between its two chunks (side 0 and 1), or within it if all are on side 0."""
    signature = signatures(hashes, offsets)
    sets = [hashes[offsets[k] : offsets[k + 1]] for k in range(len(side))]
    least = least_matches(threshold, TOLERANCE)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    alone = not len(right)
    right = left if alone else right
    out_i, out_j = [], []
    for p in range(0, len(left), _TILE):
        for q in range(p if alone else 0, len(right), _TILE):
            a, b = left[p : p + _TILE], right[q : q + _TILE]
            i, j = _likely(signature[a], signature[b], least, alone and p == q)
            if len(i):
                some = np.concatenate((a, b))
                good = _verified([sets[r] for r in some], i, j + len(a), threshold) if not (alone and p == q) else _verified([sets[r] for r in a], i, j, threshold)
                out_i.append(a[i[good]])
                out_j.append(b[j[good]])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(out_i or none), np.concatenate(out_j or none)


def least_reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes reaches over the pairs."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


TIES = "set_id binary, n_texts bigint, n_docs bigint, tie binary"


def _blocks(threshold: float):
    def block(rows: list[tuple]) -> list[tuple]:
        rows.sort(key=lambda r: r[1])
        hashes, offsets = distinct_sets(*shingles(pa.array([r[3] for r in rows], pa.large_string())))
        i, j = links(hashes, offsets, np.array([r[2] for r in rows]), threshold)
        if not len(i):
            return []
        many = np.array([r[4] for r in rows])
        texts, docs = np.bincount(i, minlength=len(rows)) + np.bincount(j, minlength=len(rows)), np.zeros(len(rows), np.int64)
        np.add.at(docs, i, many[j])
        np.add.at(docs, j, many[i])
        root = least_reached(len(rows), i, j)
        return [(r[1], int(texts[k]), int(docs[k]), rows[root[k]][1]) for k, r in enumerate(rows) if texts[k]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("block", "set_id", "side", "text", "n_rows")), strict=True):
                if held and held[0][0] != row[0]:
                    out += block(held)
                    held = []
                held.append(row)
            yield _ties(out)
        yield _ties(block(held) if held else [])
        held.clear()
        tidy()

    return run


def _ties(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["set_id", "n_texts", "n_docs", "tie"])


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def nodes(docs: DataFrame) -> DataFrame:
    """NODES of each row, stored."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _key(whole_text()).alias("key"), whole_text().alias("text"))
    return stored(rows.mapInArrow(_nodes, NODES), "ngram-nodes")


def classes(docs: DataFrame, node: DataFrame, threshold: float) -> DataFrame:
    """set_id, root (the least set of its class), n_texts, n_docs (links to other sets, and their rows) of each set that
    has a link. Stored."""
    short = F.conv(F.hex(F.substring("set_id", 1, 8)), 16, -10).cast("bigint")
    member = node.where("bands IS NOT NULL").select(short.alias("sid"), F.explode("bands").alias("bucket"))
    bucket = member.groupBy("bucket").agg(F.min("sid").alias("b"), F.max("sid").alias("_most")).where("b < _most").select("bucket", "b")
    ties = member.join(bucket, "bucket").where("sid <> b").select(F.col("sid").alias("a"), "b").distinct()
    cluster = components(ties).select(F.col("id").alias("sid"), F.col("root").alias("cluster"))
    sets = node.where("n_shingles > 0").groupBy("set_id").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n_rows"), F.max("n_shingles").alias("n_shingles"))
    sets = stored(sets.withColumn("sid", short).join(cluster, "sid"), "ngram-sets")
    size = sets.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), (F.sum("n_shingles") * 8).alias("bytes"))
    chunks = F.greatest(F.least(F.ceil(F.col("n") / CHUNK), F.lit(FEW)), F.ceil(F.col("n") / LARGE), F.ceil(F.col("bytes") / LARGE_BYTES)).cast("int")
    sets = sets.join(size.select("cluster", chunks.alias("chunks")), "cluster")
    sets = sets.withColumn("chunk", F.pmod(F.xxhash64("set_id"), "chunks").cast("int"))
    text = docs.select(whole_text().alias("text")).withColumn("key", _key(F.col("text"))).dropDuplicates(["key"])
    sets = text.join(sets, "key")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    spread = sets.withColumn("other", other).select(
        F.xxhash64("cluster", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("block"), "set_id",
        (F.col("chunk") > F.col("other")).cast("int").alias("side"), (F.col("chunk") == F.col("other")).alias("same"), "text", "n_rows",
    )
    # a block is named by 64 bits; should two share a name, they are compared as one, which loses nothing
    spread = spread.repartition("block").sortWithinPartitions("block")
    ties = stored(spread.select("block", "set_id", "side", "text", "n_rows").mapInArrow(_blocks(threshold), TIES), "ngram-ties")
    found = ties.groupBy("set_id").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_docs").alias("n_docs"))
    root = components(ties.select(F.col("set_id").alias("a"), F.col("tie").alias("b")))
    return stored(found.join(root.withColumnRenamed("id", "set_id"), "set_id"), "ngram-classes")


def join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text) -> doc_id, class_id (the least doc_id of its class), n_links (other rows that it links to),
    n_text_links (other shingle sets), n_shingles; one row for each row of ``docs``."""
    node = nodes(docs)
    found = classes(docs, node, threshold)
    sets = node.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n_rows"))
    sets = sets.join(found, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    first = sets.groupBy("root").agg(F.min("first").alias("class_id"))
    sets = sets.join(first, "root").select(
        "set_id", "class_id", (F.coalesce("n_docs", F.lit(0)) + F.col("n_rows") - 1).alias("n_links"), F.coalesce("n_texts", F.lit(0)).alias("n_text_links")
    )
    return node.select("doc_id", "set_id", "n_shingles").join(sets, "set_id", "left").select(
        "doc_id", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_text_links", F.lit(0)).alias("n_text_links"), "n_shingles",
    )


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class of ``docs``, that of the least doc_id (nulls last, then by text); rows without words all stay."""
    node = nodes(docs)
    found = classes(docs, node, threshold)
    worded = node.where("set_id IS NOT NULL").join(found.select("set_id", "root"), "set_id", "left")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    kept = worded.groupBy(F.coalesce("root", "set_id").alias("root")).agg(F.min(order).alias("o"))
    key, id_, none = fresh(docs, "_key", "_id", "_none")
    rows = docs.withColumns({key: _key(whole_text()), id_: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)), none: F.col("doc_id").isNull()})
    has_words = whole_text().rlike(r"[^\x09-\x0d\x1c-\x20]")
    kept = kept.select(F.col("o.key").alias(key), F.coalesce("o.doc_id", F.lit(-1)).alias(id_), F.col("o.none").alias(none))
    one = rows.where(has_words).dropDuplicates([key, id_, none]).join(kept, [key, id_, none], "left_semi")
    return one.unionByName(rows.where(~has_words)).select(*(F.col(f"`{c}`") for c in docs.columns))
