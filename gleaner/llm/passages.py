"""Removal of passages that repeat, by a depth-limited radix sort of suffixes.

Suffixes need ordering only through their first ``LENGTH`` bytes: those equal that far are the repeated windows. Digits are
taken most significant first, and a suffix whose group has one member leaves:

1. The first digit is the least of the hashes of the window's ``GRAM``-byte grams, the leftmost of equals. Equal windows
   have equal ones at the same place, and neighbouring suffixes share theirs, so a run of suffixes with one such gram - an
   extent, some 170 starts - passes as one row.
2. The second digit is the extent's whole content. Extents of equal content are repeated with every suffix in them.
3. What is left of a group, extents that share the gram but not all of their bytes, is taken apart: one extent of each
   content in blocks of ``STEP`` suffixes. The digit of a block is its core, the bytes that its suffixes have in common; a
   block whose core occurs once leaves. Blocks that also share their hull, all bytes of all their suffixes, are repeated
   with every suffix in them.
4. What is left, blocks that share the core but not the hull, is taken apart into suffixes; their digit is all ``LENGTH``
   bytes.

Every byte that a repeated window covers is removed, judged on the input. Texts that occur twice repeat in full if they
are long enough. Groups are only counted, with partial sums, and never gathered, and of a gram that a task meets again
and again only the first two rows are dealt by it: a passage of any number of documents is no heavier in one task than in
another; a text's own spans are gathered for that text alone.

That orders suffixes no further than needed: a digit here is a hash of a part of the window that every suffix of a group
has in the same place, not its leading bytes one by one, and groups are told apart, not put in order.

Null text is empty. Texts below ``LENGTH`` bytes stay whole; longer ones are taken whole, in pieces that overlap. Repeated
rows, and rows of one doc_id, are documents of their own. An empty table gives no rows; other columns are not looked at. Digits are 64-bit hashes, the last two together 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, whole_text
from .shingles import _BASE, _BYTE, _INVERSE, as_bytes, mixed, parts, powers

LENGTH = 400
GRAM = 64
STEP = 32
_PIECE = 1 << 18

_tables: list[np.ndarray] = []


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the rolling hash, and the inverse powers that take a start's place out of a difference."""
    if not _tables or len(_tables[0]) <= len(data):
        _tables[:] = [powers(_BASE, len(data) + 1), powers(_INVERSE, len(data) + 1)]
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _tables[0][: len(data)]))), _tables[1]


def _hash(sums: np.ndarray, inverse: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((sums[end] - sums[start]) * inverse[start])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    n = len(x) - width + 1
    pad = -len(x) % width
    blocks = np.concatenate((x, np.full(pad, np.iinfo(x.dtype).max, x.dtype))).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def extents(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """text, first and last start and gram (in the text), gram digit and content digit of each extent of the texts."""
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 6
    sums, inverse = _sums(data)
    at = np.arange(len(data) - gram + 1)
    grams = _hash(sums, inverse, at, at + gram)
    least = _sliding_min((grams >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64), length - gram + 1) & np.uint64(0xFFFFFFFF)
    start = np.arange(len(least))
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    inside = start + length <= offsets[text + 1]
    start, text, least = start[inside], text[inside], least[inside].astype(np.int64)
    if not len(start):
        return (np.zeros(0, np.int64),) * 6
    new = np.ones(len(start), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    a, b = start[first], start[last]
    content = mixed(_hash(sums, inverse, a, b + length) ^ mixed((b - a).astype(np.uint64) << np.uint64(20) | (least[first] - a).astype(np.uint64)))
    begin = offsets[text[first]]
    return text[first], a - begin, b - begin, least[first] - begin, grams[least[first]].view(np.int64), content.view(np.int64)


def _pieces(column: pa.Array, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, bytes, offsets, where the bytes begin in the row); a long text comes in pieces that overlap."""
    for row, part in parts(column, _PIECE):
        data, offsets = as_bytes(part)
        if len(data) <= 2 * _PIECE:
            yield row, data, offsets, 0
            continue
        for i in range(0, len(data), _PIECE):
            piece = data[i : i + _PIECE + length - 1]
            yield row, piece, np.array([0, len(piece)]), i


_FIELD = 10  # bits of a place: first start, then last start and gram, counted from it


def _place(a: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:
    return (a << 2 * _FIELD) | (b - a) << _FIELD | (p - a)


def _unplace(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, part = place >> 2 * _FIELD, (1 << _FIELD) - 1
    return a, a + (place >> _FIELD & part), a + (place & part)


EXTENTS = "key binary, gram bigint, content bigint, place bigint, deal bigint"


def _extents_of(length: int, gram: int):
    """key, text -> the extents. deal: by what to deal a row; the gram for its first two rows in the task, then anything:
    these are known to repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        met: dict[int, int] = {}
        for batch in batches:
            keys = batch.column("key").to_pylist()
            new = []
            for i, k in enumerate(keys):
                if k not in seen:
                    seen.add(k)
                    new.append(i)
            texts = batch.column("text").take(pa.array(new, pa.int64()))
            own = pa.array([keys[i] for i in new], pa.binary())
            for row, data, offsets, begin in _pieces(texts, length):
                text, a, b, p, g, e = extents(data, offsets, length, gram)
                grams, where, count = np.unique(g, return_inverse=True, return_counts=True)
                before = np.array([met.get(x, 0) for x in grams.tolist()], np.int64)
                order = np.argsort(where, kind="stable")
                rank = np.empty(len(g), np.int64)
                rank[order] = np.arange(len(g)) - np.repeat(np.cumsum(count) - count, count)
                met.update(zip(grams.tolist(), np.minimum(before + count, 2).tolist(), strict=True))
                place = _place(a + begin, b + begin, p + begin)
                known = before[where] + rank >= 2
                anything = mixed(e.view(np.uint64) ^ mixed(place.view(np.uint64) + np.uint64(row))).view(np.int64) if len(g) else g
                yield pa.RecordBatch.from_arrays(
                    [own.take(pa.array(text + row)), pa.array(g), pa.array(e), pa.array(place), pa.array(np.where(known, anything, g))], ["key", "gram", "content", "place", "deal"]
                )

    return run


LEFT = "key binary, gram bigint, content bigint, place bigint"


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows by gram, those whose gram occurs again, and those that are known to."""
    held = None

    def done(rows: pa.Table) -> list[pa.RecordBatch]:
        g, d = rows.column("gram").to_numpy(), rows.column("deal").to_numpy()
        _, where, count = np.unique(g[g == d], return_inverse=True, return_counts=True)
        keep = g != d
        keep[g == d] = count[where] > 1
        return rows.select(["key", "gram", "content", "place"]).filter(pa.array(keep)).to_batches()

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        g = rows.column("gram").to_numpy()
        last = int(np.searchsorted(g, g[-1])) if len(g) else 0
        if last:
            yield from done(rows.slice(0, last))
        held = rows.slice(last)
    if held is not None:
        yield from done(held)


BLOCKS = "key binary, gram bigint, core bigint, hull bigint, a int, b int"


def _blocks_of(length: int, step: int):
    """key, text, apart (place, gram) -> the extents' blocks: starts a to b, and their digits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, apart, keys = (batch.column(c) for c in ("text", "apart", "key"))
            for i in range(len(batch)):
                if not apart[i].is_valid:
                    continue
                data, _ = as_bytes(texts.slice(i, 1))
                own = apart[i].values
                a, b, p = _unplace(own.field("place").to_numpy())
                low, high = (p - b) // step, (p - a) // step
                n = high - low + 1
                row = np.repeat(np.arange(len(n)), n)
                block = low[row] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                first, last = np.maximum(a[row], p[row] - block * step - step + 1), np.minimum(b[row], p[row] - block * step)
                inner = p[row] - block * step
                for begin in range(0, len(data), _PIECE):
                    some = np.flatnonzero((first >= begin) & (first < begin + _PIECE))
                    if not len(some):
                        continue
                    sums, inverse = _sums(data[begin : begin + _PIECE + length + step])
                    core = _hash(sums, inverse, inner[some] - begin, inner[some] - begin - step + 1 + length)
                    hull = _hash(sums, inverse, first[some] - begin, last[some] - begin + length) ^ mixed((inner[some] - first[some]).astype(np.uint64) << np.uint64(20) | (last[some] - first[some]).astype(np.uint64))
                    core = mixed(core + block[some].astype(np.uint64))
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(pa.array(np.full(len(some), i))), pa.array(own.field("gram").to_numpy()[row[some]]), pa.array(core.view(np.int64)), pa.array(mixed(hull).view(np.int64)),
                         pa.array(first[some].astype(np.int32)), pa.array(last[some].astype(np.int32))],
                        ["key", "gram", "core", "hull", "a", "b"],
                    )

    return run


SUFFIXES = "key binary, start int, gram bigint, window bigint"


def _suffixes_of(length: int):
    """key, text, spans (a, b, gram) -> each suffix that starts in a span, with the digit of its whole window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans, keys = (batch.column(c) for c in ("text", "spans", "key"))
            for i in range(len(batch)):
                data, _ = as_bytes(texts.slice(i, 1))
                own = spans[i].values
                a, b, gram = (own.field(k).to_numpy() for k in ("a", "b", "gram"))
                n = (b - a + 1).astype(np.int64)
                start = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
                gram = np.repeat(gram, n)
                for begin in range(0, len(data), _PIECE):
                    some = np.flatnonzero((start >= begin) & (start < begin + _PIECE))
                    if not len(some):
                        continue
                    sums, inverse = _sums(data[begin : begin + _PIECE + length])
                    window = mixed(_hash(sums, inverse, start[some] - begin, start[some] - begin + length) + np.uint64(1))
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(pa.array(np.full(len(some), i))), pa.array(start[some].astype(np.int32)), pa.array(gram[some]), pa.array(window.view(np.int64))], ["key", "start", "gram", "window"]
                    )

    return run


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the intervals; runs that touch are one."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
    return start[new], reach[np.append(new[1:], len(start)) - 1]


FOUND = "key binary, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:int,end:int>>"


def _removal_of(length: int):
    """key, text, places, apart, runs (a, b), starts -> FOUND. Extents that are not apart repeat whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, places, apart, runs, starts = (batch.column(c) for c in ("text", "places", "apart", "runs", "starts"))
            out = []
            for i in range(len(batch)):
                data, _ = as_bytes(texts.slice(i, 1))
                place = places[i].values.to_numpy()
                if apart[i].is_valid:
                    own = apart[i].values
                    place = np.setdiff1d(place, own.field("place").to_numpy()[own.field("alone").to_numpy(zero_copy_only=False)])
                a, b, _ = _unplace(place)
                first, last = [a], [b]
                if runs[i].is_valid:
                    first.append(runs[i].values.field("a").to_numpy())
                    last.append(runs[i].values.field("b").to_numpy())
                if starts[i].is_valid:
                    first.append(starts[i].values.to_numpy())
                    last.append(first[-1])
                a, b = merged(np.concatenate(first).astype(np.int64), np.concatenate(last).astype(np.int64) + length)
                kept = hashlib.sha256()
                at = 0
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    kept.update(data[at:x])
                    at = y
                kept.update(data[at:])
                out.append((int((b - a).sum()), len(a), kept.hexdigest(), [{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)]))
            columns = list(zip(*out, strict=True)) or [()] * 4
            types = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["key", "n_removed", "n_spans", "kept_sha256", "spans"])

    return run


def repeats(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, step: int = STEP) -> DataFrame:
    """(key, text) -> FOUND for each text of which something repeats beyond the text itself."""
    every = texts.mapInArrow(_extents_of(length, gram), EXTENTS)
    left = stored(every.repartition("deal").sortWithinPartitions("gram").mapInArrow(_again, LEFT), "passage-left")
    content = left.groupBy("gram", "content").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "place")).alias("one"))
    content = stored(content.select("gram", (F.col("n") == 1).alias("alone"), "one.*"), "passage-contents")
    mixed_grams = content.where("alone").select("gram").distinct()  # a gram occurs again: beside one content alone stands another
    apart = content.join(mixed_grams, "gram", "left_semi").groupBy("key").agg(F.collect_list(F.struct("place", "gram", "alone")).alias("apart"))
    found = left.groupBy("key").agg(F.collect_list("place").alias("places")).join(apart, "key", "left")
    held = stored(texts.dropDuplicates(["key"]).join(found, "key").select("key", "text", "places", "apart"), "passage-texts")
    blocks = stored(held.where("apart IS NOT NULL").select("key", "text", "apart").mapInArrow(_blocks_of(length, step), BLOCKS), "passage-blocks")
    hulls = blocks.groupBy("gram", "core", "hull").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "a", "b")).alias("one"))
    hulls = stored(hulls.select("gram", "core", "hull", "n", "one.*"), "passage-hulls")
    runs = blocks.join(hulls.where("n > 1").select("gram", "core", "hull"), ["gram", "core", "hull"], "left_semi").groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    cores = hulls.groupBy("gram", "core").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("gram", "core")
    spans = hulls.join(cores, ["gram", "core"], "left_semi").groupBy("key").agg(F.collect_list(F.struct("a", "b", "gram")).alias("spans"))
    suffix = stored(held.select("key", "text").join(spans, "key").mapInArrow(_suffixes_of(length), SUFFIXES), "passage-suffixes")
    twice = suffix.groupBy("gram", "window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram", "window")
    starts = suffix.join(twice, ["gram", "window"], "left_semi").groupBy("key").agg(F.collect_list("start").alias("starts"))
    marked = held.join(runs, "key", "left").join(starts, "key", "left")
    return marked.select("key", "text", "places", "apart", "runs", "starts").mapInArrow(_removal_of(length), FOUND)


def remove(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (of bytes, end exclusive); one row for
    each row of ``docs``."""
    if not length - (1 << _FIELD) < gram <= length or gram < 1:
        raise ValueError("the gram must be from 1 to the window's length, and at most 1,023 shorter")
    key = F.unhex(F.md5(whole_text()))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), key.alias("key"), F.octet_length(whole_text()).cast("bigint").alias("n_bytes"), F.sha2(whole_text().cast("binary"), 256).alias("whole"))
    found = repeats(docs.where(F.octet_length("text") >= length).select(key.alias("key"), "text"), length, gram)
    # a copy repeats in full, whatever else its text holds
    copies = rows.where(F.col("n_bytes") >= length).groupBy("key").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    state = found.join(copies, "key", "full_outer")
    rows = rows.join(state, "key", "left")
    copied = F.col("copies").isNotNull()
    all_of_it = F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("end")))
    return rows.select(
        "doc_id", "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copied, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(copied, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
        F.when(copied, all_of_it).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>"))).alias("spans"),
    )
