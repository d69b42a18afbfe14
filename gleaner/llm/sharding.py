"""Sharding by vector bin packing.

Rows of one text form a group. The vector of a group is (bytes, tokens, rows), each as a share of the whole. Groups go
one by one, the largest first, to the shard where the dot product with the shard's residual capacity is highest.

Every group is packed so, whatever the input's size: groups are dealt by hash to cells of some ``per_cell``, and each cell is
packed in a task of its own into its part of the shards' capacity (cells number their shards from another one each, so that
what each rounds off does not add up). A group too large to be placed whole without upsetting the balance (over 1 / ``whole``
of a total, an eighth of a shard) is split into pieces, which are packed like groups. In the end the shards' sums are known,
and some of a bounded number of groups (``movable``) are moved from the fullest shards to the emptiest, so the bytes come
out near equal: the law is ``bytes``.

Rows of frequent texts (1 / ``frequent`` of a total or more, 3 * ``frequent`` texts at most) learn their shard by broadcast,
the others by a join on the text.

Slots are numbered in cells of (shard, hash of doc_id), whose counts give each cell its first slot; no shard is sorted in
one task. Null text has no bytes (size 1) and is a group with the empty texts; null and repeated doc_ids, and repeated rows,
are numbered like others; texts count whole, however long; an empty table gives an empty result. Pieces and slots go by the
numbers that rows get when they are first written, not by doc_id, which may be null or the same in all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, whole_text
from .mixing import n_tokens


@dataclass(frozen=True)
class ShardParams:
    shards: int = 16
    whole: int = 128
    frequent: int = 4096
    per_cell: int = 20_000
    movable: int = 4096
    rows_per_cell: int = 200_000
    min_cells: int = 16


SIZES = ("bytes", "tokens", "rows")


def shares(vectors: np.ndarray) -> np.ndarray:
    total = vectors.sum(axis=0)
    return vectors / np.where(total > 0, total, 1)


def pack(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item. vectors: (items, dimensions) of sizes; each dimension counts as a share of its total."""
    share = shares(vectors)
    residual = np.full((shards, vectors.shape[1]), 1.0 / shards)
    out = np.zeros(len(vectors), dtype=np.int32)
    for i in np.lexsort((np.arange(len(vectors)), -share.max(axis=1, initial=0))):
        out[i] = best = int(np.argmax(residual @ share[i]))
        residual[best] -= share[i]
    return out


def level(load: np.ndarray, share: np.ndarray, where: np.ndarray) -> dict[int, int]:
    """{item: new shard}: as long as that brings them closer, the item that leaves the fullest and the emptiest shard the
    closest goes from one to the other, bytes counting four times as much as the rest. load: (shards, dimensions) with all
    items; share, where: of the items that may move."""
    load, where, moved = load.copy(), where.copy(), {}
    weight = np.array([4.0, *[1.0] * (load.shape[1] - 1)])
    while True:
        high, low = int(load[:, 0].argmax()), int(load[:, 0].argmin())
        own = np.flatnonzero(where == high)
        gap = load[high] - load[low]
        after = np.abs(gap - 2 * share[own]) @ weight
        if not len(own) or after.min() >= np.abs(gap) @ weight - 1e-15:
            return moved
        best = int(own[after.argmin()])
        where[best] = moved[best] = low
        load[high] -= share[best]
        load[low] += share[best]


ITEMS = "group binary, piece int, bytes bigint, tokens bigint, rows bigint"


def _cell(shards: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("group", "ascending"), ("piece", "ascending")])
        where = pack(np.stack([table.column(c).to_numpy().astype(float) for c in SIZES], axis=1), shards)
        where = (where + key[0].as_py()) % shards
        return table.drop_columns(["cell"]).append_column("shard", pa.array(where.astype(np.int32)))

    return run


def packed(items: DataFrame, p: ShardParams) -> DataFrame:
    """ITEMS -> ITEMS and the shard of each. Stored; the driver sees the shards' sums and ``movable`` items or so."""
    spark = items.sparkSession
    items = stored(items, "shard-items")
    n = items.count()
    cells = max(1, -(-n // p.per_cell))
    dealt = items.withColumn("cell", F.pmod(F.xxhash64("group", "piece"), F.lit(cells)).cast("int"))
    out = stored(dealt.groupBy("cell").applyInArrow(_cell(p.shards), f"{ITEMS}, shard int"), "shard-packed")
    load = np.zeros((p.shards, len(SIZES)))
    for r in out.groupBy("shard").agg(*(F.sum(c).alias(c) for c in SIZES)).collect():
        load[r["shard"]] = [float(r[c]) for c in SIZES]
    total = np.where(load.sum(axis=0) > 0, load.sum(axis=0), 1)
    few = out.where(F.pmod(F.xxhash64("piece", "group"), F.lit(max(1, n // p.movable))) == 0).orderBy("group", "piece").limit(2 * p.movable).collect()
    moved = level(load / total, np.array([[float(r[c]) for c in SIZES] for r in few]).reshape(-1, len(SIZES)) / total, np.array([r["shard"] for r in few], np.int64))
    new = spark.createDataFrame([(bytearray(few[i]["group"]), few[i]["piece"], s) for i, s in moved.items()], "group binary, piece int, moved int")
    return out.join(F.broadcast(new), ["group", "piece"], "left").withColumn("shard", F.coalesce("moved", "shard")).drop("moved")


def shard(docs: DataFrame, p: ShardParams = ShardParams()) -> DataFrame:
    """(doc_id, text) -> doc_id, size, text_crc32, law, shard, slot, grown_shard; one row for each row of ``docs``."""
    text = whole_text()
    rows = stored(
        docs.select(
            "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), n_tokens(F.col("text")).alias("tokens"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("group"),
            F.xxhash64(F.monotonically_increasing_id()).alias("number"),
        ), "shard-rows",
    )
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    total = rows.agg(*sums).first()
    share = F.greatest(*(F.col(k) / F.lit(float(total[k] or 1)) for k in SIZES))
    heavy = rows.groupBy("group").agg(*sums).withColumn("share", share).where(F.col("share") >= 1.0 / p.frequent)
    pieces = F.when(F.col("share") > 1.0 / p.whole, F.ceil(F.col("share") * 16 * p.whole)).otherwise(1).cast("int")
    heavy = stored(heavy.select("group", pieces.alias("pieces")), "shard-frequent")  # at most 3 * frequent rows
    rows = rows.join(F.broadcast(heavy), "group", "left").withColumn("piece", F.coalesce(F.pmod("number", "pieces"), F.lit(0)).cast("int"))
    own = packed(rows.groupBy("group", "piece").agg(*sums), p).select("group", "piece", "shard")
    hot = own.join(F.broadcast(heavy.select("group")), "group", "left_semi")  # at most 48 * whole + 3 * frequent rows
    cells = max(p.min_cells, -(-int(total["rows"]) // (p.shards * p.rows_per_cell)))
    cell = F.pmod(F.shiftright("number", 20), F.lit(cells)).cast("int").alias("cell")
    put = rows.where("pieces IS NOT NULL").join(F.broadcast(hot), ["group", "piece"]).unionByName(rows.where("pieces IS NULL").join(own, ["group", "piece"]))
    put = stored(put.select("doc_id", "size", "text_crc32", "shard", cell), "shard-put")
    # shards * cells rows
    starts = put.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.withColumn("start", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    number = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32"))
    numbered = put.withColumn("_n", number).join(starts.select("shard", "cell", "start"), ["shard", "cell"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("_n") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
