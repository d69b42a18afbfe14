"""Tokens, stopwords and document analysis."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .porter import stem

# The stopwords.
STOPWORDS = tuple(
    """
    a about above after again all am an and any are as at be because been before being below between both but by can could
    did do does doing down during each few for from further had has have having he her here hers him his how i if in into
    is it its itself just me more most my no nor not now of off on once only or other our ours out over own same she should
    so some such than that the their theirs them then there these they this those through to too under until up very was we
    were what when where which while who whom why will with would you your yours
    """.split()
)
_STOP = frozenset(STOPWORDS)
TOKEN = "[a-z0-9]+"
_TOKEN = re.compile(TOKEN)


def tokens(text: Column) -> Column:
    """All runs of ASCII letters and digits of the lower-cased text; stopwords included."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def is_stopword(token: Column) -> Column:
    return token.isin(*STOPWORDS)


def length(text: Column) -> Column:
    """The number of tokens without stopwords."""
    return F.coalesce(F.size(F.filter(tokens(text), lambda t: ~is_stopword(t))), F.lit(0)).cast("bigint")


def combined_text(title: Column, text: Column) -> Column:
    """Title and text, as they are indexed."""
    return F.when(F.coalesce(title, F.lit("")) != "", F.concat_ws(" ", title, text)).otherwise(F.coalesce(text, F.lit("")))


def token_positions(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, pos, token): a row for each token; positions count stopwords too."""
    return docs.select(F.col(id_column), F.posexplode(tokens(F.col(text))).alias("pos", "token"))


def tokenize(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def analyze(text: str) -> dict[str, list[int]]:
    """Stem -> ascending positions in the whole token stream of one text; stopwords take a place and are left out."""
    (rows,) = _postings(iter([pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([text])], ["doc_id", "text"])]))
    places = dict(zip(rows.column("term").to_pylist(), rows.column("positions").to_pylist(), strict=True))
    return dict(sorted(places.items(), key=lambda x: x[1]))


POSTINGS = "doc_id bigint, term string, tf int, positions array<int>, length int"

_TOKEN_BYTE = np.zeros(256, dtype=bool)
_TOKEN_BYTE[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = True
#: Bytes of text that are taken together: a worker's memory follows them, whatever the size of the input.
PIECE = 1 << 21
#: Bytes of an Arrow batch that comes to a worker, which holds two of them while it reads.
BATCH = 1 << 23


def _lower(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the lower-cased texts, one after another, and the n + 1 offsets. Arrow gives the capital dotted I another
    lower case than Spark and Python do, so texts with it go through Python."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if pc.any(pc.match_substring(texts, "\u0130")).as_py():
        texts = pa.array([t.lower() for t in texts.to_pylist()], pa.large_string())
    texts = pc.utf8_lower(texts)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _of_batch(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """POSTINGS of a batch: each distinct token is stemmed once, and one sort by (row, stem) makes the lists."""
    data, offsets = _lower(texts)
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = _TOKEN_BYTE[data]
    cut = np.zeros(len(data) + 1, dtype=bool)  # a token ends where its text ends
    cut[offsets] = True
    first = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    row = np.searchsorted(offsets, first, "right") - 1
    begin = np.searchsorted(first, offsets)
    position = (np.arange(len(first)) - begin[row]).astype(np.int32)
    ends = np.concatenate(([0], np.cumsum(end - first)))
    tokens = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[inside[1:-1]])))
    coded = tokens.dictionary_encode()
    stems = pa.array([None if t in _STOP else stem(t) for t in coded.dictionary.to_pylist()], pa.string()).dictionary_encode()
    number = stems.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[coded.indices.to_numpy()] if len(first) else np.zeros(0, np.int64)
    kept = number >= 0
    row, position, number = row[kept], position[kept], number[kept]
    key = row * max(1, len(stems.dictionary)) + number
    order = np.argsort(key, kind="stable")
    key = key[order]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else key
    bounds = np.append(start, len(key)).astype(np.int32)
    own = row[order][start]
    length = np.bincount(row, minlength=len(texts)).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(own)), stems.dictionary.take(pa.array(number[order][start])), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(position[order])), pa.array(length[own])],
        ["doc_id", "term", "tf", "positions", "length"],
    )


def pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The same rows with some PIECE bytes of ``column`` at a time; a row of more is a piece of its own."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(batch):
            upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PIECE)))
            yield batch.slice(at, upto - at)
            at = upto


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "text"):
        yield _of_batch(piece.column("doc_id"), piece.column("text"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it comes in fewer splits than there are cores: it is then at most so many splits large. Others
    stay as they are. Only the plan is made to find out."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if not df.isStreaming and df.rdd.getNumPartitions() < cores else df


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, which comes to Python in batches of some BATCH bytes: by rows alone, a batch is as large as its texts are long.
    Only the session can say so; a smaller bound that it has stays."""
    name, spark = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, f"{BATCH}b")
    return df


def postings(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, term, tf, positions, length), one row for each term of each document; length is the document's.

    A document's tokens lie in one row, so its postings are made there, a batch of documents at a time, each distinct token of
    a batch stemmed once: nothing is shuffled, where exploding tokens, joining stems and grouping again would move every token
    of the corpus twice."""
    return in_small_batches(spread(docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text).alias("text")))).mapInArrow(_postings, POSTINGS)


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "text"):
        found = _of_batch(pa.nulls(len(piece), pa.int64()), piece.column("text")).column("term").value_counts()
        yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["term", "df"])


def term_counts(docs: DataFrame) -> DataFrame:
    """docs (text) -> (term, df): in how many documents a term is, as partial sums."""
    return in_small_batches(spread(docs.select(F.col("text")))).mapInArrow(_term_counts, "term string, df bigint")
