"""Query parsing, matching, BM25 ranking, top-K and snippets; for one query or a table of them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import bm25
from gleaner.functions.porter import stem, with_stem
from gleaner.functions.text import STOPWORDS, TOKEN, tokenize

from .index import Index, corpus_stats, doc_frequency

SNIPPET_WORDS = 30
#: Query terms up to which they are broadcast in a batch.
BROADCAST_TERMS = 100_000


@dataclass(frozen=True)
class Term:
    """A stem that a query asks for: the part of the query it belongs to, and its place after the part's first stem."""

    group: int
    stem: str
    offset: int = 0


@dataclass(frozen=True)
class Query:
    """A group is one term, or the terms of a phrase. ``every``: all groups must match, else one is enough."""

    terms: tuple[Term, ...]
    every: bool = True

    @property
    def groups(self) -> list[list[Term]]:
        return [list(own) for _, own in groupby(self.terms, lambda t: t.group)]

    @property
    def stems(self) -> list[str]:
        return sorted({t.stem for t in self.terms})


def _pieces(q: str) -> Iterator[tuple[str, bool]]:
    """(text, whether it is quoted). A quotation mark opens a phrase at the start of a piece, if another one closes it."""
    at = 0
    while at < len(q):
        if q[at].isspace():
            at += 1
            continue
        close = q.find('"', at + 1) if q[at] == '"' else -1
        if close > 0:
            yield q[at + 1 : close], True
        else:
            close = next((i for i in range(at, len(q)) if q[i].isspace()), len(q))
            yield q[at:close], False
        at = close + 1


def parse_query(q: str) -> Query:
    """Words are terms; the tokens of a quoted piece are a phrase in which a stopword stands for any one word, and a stem that
    comes again counts at its first place; the word OR makes one match enough."""
    terms: list[Term] = []
    group, every = 0, True
    for piece, quoted in _pieces(q):
        if piece == "OR" and not quoted:
            every = False
            continue
        found = [(place, stem(t)) for place, t in enumerate(tokenize(piece)) if t not in STOPWORDS]
        if quoted:
            firsts = {s: place for place, s in reversed(found)}
            terms += [Term(group, s, place - found[0][0]) for s, place in sorted(firsts.items(), key=lambda x: x[1])]
            group += bool(found)
        else:
            terms += [Term(group + i, s) for i, (_, s) in enumerate(found)]
            group += len(found)
    return Query(tuple(terms), every)


def _check(limit: int) -> None:
    if limit <= 0:
        raise ValueError("limit must be positive")


def _less(offset: int, position: Column) -> Column:
    return position - offset


def _phrase_at(columns: list[Column], offsets: tuple[int, ...]) -> Column:
    """Whether some start has every term at its offset."""
    shared = None
    for c, o in zip(columns, offsets, strict=True):
        own = F.transform(F.coalesce(c, F.array().cast("array<int>")), partial(_less, o))
        shared = own if shared is None else F.array_intersect(shared, own)
    return F.size(shared) > 0


def _totals(corpus: DataFrame) -> DataFrame:
    """The row of statistics: ``corpus`` itself, or counted from its lengths."""
    return corpus if "avgdl" in corpus.columns else corpus_stats(corpus)


#: Scores are ranked as they are but for the last digits, in which the order of a sum shows.
_DIGITS = 12


def rank_documents(posted: DataFrame, corpus: DataFrame, q: str, limit: int = 10, k1: float = bm25.K1, b: float = bm25.B, terms: DataFrame | None = None) -> DataFrame:
    """(rank, doc_id, score) of the best ``limit`` documents, by score then doc_id; scores are rounded when they are ranked.

    posted: postings with the documents' lengths. corpus: one row of statistics, or documents with lengths. terms: document
    frequencies, if they are known. One pass over the query terms' postings: an aggregate for each document holds its tf
    (and positions, for phrases) of each term; matching and scoring are expressions on that row."""
    _check(limit)
    query = parse_query(q)
    if not query.terms:
        return posted.sparkSession.createDataFrame([], "rank int, doc_id bigint, score double")
    own = posted.where(F.col("term").isin(*query.stems))
    at = {t: i for i, t in enumerate(query.stems)}
    phrased = sorted({t.stem for g in query.groups if len(g) > 1 for t in g})
    tf = [F.max(F.when(F.col("term") == t, F.col("tf"))).alias(f"tf{i}") for t, i in at.items()]
    places = [F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"p{at[t]}") for t in phrased]
    rows = own.groupBy("doc_id").agg(F.max("length").alias("length"), *tf, *places)
    hits = [_phrase_at([F.col(f"p{at[t.stem]}") for t in g], tuple(t.offset for t in g)) if len(g) > 1 else F.col(f"tf{at[g[0].stem]}").isNotNull() for g in query.groups]
    match = reduce(Column.__and__ if query.every else Column.__or__, hits)
    known = own.groupBy("term").agg(F.count(F.lit(1)).alias("df")) if terms is None else terms.where(F.col("term").isin(*query.stems))
    stats = _totals(corpus).crossJoin(known.agg(*(F.coalesce(F.max(F.when(F.col("term") == t, F.col("df"))), F.lit(0)).alias(f"df{i}") for t, i in at.items())))
    score = F.lit(0.0)
    for i in at.values():
        w = bm25.idf(F.col("n_docs"), F.col(f"df{i}"))
        score = score + F.coalesce(bm25.term_score(F.col(f"tf{i}"), F.col("length"), F.col("avgdl"), w, k1, b), F.lit(0.0))
    scored = rows.where(match).crossJoin(F.broadcast(stats))  # stats is one row
    return _ranked(scored.select("doc_id", F.round(score, _DIGITS).alias("score")), limit)


def _ranked(scored: DataFrame, limit: int) -> DataFrame:
    top = top_k(scored, limit)
    return top.select(F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).alias("rank"), "doc_id", F.round("score", 6).alias("score"))  # at most ``limit`` rows


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k rows with the highest score, ties by doc_id: a bounded heap in each task, merged."""
    if k <= 0:
        raise ValueError("k must be positive")
    return scored.orderBy(F.desc("score"), "doc_id").limit(k)


def rank_batch(posted: DataFrame, corpus: DataFrame, queries: list[tuple[int, str]], limit: int = 10, k1: float = bm25.K1, b: float = bm25.B, terms: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score) for many queries in one plan: one pass over the postings of all their terms, one
    aggregate for each query and document. What belongs to a term - its groups, frequency and weight - comes with it."""
    _check(limit)
    spark = posted.sparkSession
    rows = []
    for query_id, q in queries:
        query = parse_query(q)
        need, counted = len(query.groups) if query.every else 1, set()
        for own in query.groups:
            for t in own:
                rows.append((query_id, need, t.group, len(own), t.stem, t.offset, t.stem not in counted))
                counted.add(t.stem)
    asked = spark.createDataFrame(rows, "query_id bigint, need int, grp int, n int, term string, off int, counts boolean")
    phrases = any(r[3] > 1 for r in rows)
    few = F.broadcast if len(rows) <= BROADCAST_TERMS else lambda df: df
    known = doc_frequency(posted.join(few(asked.select("term").distinct()), "term", "left_semi")) if terms is None else terms
    weight = bm25.idf(F.col("n_docs"), F.col("df"))
    asked = asked.join(known, "term").crossJoin(F.broadcast(_totals(corpus))).select(*asked.columns, "avgdl", weight.alias("w"))
    part = F.when(F.col("counts"), bm25.term_score(F.col("tf"), F.col("length"), F.col("avgdl"), F.col("w"), k1, b))
    starts = F.struct("grp", "n", F.transform("positions", lambda x: x - F.col("off")).alias("starts"))
    found = posted.select("term", "doc_id", "tf", "length", *(["positions"] if phrases else [])).join(few(asked), "term").groupBy("query_id", "doc_id").agg(
        F.first("need").alias("need"), F.sum(part).alias("score"), F.count_if(F.col("n") == 1).alias("single"),
        *([F.collect_list(F.when(F.col("n") > 1, starts)).alias("parts")] if phrases else []),  # a row for each term of the query's phrases
    )

    def whole(group: Column) -> Column:
        own = F.filter("parts", lambda x: x["grp"] == group)
        shared = F.aggregate(own, own[0]["starts"], lambda acc, x: F.array_intersect(acc, x["starts"]))
        return (F.size(own) == own[0]["n"]) & (F.size(shared) > 0)

    hits = F.col("single")
    if phrases:
        hits = hits + F.size(F.filter(F.array_distinct(F.transform("parts", lambda x: x["grp"])), whole))
    scored = found.where(hits >= F.col("need")).select("query_id", "doc_id", F.round("score", _DIGITS).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


#: Fixed value: white space as Python has it.
_SPACES = r"\s\x0B\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def with_snippets(hits: DataFrame, stems: list[str], width: int = SNIPPET_WORDS) -> DataFrame:
    """``hits`` (doc_id, text, ...), the few rows of a result, with snippet in place of text: ``width`` words around the first
    word whose first token has one of the stems. The hits' own vocabulary is stemmed for it."""
    rows = hits.withColumn("_words", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"[^{_SPACES}]+"), F.lit(0)))
    firsts = rows.select("doc_id", F.posexplode("_words").alias("_at", "_word")).select("doc_id", "_at", F.regexp_extract(F.lower("_word"), TOKEN, 0).alias("token"))
    firsts = firsts.where("token <> ''")
    # the aggregate keeps the condition behind the stemmer: pushed before it, it would be written out in the words' letters
    asked = with_stem(firsts.select("token").distinct()).groupBy("token").agg(F.first("stem").alias("stem")).where(F.col("stem").isin(*stems)).select("token")
    anchor = firsts.join(asked, "token", "left_semi").groupBy("doc_id").agg(F.min("_at").alias("_at"))
    rows = rows.join(anchor, "doc_id", "left")
    n = F.size("_words")
    start = F.greatest(F.lit(0), F.coalesce("_at", F.lit(0)) - width // 2)
    cut = F.array_join(F.slice("_words", start + 1, width), " ")
    said = F.concat(F.when(start > 0, "… ").otherwise(""), cut, F.when(start + width < n, " …").otherwise(""))
    return rows.select(*(c for c in hits.columns if c != "text"), said.alias("snippet"))


def search(index: Index, q: str, limit: int = 10, k1: float = bm25.K1, b: float = bm25.B) -> DataFrame:
    """(rank, doc_id, url, title, score, snippet): texts are read for the hits alone."""
    hits = rank_documents(index.postings, index.stats, q, limit, k1, b, index.df)
    if not (query := parse_query(q)).terms:
        return hits.select("rank", "doc_id", *(F.lit("").alias(c) for c in ("url", "title")), "score", F.lit("").alias("snippet"))
    found = index.docs.join(F.broadcast(hits), "doc_id") if limit <= 1000 else index.docs.join(hits, "doc_id")
    return with_snippets(found.select("rank", "doc_id", "url", "title", "score", "text"), query.stems).orderBy("rank")
