"""BM25 as Column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.5, 0.75


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n_docs - df + 0.5) / (df + 0.5))


def term_score(tf: Column, length: Column, avgdl: Column, weight: Column, k1: float = K1, b: float = B) -> Column:
    """weight: the term's idf. An average length of 0 counts as 1."""
    norm = F.lit(1.0 - b) + F.lit(float(b)) * length / F.when(avgdl == 0, 1.0).otherwise(avgdl)
    return weight * tf * (k1 + 1.0) / (tf + F.lit(float(k1)) * norm)
