import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows of (doc_id, text), or of (doc_id, text, lang, source), with columns that clash with inner names."""

    def make(rows):
        full = [(*r, "en", "src1")[:4] if len(r) == 2 else r for r in rows]
        full = [(i, t, lang, source, None if t is None else len(t), 0, "x", "y") for i, t, lang, source in full]
        return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, score int, _key string, key string").repartition(3)

    return make
