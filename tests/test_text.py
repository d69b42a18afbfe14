import pytest
import pyarrow as pa
from pyspark.sql import functions as F

from gleaner.functions import porter, text

# Words of the stemmer's paper and their stems.
VECTORS = dict(
    pair.split(":")
    for pair in """caresses:caress ponies:poni ties:ti caress:caress cats:cat feed:feed agreed:agre plastered:plaster bled:bled
    motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop tanned:tan falling:fall hissing:hiss
    fizzed:fizz failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit rational:ration valenci:valenc
    hesitanci:hesit digitizer:digit conformabli:conform radicalli:radic differentli:differ vileli:vile analogousli:analog
    vietnamization:vietnam predication:predic operator:oper feudalism:feudal decisiveness:decis hopefulness:hope
    callousness:callous formaliti:formal sensitiviti:sensit sensibiliti:sensibl triplicate:triplic formative:form
    formalize:formal electriciti:electr electrical:electr hopeful:hope goodness:good revival:reviv allowance:allow
    inference:infer airliner:airlin gyroscopic:gyroscop adjustable:adjust defensible:defens irritant:irrit
    replacement:replac adjustment:adjust dependent:depend adoption:adopt homologou:homolog communism:commun activate:activ
    angulariti:angular homologous:homolog effective:effect bowdlerize:bowdler probate:probat rate:rate cease:ceas
    controll:control roll:roll a:a is:is be:be""".split()
)


def test_single_words():
    assert {w: porter.stem(w) for w in VECTORS} == VECTORS


def test_columns_agree(spark):
    words = [*VECTORS, "y", "yyy", "syzygy", "toy", "2026", "a1b2ing", "eed", "ing", "ied", "sses", "ll", "x" * 60]
    got = {r["token"]: r["stem"] for r in porter.with_stem(spark.createDataFrame([(w,) for w in words], "token string")).collect()}
    assert got == {w: porter.stem(w) for w in words}


@pytest.mark.parametrize("family", ["run runs running", "connect connected connection connecting connections"])
def test_families(family):
    assert len({porter.stem(w) for w in family.split()}) == 1


def test_tokens(spark):
    cases = ["Hello, World! It's 2026.", "", "...", "Über snake_case K", None]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cases], "t string").select(text.tokens(F.col("t"))).collect()]
    assert got == [["hello", "world", "it", "s", "2026"], [], [], ["ber", "snake", "case", "k"], None]
    assert got[:4] == [text.tokenize(c) for c in cases[:4]]


def test_positions_count_stopwords():
    assert text.analyze("running the runner runs") == {"run": [0, 3], "runner": [2]}
    assert text.analyze("search the index") == {"search": [0], "index": [2]}
    assert text.analyze("the of and") == {}


def test_postings(spark):
    docs = spark.createDataFrame([(1, "search engines search the web"), (2, ""), (3, None)], "doc_id bigint, text string")
    got = {(r["doc_id"], r["term"]): (r["tf"], r["positions"]) for r in text.postings(docs).collect()}
    assert got == {(1, "search"): (2, [0, 2]), (1, "engin"): (1, [1]), (1, "web"): (1, [4])}
    assert text.postings(docs.limit(0)).count() == 0


def test_combined_text(spark):
    rows = spark.createDataFrame([("t", "x"), ("", "x"), (None, None)], "a string, b string")
    assert [r[0] for r in rows.select(text.combined_text(F.col("a"), F.col("b"))).collect()] == ["t x", "x", ""]


def test_pieces_bound_what_is_taken_at_once(spark):
    texts = ["word " * 100_000, None, "", "x" * (text.PIECE * 2), *["more words " * 20_000] * 20]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    got = list(text.pieces(iter([batch, batch.slice(0, 0)]), "text"))
    assert [i for b in got for i in b.column("doc_id").to_pylist()] == list(range(len(texts)))
    assert all(len(b) == 1 or sum(len(t or "") for t in b.column("text").to_pylist()) <= text.PIECE for b in got)


def test_batches_to_python_are_bounded_by_bytes(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, "64m")
    docs = spark.range(400, numPartitions=1).selectExpr("id AS doc_id", "repeat('word ', 40000) AS text")
    text.postings(docs)
    sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n bigint").collect()
    assert max(r["n"] for r in sizes) <= text.BATCH + 300_000
    spark.conf.set(name, "1m")
    text.postings(docs)
    assert spark.conf.get(name) == "1m"
    spark.conf.unset(name)
