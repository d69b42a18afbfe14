import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.functions import urls
from gleaner.functions.html import extract, extract_pages, link
from gleaner.plans import registry

CASES = [
    ("HTTP://Example.COM/a", "http://example.com/a"),
    ("http://e.com:80/", "http://e.com/"),
    ("https://e.com:443/x", "https://e.com/x"),
    ("http://e.com:8080/p/", "http://e.com:8080/p"),
    ("http://e.com", "http://e.com/"),
    ("http://e.com./x", "http://e.com/x"),
    ("http://e.com/a/../b/./c", "http://e.com/b/c"),
    ("http://e.com/%7euser/%2fx", "http://e.com/~user/%2Fx"),
    ("http://e.com/a/%2e%2e/b", "http://e.com/b"),
    ("http://e.com/a#f", "http://e.com/a"),
    ("http://e.com/?b=2&a=1", "http://e.com/?a=1&b=2"),
    ("http://e.com/?utm_source=x&REF=y&q=1", "http://e.com/?q=1"),
    ("http://e.com/?a&b=", "http://e.com/?a=&b="),
    ("http://e.com/?q=a+b%20c~*", "http://e.com/?q=a+b+c~%2A"),
    ("http://Us:Pw@E.com/", "http://Us:Pw@e.com/"),
    ("http://[::1]:8080/x", "http://[::1]:8080/x"),
    ("http://www.e.com/", "http://www.e.com/"),
    ("http://e.com//a//", "http://e.com//a"),
]


@pytest.mark.parametrize(("raw", "expected"), CASES)
def test_canonical(raw, expected):
    assert urls.canonicalize(raw) == expected
    assert urls.canonicalize(expected) == expected


def test_columns(spark):
    got = spark.createDataFrame(CASES, "raw string, expected string").select(urls.canonical(F.col("raw")).alias("c"), "expected").collect()
    assert [r["c"] for r in got] == [r["expected"] for r in got]


@pytest.mark.parametrize(
    ("href", "expected"),
    [("other.html", "http://e.com/d/other.html"), ("/r", "http://e.com/r"), ("../up", "http://e.com/up"), ("//h.org/x", "http://h.org/x"), ("?q=1", "http://e.com/d/page.html?q=1"),
     ("#top", None), ("mailto:a@b.c", None), ("javascript:x()", None), ("http://[bad", None)],
)
def test_links(href, expected):
    assert link("http://e.com/d/page.html", href) == expected


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab/.%2eE?&=+~#", max_size=20))
def test_idempotent(tail):
    once = urls.canonicalize("http://h.com/" + tail)
    assert urls.canonicalize(once) == once


def test_hosts(spark):
    rows = [("http://A.Books.com:8/x", True), ("http://books.com", True), ("http://notbooks.com", False), ("nothing", False)]
    df = spark.createDataFrame(rows, "u string, want boolean")
    got = df.select(urls.host_allowed(urls.host(F.col("u")), ["books.com"]).alias("ok"), "want", urls.host_allowed(urls.host(F.col("u")), []).alias("none")).collect()
    assert all(r["ok"] == r["want"] and not r["none"] for r in got)


HTML = """<html><head><title> A  &amp;
 title </title><style>p{}</style></head><body><p>One</p><p>two<br>three</p><script>no()</script>
<a href="/x#f">link</a><a href="/x">again</a><a href="#top">top</a><div>caf&eacute;</div></body></html>"""


def test_extract(spark):
    assert extract("http://e.com/p", HTML) == ("A & title", "One two three linkagaintop café", ["http://e.com/x"])
    assert extract("http://e.com/p", "<head><title>t</title><p>lost<a href='/l'>x</a>") == ("t", "", ["http://e.com/l"])
    assert extract("http://e.com/p", "") == ("", "", [])
    got = extract_pages(spark.createDataFrame([(1, "http://e.com/p/", HTML), (2, None, None)], "page_id bigint, url string, html string")).orderBy("page_id").collect()
    assert got[0]["url"] == "http://e.com/p" and got[0]["links"] == ["http://e.com/x"] and got[1]["text"] == ""


def test_references_without_semicolon(spark):
    html = "<title>a &amp; b&amp</title><p>x&amp y&copy; &#65;&#65 &ampere;"
    assert extract("http://e.com/", html)[:2] == ("a & b&", "x& y© AA &ere;")
    assert extract("http://e.com/", html, bare=False)[:2] == ("a & b&amp", "x&amp y© A&#65 &ampere;")


@pytest.mark.parametrize("name", ["extract_title", "extract_text", "pages_search"])
def test_cut_reference_as_sql(spark, tmp_path, name):
    html = "<html><head><title>Erin and&amp</title></head><body><p>Erin and&amp;&amp; &lt;b&gt; ment</p></body></html>"
    spark.createDataFrame([(1, "http://e.com/p", html), (2, "http://e.com/q", "<head><title>Ment</title></head>ment &amp")], "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    asked = con.execute(registry.ORACLE[name])
    columns = [c[0] for c in asked.description]
    assert sorted(map(tuple, registry.QUERIES[name](spark, str(tmp_path)).select(columns).collect())) == sorted(asked.fetchall())
