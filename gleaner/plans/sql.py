"""DuckDB SQL of the same operators, to compare with."""

from __future__ import annotations

from gleaner.functions.text import STOPWORDS
from gleaner.functions.urls import TRACKING

from . import stems

STOP = "(" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")"
BLOCK_TAGS = "p|div|br|li|ul|ol|h1|h2|h3|h4|h5|h6|tr|td|th|table|section|article|header|footer|blockquote|pre|nav|aside|form|hr"


def tokens(source: str = "documents", id_column: str = "doc_id", text: str = "text", name: str = "tok") -> str:
    return f"""{name} AS (SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS token
      FROM (SELECT {id_column} AS doc_id, regexp_extract_all(lower({text}), '[a-z0-9]+') AS l FROM {source}))"""


def index(source: str = "documents", id_column: str = "doc_id", text: str = "text") -> str:
    """CTEs: tok, voc, post (doc_id, term, pos), p (doc_id, term, tf), len (doc_id, length), st (n_docs, total_length, avgdl)."""
    return f"""{tokens(source, id_column, text)},
    dtok AS (SELECT DISTINCT token FROM tok WHERE token NOT IN {STOP}),
    {stems.ctes("dtok")},
    post AS (SELECT t.doc_id, v.stem AS term, t.pos FROM tok t JOIN voc v ON t.token = v.token),
    p AS (SELECT doc_id, term, CAST(count(*) AS INTEGER) AS tf, string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos) AS positions FROM post GROUP BY ALL),
    len AS (SELECT d.{id_column} AS doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS length FROM {source} d LEFT JOIN (SELECT doc_id, sum(tf) AS n FROM p GROUP BY doc_id) s ON d.{id_column} = s.doc_id),
    st AS (SELECT count(*) AS n_docs, CAST(coalesce(sum(length), 0) AS BIGINT) AS total_length, coalesce(sum(length) / CAST(count(*) AS DOUBLE), 0.0) AS avgdl FROM len)"""


#: A query as the SQL has it, written out by hand: groups of (stem, offset), and whether all must match.
Asked = tuple[list[list[tuple[str, int]]], bool]


def matched(groups: list[list[tuple[str, int]]], every: bool) -> str:
    parts = []
    for g in groups:
        if len(g) > 1:
            joins = " ".join(f"JOIN post p{i} ON p{i}.doc_id = p0.doc_id AND p{i}.pos = p0.pos + {o} AND p{i}.term = '{t}'" for i, (t, o) in enumerate(g) if i)
            parts.append(f"(SELECT DISTINCT p0.doc_id FROM post p0 {joins} WHERE p0.term = '{g[0][0]}')")
        else:
            parts.append(f"(SELECT DISTINCT doc_id FROM p WHERE term = '{g[0][0]}')")
    return (" INTERSECT " if every else " UNION ").join(parts)


def scores(terms, k1: float, b: float) -> str:
    names = ", ".join(f"'{t}'" for t in sorted(terms))
    return f"""SELECT p.doc_id, round(sum(ln(1.0 + (st.n_docs - d.df + 0.5) / (d.df + 0.5)) * p.tf * ({k1} + 1.0)
        / (p.tf + {k1} * ((1.0 - {b}) + {b} * len.length / CASE WHEN st.avgdl = 0 THEN 1.0 ELSE st.avgdl END))), 12) AS score
      FROM p JOIN len ON p.doc_id = len.doc_id JOIN (SELECT term, count(*) AS df FROM p GROUP BY term) d ON d.term = p.term CROSS JOIN st
      WHERE p.term IN ({names}) GROUP BY p.doc_id"""


def search(asked: Asked, limit: int = 10, k1: float = 1.5, b: float = 0.75, source: str = "documents", id_column: str = "doc_id", text: str = "text", before: str = "", hits_only: bool = False) -> str:
    groups, every = asked
    terms = {t for g in groups for t, _ in g}
    ctes = f"""WITH {before}{index(source, id_column, text)},
    m AS ({matched(groups, every)}), s AS ({scores(terms, k1, b)}),
    hits AS (SELECT CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM s WHERE doc_id IN (SELECT doc_id FROM m) ORDER BY s.score DESC, doc_id LIMIT {limit})"""
    return ctes if hits_only else ctes + " SELECT rank, doc_id, score FROM hits"


def batch(queries: list[tuple[int, Asked]], limit: int = 10) -> str:
    parts = []
    for i, (groups, every) in queries:
        terms = {t for g in groups for t, _ in g}
        parts.append(f"""SELECT CAST({i} AS BIGINT) AS query_id, rank, doc_id, round(score, 6) AS score FROM (SELECT CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
          FROM ({scores(terms, 1.5, 0.75)}) WHERE doc_id IN ({matched(groups, every)})) WHERE rank <= {limit}""")
    return f"WITH {index()} " + " UNION ALL ".join(parts)


def snippets(asked: Asked, limit: int = 10, width: int = 30) -> str:
    names = ", ".join(f"'{t}'" for g in asked[0] for t, _ in g)
    return search(asked, limit, hits_only=True) + f""",
    w AS (SELECT h.doc_id, list_filter(string_split_regex(d.text, '\\s+'), lambda x: x <> '') AS words FROM hits h JOIN documents d ON d.doc_id = h.doc_id),
    firsts AS (SELECT doc_id, unnest(range(len(words))) AS i, unnest(list_transform(words, lambda x: regexp_extract(lower(x), '[a-z0-9]+'))) AS token FROM w),
    hit AS (SELECT f.doc_id, min(f.i) AS i FROM firsts f JOIN voc v ON v.token = f.token WHERE v.stem IN ({names}) GROUP BY f.doc_id),
    cut AS (SELECT w.doc_id, words, greatest(0, coalesce(hit.i, 0) - {width // 2}) AS a FROM w LEFT JOIN hit ON hit.doc_id = w.doc_id)
    SELECT doc_id, concat(CASE WHEN a > 0 THEN '… ' ELSE '' END, array_to_string(list_slice(words, a + 1, least(len(words), a + {width})), ' '), CASE WHEN a + {width} < len(words) THEN ' …' ELSE '' END) AS snippet FROM cut"""


def canonical(url: str) -> str:
    """Of URLs of the fixture's form: absolute, with neither ports nor escapes nor dot segments."""
    noise = ", ".join(f"'{t}'" for t in TRACKING)
    query = f"array_to_string(list_sort(list_filter(string_split(regexp_extract({url}, '\\?([^#]*)', 1), '&'), lambda x: x <> '' AND lower(split_part(x, '=', 1)) NOT IN ({noise}))), '&')"
    path = f"regexp_replace(regexp_extract({url}, '^[^:]+://[^/?#]*([^?#]*)', 1), '/+$', '')"
    return f"""concat(lower(regexp_extract({url}, '^[^:]+://[^/?#]*')), CASE WHEN {path} = '' THEN '/' ELSE {path} END, CASE WHEN {query} = '' THEN '' ELSE concat('?', {query}) END)"""


def host(url: str) -> str:
    return f"lower(regexp_extract({url}, '^[^:]+://([^/?#:]*)', 1))"


def _decoded(x: str) -> str:
    for a, b in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


TITLE = _decoded("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")
TEXT = _decoded(
    f"regexp_replace(regexp_replace(regexp_replace(html, '(?s)<head>.*?</head>|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<![^>]*>', '', 'g'), '</?({BLOCK_TAGS})(\\s[^>]*)?/?>', ' ', 'g'), '<[^>]*>', '', 'g')"
)
PAGES = f"pg AS (SELECT page_id, {canonical('url')} AS url, {TITLE} AS title, {TEXT} AS text, html, regexp_extract(url, '^[^:]+://[^/?#]*') AS origin FROM pages)"
LINKS = f"""{PAGES}, links AS (SELECT DISTINCT page_id, {canonical("concat(lower(origin), h)")} AS url FROM (SELECT page_id, origin, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS h FROM pg) WHERE h NOT LIKE '#%')"""


def bloom_positions(item: str, m: str, k: str) -> str:
    """A list of bit places of ``item``; m, k: columns."""
    h1 = f"(CAST(concat('0x', substr(md5({item}), 1, 15)) AS BIGINT) % {m})"
    h2 = f"((CAST(concat('0x', substr(md5({item}), 17, 15)) AS BIGINT) | 1) % {m})"
    return f"list_transform(range({k}), lambda i: ({h1} + i * {h2}) % {m})"
