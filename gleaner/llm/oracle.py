"""DuckDB SQL of the operators' queries, where SQL can express them."""

from __future__ import annotations

from . import mixing, url_filter

_SPACE = r"[\t\n\x0B\f\r\x1c-\x1f ]+"


def _words(text: str) -> str:
    """The list of a text's words, by the rules of shingles.py."""
    split = f"list_filter(string_split_regex(lower(coalesce({text}, '')), '{_SPACE}'), lambda w: w <> '')"
    bare = "regexp_replace(w, '^[!-/:-@\\[-`{-~]+|[!-/:-@\\[-`{-~]+$', '', 'g')"
    return f"list_transform({split}, lambda w: CASE WHEN {bare} = '' THEN w ELSE {bare} END)"


def _shingles(words: str) -> str:
    return f"""CASE WHEN len({words}) >= 5 THEN list_transform(range(len({words}) - 4), lambda i: array_to_string(list_slice({words}, i + 1, i + 5), ' '))
      WHEN len({words}) > 0 THEN [array_to_string({words}, ' ')] ELSE [] END"""


_DOC_SETS = f"""ds AS (SELECT id, list_distinct({_shingles('w')}) AS s FROM (SELECT doc_id AS id, {_words('text')} AS w FROM documents)),
  dx AS (SELECT id, unnest(s) AS g FROM ds)"""

DECONTAMINATION = f"""WITH {_DOC_SETS}, bs AS (SELECT id, list_distinct({_shingles('w')}) AS s FROM (SELECT item_id AS id, {_words('text')} AS w FROM benchmark)),
  bx AS (SELECT id, len(s) AS n, unnest(s) AS g FROM bs)
  SELECT doc_id, item_id, n_item, n_shared, n_shared / CAST(n_item AS DOUBLE) AS containment
  FROM (SELECT dx.id AS doc_id, bx.id AS item_id, max(bx.n) AS n_item, count(*) AS n_shared FROM dx JOIN bx ON dx.g = bx.g GROUP BY ALL) WHERE n_shared >= 0.8 * n_item"""

NGRAM_JOIN = f"""WITH RECURSIVE {_DOC_SETS},
  sized AS (SELECT id, len(s) AS n, md5(array_to_string(list_sort(s), '|')) AS same FROM ds),
  e AS (SELECT a, b FROM (SELECT x.id AS a, y.id AS b, count(*) AS k FROM dx x JOIN dx y ON x.g = y.g AND x.id <> y.id GROUP BY ALL) p JOIN sized m ON m.id = a JOIN sized o ON o.id = b WHERE k >= 0.8 * (m.n + o.n - k) - 1e-9),
  reach AS (SELECT id AS a, id AS b FROM sized UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
  SELECT s.id AS doc_id, c.class_id, coalesce(l.n, 0) AS n_links, coalesce(l.t, 0) AS n_text_links, s.n AS n_shingles
  FROM sized s JOIN (SELECT a, min(b) AS class_id FROM reach GROUP BY a) c ON c.a = s.id
  LEFT JOIN (SELECT a, count(*) AS n, count(DISTINCT o.same) FILTER (o.same <> m.same) AS t FROM e JOIN sized m ON m.id = a JOIN sized o ON o.id = b GROUP BY a) l ON l.a = s.id"""

LINE_DEDUP = f"""WITH ln AS (SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS line, unnest(l) AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
  ws AS (SELECT doc_id, line, list_sort(list_distinct({_words('text')})) AS w FROM ln),
  sets AS (SELECT w, len(w) AS n, min(struct_pack(d := doc_id, l := line)) AS first, row_number() OVER () AS id FROM ws WHERE len(w) > 0 GROUP BY w),
  x AS (SELECT id, n, unnest(w) AS t FROM sets), df AS (SELECT t, count(*) AS c FROM x GROUP BY t),
  pre AS (SELECT id, n, x.t FROM x JOIN df ON df.t = x.t QUALIFY row_number() OVER (PARTITION BY id ORDER BY c, x.t) <= n - CAST(ceil(0.8 * n - 1e-9) AS BIGINT) + 1),
  cand AS (SELECT DISTINCT a.id AS a, b.id AS b FROM pre a JOIN pre b ON a.t = b.t AND a.id <> b.id AND a.n >= 0.8 * b.n - 1e-9 AND b.n >= 0.8 * a.n - 1e-9),
  hit AS (SELECT DISTINCT a FROM cand JOIN sets p ON p.id = a JOIN sets q ON q.id = b WHERE q.first < p.first AND len(list_intersect(p.w, q.w)) >= 0.8 * (p.n + q.n - len(list_intersect(p.w, q.w))) - 1e-9),
  gone AS (SELECT ws.doc_id, ws.line FROM ws JOIN sets s ON s.w = ws.w WHERE s.id IN (SELECT a FROM hit) OR s.first <> struct_pack(d := ws.doc_id, l := ws.line)),
  g AS (SELECT doc_id, count(*) AS n, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS r FROM gone GROUP BY doc_id)
  SELECT a.doc_id, a.n_lines, coalesce(g.n, 0) AS n_removed, coalesce(g.r, '') AS removed FROM (SELECT doc_id, count(*) AS n_lines FROM ln GROUP BY doc_id) a LEFT JOIN g ON g.doc_id = a.doc_id"""

TOPK = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 5"""


def _weight(name: str, weights: dict) -> str:
    return "CAST(CASE " + name + "".join(f" WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END AS DOUBLE)" if weights else "CAST(1 AS DOUBLE)"


def mixing_sql(p: mixing.MixParams = mixing.MixParams()) -> str:
    levels = mixing.LEVELS
    out = f"""WITH rows_ AS (SELECT doc_id, CASE WHEN x = '' THEN '(none)' ELSE concat('d', CAST(x AS BIGINT) % {p.domains}) END AS domain, coalesce(lang, '(none)') AS language, coalesce(source, '(none)') AS origin, tokens
      FROM (SELECT *, regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS x, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS tokens FROM documents)),
    leaves AS (SELECT domain, language, origin, CAST(sum(tokens) AS BIGINT) AS tokens FROM rows_ GROUP BY ALL),
    g0 AS (SELECT CAST(floor(coalesce(sum(tokens), 0) * {p.share}) AS BIGINT) AS given FROM leaves)"""
    for d, (name, weights) in enumerate(zip(levels, (p.domain_weights, p.language_weights, p.source_weights), strict=True), 1):
        own, above = ", ".join(levels[:d]), ", ".join(levels[: d - 1])
        part = f"PARTITION BY {above}" if above else ""
        join = f"JOIN g{d - 1} USING ({above})" if above else f"CROSS JOIN g{d - 1}"
        out += f""",
    n{d} AS (SELECT n.*, given, cap / weight AS ratio FROM (SELECT {own}, CAST(sum(tokens) * {p.max_epochs} AS BIGINT) AS cap, {_weight(name, weights)} AS weight FROM leaves GROUP BY {own}) n {join}),
    l{d} AS (SELECT *, (given - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM n{d} WINDOW w AS ({part} ORDER BY ratio, {name})),
    c{d} AS (SELECT *, min(CASE WHEN ratio > level THEN struct_pack(ratio := ratio, l := level) END) OVER ({part}) AS cut FROM l{d}),
    g{d} AS (SELECT {own}, CAST(least(cap, greatest(0, CASE WHEN ratio <= level THEN cap ELSE floor(cut.l * weight) END)) AS BIGINT) AS given FROM c{d})"""
    out += f""",
    plan AS (SELECT l.*, CASE WHEN tokens > 0 THEN given // tokens ELSE 1 END AS whole, CASE WHEN tokens > 0 THEN given % tokens ELSE 0 END AS rest FROM leaves l JOIN g3 USING ({', '.join(levels)})),
    keyed AS (SELECT r.*, p.whole, p.rest, md5(concat('{p.seed}:', CAST(p.whole + 1 AS VARCHAR), ':', coalesce(CAST(doc_id AS VARCHAR), 'null'))) AS key FROM rows_ r JOIN plan p USING ({', '.join(levels)})),
    cum AS (SELECT *, sum(tokens) OVER (PARTITION BY {', '.join(levels)} ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - sum(tokens) OVER (PARTITION BY {', '.join(levels)}, key) AS before FROM keyed),
    times AS (SELECT *, whole + CASE WHEN rest > 0 AND before < rest THEN 1 ELSE 0 END AS n FROM cum)
    SELECT doc_id, {', '.join(levels)}, CAST(unnest(range(1, n + 1)) AS INTEGER) AS epoch, tokens FROM times"""
    return out


def url_filter_sql(rules=url_filter.RULES, p: url_filter.TreeParams = url_filter.TreeParams(), levels: int = 8) -> str:
    """Of paths of at most ``levels`` segments; further ones would be further steps of the same form."""
    order = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{x}') THEN '{{}}'" for _, h, x in order)
    rule, verdict = (f"CASE {fits.format(*values)} END" for values in ([h + x for _, h, x in order], [v for v, _, _ in order]))
    form = """CASE WHEN regexp_matches(s, '^[0-9]+$') THEN '{n}' WHEN regexp_matches(s, '^[0-9]+\\.[A-Za-z0-9]{1,5}$') THEN concat('{n}.', regexp_extract(s, '[^.]*$')) WHEN regexp_matches(s, '^[0-9A-Fa-f-]{16,}$') THEN '{id}' WHEN regexp_matches(s, '[0-9]{3,}') THEN '{mixed}' ELSE s END"""
    purity = lambda b, a: f"(({b} + {p.alpha * p.prior}) / ({a} + {b} + {p.alpha}) >= {p.purity})"
    out = f"""WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    hp AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
    seg AS (SELECT *, {rule} AS rule, {verdict} AS by_rule, list_filter(string_split(path, '/'), lambda s: s <> '') AS kept FROM hp),
    seen AS (SELECT page_id, host, path, rule, by_rule, list_transform(kept, lambda s: {form}) AS shape FROM seg),
    a0 AS (SELECT host, shape, count(*) AS n, count(*) FILTER (by_rule = 'block') AS b, count(*) FILTER (by_rule = 'allow') AS a FROM seen GROUP BY ALL),
    root AS (SELECT host, sum(a) AS ra, sum(b) AS rb FROM a0 GROUP BY host),
    t0 AS (SELECT a0.*, '' AS t, CASE WHEN ra + rb >= {p.min_support} THEN {purity('rb', 'ra')} END AS v FROM a0 JOIN root USING (host))"""
    for k in range(levels):
        chi = " + ".join(f"CASE WHEN {w} > 0 THEN power({o} - n * {w} / pn, 2) / (n * {w} / pn) ELSE 0 END" for o, w in (("b", "pb"), ("a", "pa"), ("(n - b - a)", "(pn - pb - pa)")))
        is_form = "starts_with(s, '{')"
        out += f""",
    br{k} AS (SELECT host, t, shape[{k + 1}] AS s, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(b) AS DOUBLE) AS b, CAST(sum(a) AS DOUBLE) AS a FROM t{k} WHERE shape[{k + 1}] IS NOT NULL AND NOT ends_with(t, '/**') GROUP BY ALL),
    pr{k} AS (SELECT *, sum(n) OVER w AS pn, sum(b) OVER w AS pb, sum(a) OVER w AS pa FROM br{k} WINDOW w AS (PARTITION BY host, t)),
    gn{k} AS (SELECT host, t, s, b, a, CASE WHEN pn < {p.min_pages} THEN '**' WHEN NOT {is_form} AND (n < {p.min_share} * pn OR n < {p.min_pages}) THEN '*' WHEN NOT {is_form} AND {chi} < {p.chi2} THEN '~' ELSE s END AS g FROM pr{k}),
    mg{k} AS (SELECT *, sum(b) OVER w AS mb, sum(a) OVER w AS ma FROM gn{k} WINDOW w AS (PARTITION BY host, t, g)),
    t{k + 1} AS (SELECT x.host, x.shape, x.n, x.b, x.a, CASE WHEN m.g IS NOT NULL THEN concat(x.t, '/', m.g) ELSE x.t END AS t, CASE WHEN ma + mb >= {p.min_support} THEN {purity('mb', 'ma')} ELSE x.v END AS v
      FROM t{k} x LEFT JOIN mg{k} m ON m.host = x.host AND m.t = x.t AND m.s = x.shape[{k + 1}])"""
    last = levels
    return out + f"""
    SELECT s.page_id, s.host, s.path, s.rule, coalesce(s.by_rule, CASE WHEN coalesce(t{last}.v, false) THEN 'block' ELSE 'allow' END) AS verdict, t{last}.t AS template FROM seen s JOIN t{last} ON t{last}.host = s.host AND t{last}.shape = s.shape"""
