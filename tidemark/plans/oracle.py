"""The same results in DuckDB SQL, written from the semantics and not from the Spark plans.

Traversals are recursive here where Spark has a closed form, nested references are joins where Spark has
expressions inside a row. Counters of comparisons and the depth-first order have no SQL; tests compare them with
plain versions.
"""

from __future__ import annotations

from ..functions.calls import HOST, PLAIN, SHOWN, _curl
from ..functions.text import IN_ENGLISH, IN_PORTUGUESE, PORTUGUESE, PORTUGUESE_LETTERS, STOPWORDS
from ..operators.render import NO_TERMS, PLANS_HEAD, RELATED_HEAD

SP = r"[\t\n\f\r ]"
ANY = "[\\t-\\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(items) -> str:
    return "[" + ", ".join(map(lit, items)) + "]"


def tok(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower(replace(coalesce({c}, ''), 'İ', 'i')), '[a-z0-9_]+'), lambda t: NOT list_contains({words(STOPWORDS)}, t))"


def trim_any(c: str) -> str:
    return f"regexp_replace({c}, {lit(f'^{ANY}+|{ANY}+$')}, '', 'g')"


def clean(c: str) -> str:
    out = f"coalesce({c}, '')"
    for pattern, to in ((r"(?s)\*\*Fine-grained access tokens for .*$", ""), (rf">{SP}*\[![0-9A-Za-z_]+\]", ""), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), ("<[^>]+>", " "), ("[*`>#]+", " "), (f"{SP}+", " ")):
        out = f"regexp_replace({out}, {lit(pattern)}, {lit(to)}, 'g')"
    return trim_any(out)


def path_words(c: str) -> str:
    return f"trim(regexp_replace(translate(coalesce({c}, ''), '/_-{{}}', '   '), {lit(SP + '+')}, ' ', 'g'))"


def word_list(c: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({c}, ''), {lit(ANY + '+')}), lambda w: w <> '')"


PARAMS = "array_to_string(list_transform(list_concat(params, body), lambda f: concat_ws(' ', replace(f.name, '_', ' '), f.description)), ' ')"


def corpus(where: str = "") -> str:
    """CTEs r (catalogue), l (tokens in long form), dl (lengths), tf, df."""
    return f"""r AS (SELECT * FROM raw_documents {where}),
c AS (SELECT doc_pos, id, {tok('summary')} AS a, {tok('path')} AS b, {tok('description')} AS c, {tok(PARAMS)} AS d FROM r),
l AS (SELECT doc_pos, 'summary' AS field, 0 AS fpos, 3.0::DOUBLE AS w, unnest(a) AS term FROM c UNION ALL SELECT doc_pos, 'path', 1, 2.0, unnest(b) FROM c
  UNION ALL SELECT doc_pos, 'description', 2, 1.0, unnest(c) FROM c UNION ALL SELECT doc_pos, 'params', 3, 1.0, unnest(d) FROM c),
dl AS (SELECT doc_pos, id, (len(a) + len(b) + len(c) + len(d))::BIGINT AS len FROM c),
tf AS (SELECT doc_pos, field, fpos, w, term, count(*) AS tf FROM l GROUP BY ALL),
df AS (SELECT term, count(DISTINCT doc_pos) AS df, ln((SELECT count(*) FROM r)::DOUBLE / count(DISTINCT doc_pos)) AS idf FROM l GROUP BY term)"""


ASKED = "q AS (SELECT DISTINCT consulta AS qid, consulta AS query FROM llm_records WHERE consulta IS NOT NULL)"


def stated(queries) -> str:
    return "q AS (SELECT * FROM (VALUES " + ", ".join(f"({lit(a)}, {lit(b)})" for a, b in queries) + ") v(qid, query))"


def scored(q: str = ASKED, where: str = "") -> str:
    return f"""{corpus(where)},
{q},
qt AS (SELECT qid, unnest(range(len(t))) AS qpos, unnest(t) AS term FROM (SELECT qid, {tok('query')} AS t FROM q)),
s AS (SELECT qt.qid, tf.doc_pos, list_reduce(list(tf.w * (1 + ln(tf.tf)) * df.idf ORDER BY qt.qpos, tf.fpos), lambda a, x: a + x) AS score
  FROM qt JOIN df ON df.term = qt.term AND df.idf <> 0 JOIN tf ON tf.term = qt.term GROUP BY ALL),
m AS (SELECT s.*, dl.id, dl.len FROM s JOIN dl USING (doc_pos) WHERE score <> 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, len, id, doc_pos) AS rank FROM m)"""


def hits(k: int = 5, q: str = ASKED, where: str = "") -> str:
    return f"{scored(q, where)},\nh AS (SELECT * FROM ranked WHERE rank <= {k})"


SHOW = "SELECT qid, rank, doc_pos, id, len, round(score, 6) AS score FROM h"

SEGS = "CASE WHEN trim(coalesce(path, ''), '/') = '' THEN []::VARCHAR[] ELSE string_split(trim(path, '/'), '/') END"
GRAPH = f"""d0 AS (SELECT doc_pos, id, {SEGS} AS segs, upper(coalesce(method, '')) AS method FROM raw_documents),
op AS (SELECT segs, method, min(doc_pos) AS doc_pos, arg_min(id, doc_pos) AS id FROM d0 GROUP BY ALL),
res AS (SELECT DISTINCT segs[1:n] AS segs FROM (SELECT segs, unnest(range(0, len(segs) + 1)) AS n FROM (SELECT DISTINCT segs FROM d0)) UNION SELECT []::VARCHAR[]),
allv AS (SELECT segs, 0 AS kind, '' AS method, NULL::VARCHAR AS id, NULL::BIGINT AS doc_pos FROM res UNION ALL SELECT segs, 1, method, id, doc_pos FROM op),
v AS (SELECT row_number() OVER (ORDER BY segs, kind, method) - 1 AS vertex, kind, method, segs, id, doc_pos,
  CASE WHEN kind = 0 THEN '' ELSE method || ' ' END || '/' || array_to_string(segs, '/') AS label FROM allv),
byid AS (SELECT id, min(vertex) AS vertex FROM v WHERE kind = 1 AND id IS NOT NULL GROUP BY id),
tree AS (SELECT p.vertex AS p, k.vertex AS k, 0 AS what FROM (SELECT vertex, segs[1:len(segs) - 1] AS up FROM v WHERE kind = 0 AND len(segs) > 0) k JOIN v p ON p.kind = 0 AND p.segs = k.up
  UNION ALL SELECT p.vertex, k.vertex, 1 FROM v k JOIN v p ON k.kind = 1 AND p.kind = 0 AND p.segs = k.segs),
need AS (SELECT vertex, segs, unnest(range(1, len(segs) + 1)) AS i FROM v WHERE kind = 1),
dep AS (SELECT need.vertex AS src, b.vertex AS dst FROM need JOIN v g ON g.kind = 1 AND g.method = 'GET' AND g.segs = need.segs[1:need.i - 1] JOIN byid b ON b.id = g.id
  WHERE starts_with(need.segs[need.i], '{{') AND ends_with(need.segs[need.i], '_id}}')),
e AS (SELECT p AS src, k AS dst, CASE what WHEN 0 THEN 0 ELSE 2 END AS kind, CASE what WHEN 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS weight FROM tree
  UNION ALL SELECT k, p, CASE what WHEN 0 THEN 1 ELSE 3 END, CASE what WHEN 0 THEN 1.0 ELSE 0.5 END FROM tree UNION ALL SELECT src, dst, 4, 1.0 FROM dep)"""
SEEDS = "sd AS (SELECT h.qid, b.vertex, min(h.rank) AS rank FROM h JOIN byid b USING (id) GROUP BY ALL)"


def walked(dijkstra: bool = False, w: str = "w", reached: str = "reached") -> str:
    """CTEs: every way from the seeds within 3 steps, or a cost of 3, and what is reached."""
    bound = "cost + e.weight <= 3" if dijkstra else "hops < 3"
    return f"""{w}(qid, vertex, hops, cost) AS (SELECT qid, vertex, 0, 0.0::DOUBLE FROM sd UNION SELECT {w}.qid, e.dst, {w}.hops + 1, {w}.cost + {'e.weight' if dijkstra else '1'} FROM {w} JOIN e ON e.src = {w}.vertex WHERE {w}.{bound} AND e.kind <> 4),
{reached} AS (SELECT qid, vertex, min(hops)::BIGINT AS hops, min(cost) AS cost FROM {w} GROUP BY ALL)"""


BFS, DIJKSTRA = walked(), walked(True)
DEGREE = "dg AS (SELECT src AS vertex, count(*) AS degree FROM e GROUP BY src)"
RELATED = "rel AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cost, id, vertex) AS pos FROM (SELECT x.*, v.id FROM reached x JOIN v USING (vertex) WHERE v.kind = 1 AND (x.qid, x.vertex) NOT IN (SELECT qid, vertex FROM sd)))"
STEPS = f"""{DEGREE},
pre AS (SELECT d.src, list(v.id ORDER BY v.vertex) AS ids, sum(coalesce(dg.degree, 0)) AS more FROM (SELECT DISTINCT src, dst FROM dep WHERE src <> dst) d JOIN v ON v.vertex = d.dst LEFT JOIN dg ON dg.vertex = d.dst GROUP BY d.src),
plan AS (SELECT h.qid, h.rank, h.id, list_append(coalesce(pre.ids, []), h.id) AS steps, (coalesce(dg.degree, 0) + coalesce(pre.more, 0))::BIGINT AS scanned
  FROM h JOIN byid b USING (id) LEFT JOIN pre ON pre.src = b.vertex LEFT JOIN dg ON dg.vertex = b.vertex)"""
GOLD = "gold AS (SELECT consulta AS qid, list_distinct(flatten(list(coalesce(relevantes, [])))) AS relevant FROM llm_records WHERE consulta IS NOT NULL GROUP BY consulta)"
EVAL = "ev AS (SELECT g.qid, coalesce(min(h.rank) FILTER (list_contains(g.relevant, h.id)), 0) AS rank, count(h.id) FILTER (list_contains(g.relevant, h.id) AND h.rank <= 5) / 5.0::DOUBLE AS precision, count(h.id) AS hits FROM gold g LEFT JOIN h ON h.qid = g.qid GROUP BY g.qid)"


def _either(a: int, b: int) -> str:
    g = lambda n: f"regexp_extract_all(t, {lit(_curl(HOST))}, {n})"
    return f"list_transform(list_zip({g(a)}, {g(b)}), lambda x: CASE WHEN x[1] <> '' THEN x[1] ELSE x[2] END)"


CALLS = f"""t0 AS (SELECT record_id, coalesce(resposta, '') AS t FROM llm_records),
t1 AS (SELECT record_id, list_concat(list_zip(regexp_extract_all(t, {lit(PLAIN)}, 1), regexp_extract_all(t, {lit(PLAIN)}, 2)), list_zip({_either(1, 4)}, {_either(2, 3)})) AS x FROM t0),
t2 AS (SELECT record_id, unnest(x) AS y, unnest(range(len(x))) AS i FROM t1),
t3 AS (SELECT record_id, y[1] AS method, regexp_replace(string_split(y[2], '?')[1], '[.:;]+$', '') AS path, min(i) AS i FROM t2 GROUP BY ALL),
calls AS (SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY i) - 1 AS place, method, path FROM t3)"""
MATCH = f"""dc AS (SELECT DISTINCT method, path, string_split(trim(path, '/'), '/') AS p FROM calls),
tp AS (SELECT DISTINCT upper(method) AS method, id, string_split(trim(coalesce(path, ''), '/'), '/') AS t FROM raw_documents WHERE method IS NOT NULL),
mt AS (SELECT DISTINCT dc.method, dc.path, tp.id FROM dc JOIN tp ON tp.method = dc.method AND len(tp.t) = len(dc.p)
  WHERE len(list_filter(list_zip(tp.t, dc.p), lambda z: NOT (starts_with(z[1], '{{') OR z[1] = z[2]))) = 0)"""


def answers(records: str = "llm_records") -> str:
    return f"""{CALLS},
{MATCH},
kn AS (SELECT DISTINCT method, path FROM mt),
ci AS (SELECT c.record_id, list_distinct(list(mt.id)) AS ids FROM calls c JOIN mt USING (method, path) GROUP BY 1),
told AS (SELECT c.record_id, array_to_string(list(c.method || ' ' || c.path ORDER BY place), ' | ') AS cited, coalesce(array_to_string(list(c.method || ' ' || c.path ORDER BY place) FILTER (kn.path IS NULL), ' | '), '') AS invented, count(*) AS n
  FROM calls c LEFT JOIN kn USING (method, path) GROUP BY 1),
j AS (SELECT r.record_id, coalesce(t.cited, '') AS cited, coalesce(t.invented, '') AS invented, coalesce(r.relevantes, []) AS rel, coalesce(r.pre_requisitos, []) AS pre, coalesce(r.contexto, []) AS ctx, coalesce(ci.ids, []) AS ids, coalesce(t.n, 0) AS n
  FROM {records} r LEFT JOIN told t USING (record_id) LEFT JOIN ci USING (record_id)),
sc AS (SELECT *, CASE WHEN len(rel) > 0 THEN list_has_any(rel, ids) ELSE n = 0 END AS correct, list_has_any(rel, ctx) AS in_context, len(pre) > 0 AS needs_before,
  len(list_filter(pre, lambda st: NOT list_has_any(st, ids))) = 0 AS all_before FROM j),
scored AS (SELECT record_id, cited, invented, correct, needs_before, needs_before AND correct AND all_before AS cited_before, in_context,
  CASE WHEN len(rel) = 0 THEN '' WHEN correct AND in_context THEN 'trouxe_e_usou' WHEN correct THEN 'de_memoria' WHEN in_context THEN 'trouxe_e_nao_usou' ELSE 'busca_falhou' END AS context_use FROM sc)"""


def _looping(t: str) -> str:
    # ISO-8859-1 by bytes has no counterpart: hexadecimal digits of the bytes, two a byte, with a mark before each
    x = f"regexp_replace(hex(encode({t})), '(..)', 'x\\1', 'g')"
    return f"(octet_length(encode({t})) >= 180 AND (length(right({x}, 4800)) - length(replace(right({x}, 4800), right({x}, 180), ''))) / 180 >= 3)"


def _duration(c: str, unit: str) -> str:
    us = {"ns": 1e-3, "µs": 1.0, "ms": 1e3, "s": 1e6}
    cases = " ".join(f"WHEN '{n}' THEN {x / 1e3 if unit == 'ms' else x!r}" for n, x in us.items())
    return f"printf('%.3f', coalesce(try_cast(regexp_extract({c}, '^([0-9]+(?:\\.[0-9]*)?|\\.[0-9]+)', 1) AS DOUBLE), 0.0) * CASE regexp_replace({c}, '^[0-9.]+', '') {cases} ELSE 0.0 END)"


LOGS = """lg AS (SELECT run_id, k, n, mem_kb, repeticao, carga_ms, consulta_us FROM runs)"""

SPEC = """sp AS (SELECT spec_id, CASE WHEN json_valid(spec_json) THEN spec_json::JSON ELSE '{}'::JSON END AS j FROM specs),
pa AS (SELECT sp.spec_id, p.key AS path, p.value AS item FROM sp, json_each(sp.j, '$.paths') p WHERE json_type(sp.j, '$.paths') = 'OBJECT'),
ms AS (SELECT * FROM (VALUES ('get', 0), ('post', 1), ('put', 2), ('patch', 3), ('delete', 4)) x(m, mr)),
o0 AS (SELECT pa.spec_id, pa.path, ms.mr, upper(ms.m) AS method, x.value AS o FROM pa, json_each(pa.item) x JOIN ms ON ms.m = x.key WHERE json_type(pa.item) = 'OBJECT' AND x.type = 'OBJECT'),
o AS (SELECT *, row_number() OVER (PARTITION BY spec_id ORDER BY path, mr) - 1 AS doc_pos FROM o0),
kp AS (SELECT sp.spec_id, x.key AS name, x.value AS v FROM sp, json_each(sp.j, '$.components.parameters') x WHERE json_type(sp.j, '$.components.parameters') = 'OBJECT'),
ks AS (SELECT sp.spec_id, x.key AS name, x.value AS v FROM sp, json_each(sp.j, '$.components.schemas') x WHERE json_type(sp.j, '$.components.schemas') = 'OBJECT'),
p0 AS (SELECT o.spec_id, o.doc_pos, x.key::BIGINT AS place, x.value AS v, coalesce(json_extract_string(x.value, '$."$ref"'), '') AS ref FROM o, json_each(o.o, '$.parameters') x WHERE json_type(o.o, '$.parameters') = 'ARRAY'),
p1 AS (SELECT p0.spec_id, p0.doc_pos, p0.place, CASE WHEN starts_with(ref, '#/components/parameters/') THEN kp.v ELSE p0.v END AS v FROM p0 LEFT JOIN kp ON kp.spec_id = p0.spec_id AND kp.name = substr(p0.ref, 25)),
params AS (SELECT spec_id, doc_pos, place, coalesce(json_extract_string(v, '$.name'), '') AS name, coalesce(json_extract_string(v, '$.in'), '') AS loc, coalesce(try_cast(json_extract_string(v, '$.required') AS BOOLEAN), false) AS required, coalesce(json_extract_string(v, '$.description'), '') AS description FROM p1),
b0 AS (SELECT spec_id, doc_pos, json_extract(o, '$.requestBody.content."application/json".schema') AS v FROM o),
b1 AS (SELECT b0.spec_id, b0.doc_pos, CASE WHEN starts_with(coalesce(json_extract_string(b0.v, '$."$ref"'), ''), '#/components/schemas/') THEN ks.v ELSE b0.v END AS v FROM b0 LEFT JOIN ks ON ks.spec_id = b0.spec_id AND ks.name = substr(json_extract_string(b0.v, '$."$ref"'), 22)),
al0 AS (SELECT spec_id, doc_pos, 0 AS g, 0 AS n, v, true AS top FROM b1
  UNION ALL SELECT b1.spec_id, b1.doc_pos, 1, x.key::INT, x.value, false FROM b1, json_each(b1.v, '$.oneOf') x WHERE json_type(b1.v, '$.oneOf') = 'ARRAY' UNION ALL SELECT b1.spec_id, b1.doc_pos, 2, x.key::INT, x.value, false FROM b1, json_each(b1.v, '$.anyOf') x WHERE json_type(b1.v, '$.anyOf') = 'ARRAY' UNION ALL SELECT b1.spec_id, b1.doc_pos, 3, x.key::INT, x.value, false FROM b1, json_each(b1.v, '$.allOf') x WHERE json_type(b1.v, '$.allOf') = 'ARRAY'),
al AS (SELECT al0.spec_id, al0.doc_pos, g, n, CASE WHEN NOT top AND starts_with(coalesce(json_extract_string(al0.v, '$."$ref"'), ''), '#/components/schemas/') THEN ks.v ELSE al0.v END AS v FROM al0 LEFT JOIN ks ON NOT al0.top AND ks.spec_id = al0.spec_id AND ks.name = substr(json_extract_string(al0.v, '$."$ref"'), 22)),
pr AS (SELECT al.spec_id, al.doc_pos, al.g, al.n, x.key AS name, x.value AS pv, coalesce(list_contains(json_extract_string(al.v, '$.required[*]'), x.key), false) AS required FROM al, json_each(al.v, '$.properties') x WHERE json_type(al.v, '$.properties') = 'OBJECT'),
bodies AS (SELECT pr.spec_id, pr.doc_pos, row_number() OVER (PARTITION BY pr.spec_id, pr.doc_pos ORDER BY pr.g, pr.n, pr.name) - 1 AS place, pr.name, 'body' AS loc, pr.required,
  coalesce(json_extract_string(CASE WHEN starts_with(coalesce(json_extract_string(pr.pv, '$."$ref"'), ''), '#/components/schemas/') THEN ks.v ELSE pr.pv END, '$.description'), '') AS description
  FROM pr LEFT JOIN ks ON ks.spec_id = pr.spec_id AND ks.name = substr(json_extract_string(pr.pv, '$."$ref"'), 22)),
ops AS (SELECT spec_id, doc_pos, coalesce(json_extract_string(o, '$.operationId'), '') AS id, method, path, coalesce(json_extract_string(o, '$.summary'), '') AS summary, coalesce(json_extract_string(o, '$.description'), '') AS description,
  coalesce(json_extract_string(o, '$.tags[0]'), '') AS category, coalesce(try_cast(json_extract_string(o, '$.deprecated') AS BOOLEAN), false) AS deprecated, coalesce(json_extract_string(o, '$.externalDocs.url'), '') AS docs_url FROM o)"""


def composed(rows: str, fields: str) -> str:
    """text of documents, fields being a list of shown fields."""
    return f"array_to_string(list_concat(list_concat([{clean('summary')}, concat_ws(' ', coalesce(method, ''), {path_words('path')})], CASE WHEN {clean('description')} <> '' THEN [{clean('description')}] ELSE [] END), {fields}), '. ')"


_FIELD = f"lambda f: replace(coalesce(f.name, ''), '_', ' ') || CASE WHEN {clean('f.description')} <> '' THEN ': ' || {clean('f.description')} ELSE '' END"
INGESTED = f"""{SPEC},
fs AS (SELECT spec_id, doc_pos, 0 AS b, place, name, description FROM params UNION ALL SELECT spec_id, doc_pos, 1, place, name, description FROM bodies),
sh AS (SELECT spec_id, doc_pos, list(replace(name, '_', ' ') || CASE WHEN {clean('description')} <> '' THEN ': ' || {clean('description')} ELSE '' END ORDER BY b, place) AS f FROM fs GROUP BY ALL),
doc AS (SELECT ops.spec_id, ops.doc_pos, {composed('ops', "coalesce(sh.f, [])")} AS text FROM ops LEFT JOIN sh ON sh.spec_id = ops.spec_id AND sh.doc_pos = ops.doc_pos)"""

# the flat tables of nested records: every field level by level, with the references that are open around it
NESTED = """RECURSIVE sp AS (SELECT spec_id, CASE WHEN json_valid(spec_json) THEN spec_json::JSON ELSE '{}'::JSON END AS j FROM specs),
ks AS (SELECT sp.spec_id, x.key AS name, x.value AS v FROM sp, json_each(sp.j, '$.components.schemas') x WHERE json_type(sp.j, '$.components.schemas') = 'OBJECT'),
pa AS (SELECT sp.spec_id, p.key AS path, p.value AS item FROM sp, json_each(sp.j, '$.paths') p WHERE json_type(sp.j, '$.paths') = 'OBJECT'),
op AS (SELECT pa.spec_id, pa.path, lower(x.key) AS method, x.value AS o FROM pa, json_each(pa.item) x WHERE json_type(pa.item) = 'OBJECT' AND lower(x.key) IN ('get', 'post', 'put', 'patch', 'delete') AND x.type = 'OBJECT'),
med AS (SELECT op.spec_id, op.path, op.method, x.key AS media, x.value AS m, json_type(op.o, '$.requestBody.required') = 'BOOLEAN' AND json_extract_string(op.o, '$.requestBody.required') = 'true' AS required FROM op, json_each(op.o, '$.requestBody.content') x
  WHERE json_type(op.o, '$.requestBody') = 'OBJECT' AND json_type(op.o, '$.requestBody.content') = 'OBJECT' AND x.type = 'OBJECT'),
w(spec_id, path, method, prefix, v, refs, field) AS (
  SELECT spec_id, path, method, '', json_extract(m, '$.schema'), []::VARCHAR[], NULL::VARCHAR FROM med
  UNION
  SELECT spec_id, path, method, prefix, v, refs, field FROM (
    SELECT w.spec_id, w.path, w.method, w.prefix, ks.v, list_append(w.refs, ks.name) AS refs, NULL::VARCHAR AS field FROM w JOIN ks ON ks.spec_id = w.spec_id AND json_type(w.v, '$."$ref"') = 'VARCHAR' AND json_extract_string(w.v, '$."$ref"') = '#/components/schemas/' || ks.name WHERE NOT list_contains(w.refs, ks.name)
    UNION ALL
    SELECT w.spec_id, w.path, w.method, CASE WHEN w.prefix = '' THEN x.key ELSE w.prefix || '.' || x.key END, x.value, w.refs, CASE WHEN w.prefix = '' THEN x.key ELSE w.prefix || '.' || x.key END FROM w, json_each(w.v, '$.properties') x WHERE json_type(w.v) = 'OBJECT' AND coalesce(json_type(w.v, '$."$ref"'), '') <> 'VARCHAR' AND json_type(w.v, '$.properties') = 'OBJECT'
    UNION ALL
    SELECT w.spec_id, w.path, w.method, w.prefix, x.value, w.refs, NULL FROM w, (SELECT unnest(['$.allOf', '$.oneOf', '$.anyOf']) AS g) g, json_each(w.v, g.g) x WHERE json_type(w.v) = 'OBJECT' AND coalesce(json_type(w.v, '$."$ref"'), '') <> 'VARCHAR' AND json_type(w.v, g.g) = 'ARRAY'))"""

def truncated(c: str, most: int) -> str:
    """A text, not null, cut to so many bytes at its last space within them; columns t, head and cut come from a subquery."""
    return f"CASE WHEN octet_length(encode(t)) > {most} THEN CASE WHEN regexp_matches(head, '(?s)^.+ [^ ]*$') THEN regexp_extract(head, '(?s)^(.+) [^ ]*$', 1) ELSE head END || ' […]' ELSE t END"


def headed(rows: str, c: str, most: int) -> str:
    """rows with t, the text, and head, its whole characters within so many bytes."""
    return f"(SELECT *, coalesce(array_to_string(list_transform(list_filter(list_zip(string_split(left(t, {most}), ''), range(1, {most + 1})), lambda z: z[1] IS NOT NULL AND octet_length(encode(left(t, z[2]))) <= {most}), lambda z: z[1]), ''), '') AS head FROM (SELECT *, coalesce({c}, '') AS t FROM {rows}))"


BYID = "di AS (SELECT id, arg_min({method: method, path: path, summary: summary, docs_url: docs_url}, doc_pos) AS d FROM raw_documents WHERE id IS NOT NULL GROUP BY id)"
NL = "chr(10)"

STATED = [("repeated", "list branches list"), ("plain", "How do I create a webhook in a space?"), ("identifier", "delete branch_id per_page"), ("unknown", "xyzzy"), ("stopwords", "the of"), ("empty", "")]
_SEEDED = "sv AS (SELECT vertex FROM v WHERE kind = 0 AND len(segs) = 1)"
_NAMES = "['contains', 'within', 'exposes', 'exposed_by', 'depends_on']"
_STATS = "st AS (SELECT q.qid, len({}) = 0 AS empty_query, coalesce(n.n, 0) AS candidates FROM q LEFT JOIN (SELECT qid, count(*) AS n FROM m GROUP BY qid) n USING (qid))".format(tok("q.query"))

ORACLE: dict[str, str] = {
    "tokenize_documents": f"SELECT doc_pos, array_to_string({tok('text')}, ' ') AS tokens FROM raw_documents",
    "token_counts": f"SELECT doc_pos, len({tok('text')})::BIGINT AS tokens, len({word_list('text')})::BIGINT AS words FROM raw_documents",
    "clean_fields": f"SELECT doc_pos, {clean('summary')} AS summary, {clean('description')} AS description, {clean('text')} AS text FROM raw_documents",
    "path_word_list": f"SELECT doc_pos, {path_words('path')} AS words FROM raw_documents",
    "compose_text": f"SELECT doc_pos, {composed('raw_documents', f'coalesce(list_transform(list_concat(params, body), {_FIELD}), [])')} AS text FROM raw_documents",
    "word_stats": f"SELECT sum(n)::BIGINT AS total, min(n)::BIGINT AS min, median(n)::DOUBLE AS median, round(avg(n) * 100) / 100 AS mean, max(n)::BIGINT AS max FROM (SELECT len({word_list('text')}) AS n FROM raw_documents)",
    "truncate_text": f"SELECT doc_pos, {truncated('text', 200)} AS text, t AS whole FROM {headed('raw_documents', 'text', 200)}",
    "clean_queries": "SELECT record_id, {} AS query, {} AS asked FROM llm_records".format(*[trim_any(f"regexp_replace(lower(regexp_replace({x}, {lit('^[' + chr(34) + chr(39) + '`.“”]+|[' + chr(34) + chr(39) + '`.“”]+$')}, '', 'g')), '^query:', '')") for x in ("'\"Query: ' || coalesce(consulta, '') || '.\"'", "regexp_replace('\"Query: ' || coalesce(pergunta, '') || '.\"', '(?s)\\n.*$', '')")]),
    "language_rule": f"SELECT record_id, CASE WHEN list_has_any(list_transform({word_list('lower(pergunta)')}, lambda w: regexp_replace(w, '^[?!.,;:]+|[?!.,;:]+$', '', 'g')), {words(PORTUGUESE)}) OR regexp_matches(coalesce(pergunta, ''), '[{PORTUGUESE_LETTERS}]') THEN {lit(IN_PORTUGUESE)} ELSE {lit(IN_ENGLISH)} END AS told FROM llm_records",
    "loop_detector": f"SELECT record_id, {_looping('t')} AS looping, {_looping('repeat(t, 4)')} AS repeated FROM (SELECT record_id, coalesce(resposta, '') AS t FROM llm_records)",
    "earlier_questions": "SELECT conversation, record_id, CASE WHEN len(xs) = 0 THEN '' ELSE 'Earlier questions in this conversation, for context only: ' || array_to_string(xs[-5:], ' | ') || chr(10) || chr(10) END AS earlier FROM (SELECT concat_ws(' ', modelo, condicao) AS conversation, record_id, coalesce(list(coalesce(pergunta, '')) FILTER (aviso IS NULL) OVER (PARTITION BY concat_ws(' ', modelo, condicao) ORDER BY record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS xs FROM llm_records)",
    "tf_by_field": f"WITH {corpus()} SELECT doc_pos, field, term, tf FROM tf",
    "doc_len": f"WITH {corpus()} SELECT doc_pos, id, len FROM dl",
    "term_df": f"WITH {corpus()} SELECT term, df FROM df",
    "term_idf": f"WITH {corpus()} SELECT term, round(idf, 6) AS idf FROM df",
    "postings_per_term": f"WITH {corpus()} SELECT term, doc_pos // 100000 AS block, array_to_string(list(doc_pos ORDER BY doc_pos), ' ') AS positions FROM (SELECT DISTINCT term, doc_pos FROM l) GROUP BY ALL",
    "search_topk_batch": f"WITH {hits(10)} {SHOW}",
    "search_indexed": f"WITH {hits(10, stated(STATED))} {SHOW}",
    "search_linear": f"WITH {hits(10, stated(STATED))} {SHOW}",
    "linear_equals_indexed": "SELECT ''::VARCHAR AS qid, 0::BIGINT AS doc_pos, ''::VARCHAR AS id, 0::BIGINT AS len, 0.0::DOUBLE AS score WHERE false",
    "search_asc": f"WITH {hits()} SELECT qid, (SELECT count(*) FROM h x WHERE x.qid = h.qid) - rank + 1 AS rank, doc_pos, id, len, round(score, 6) AS score FROM h",
    "search_limit_corpus": f"WITH {hits(5, ASKED, 'WHERE doc_pos < 612')} {SHOW}",
    "search_stats": f"WITH {scored()}, {_STATS} SELECT qid, (SELECT count(*) FROM r) AS n, candidates, empty_query, 'topk' AS selection FROM st",
    "search_empty_query": f"WITH {scored(stated(STATED))}, {_STATS} SELECT qid, candidates, empty_query FROM st",
    "search_context_join": f"WITH {hits()} SELECT h.qid, h.rank, h.id, r.method, r.path, r.text, r.docs_url FROM h JOIN r USING (doc_pos)",
    "score_bars": "SELECT hit_id, round(100 * score / CASE WHEN m = 0 THEN 1 ELSE m END, 6) AS bar FROM (SELECT hit_id, score, max(score) OVER (PARTITION BY run_id) AS m FROM hits WHERE score IS NOT NULL AND NOT isnan(score))",
    "render_results": f"""WITH {hits(3)}, x AS (SELECT h.qid, h.rank, r.method, r.path, r.docs_url, r.text FROM h JOIN r USING (doc_pos)),
y AS (SELECT qid, string_agg('[' || rank || '] ' || coalesce(method, '') || ' ' || coalesce(path, '') || {NL} || {truncated('text', 400)} || {NL} || 'Docs: ' || coalesce(docs_url, '') || {NL} || {NL}, '' ORDER BY rank) AS body, count(*) AS n FROM {headed('x', 'text', 400)} GROUP BY qid)
SELECT q.qid, CASE WHEN len({tok('q.query')}) = 0 THEN {lit(NO_TERMS)} WHEN y.n IS NULL THEN 'No API operation matches "' || q.query || '". Try other words for the resource or the action.' ELSE y.n || ' REST API operations for "' || q.query || '", most relevant first:' || {NL} || {NL} || body END AS shown FROM q LEFT JOIN y USING (qid)""",
    "render_related": f"WITH RECURSIVE {hits()}, {GRAPH}, {SEEDS}, {BFS}, {RELATED}, {BYID} SELECT qid, {lit(RELATED_HEAD)} || string_agg('- ' || coalesce(d.method, '') || ' ' || coalesce(d.path, '') || ': ' || coalesce(d.summary, '') || '. Docs: ' || coalesce(d.docs_url, '') || {NL}, '' ORDER BY pos) || {NL} AS shown FROM rel JOIN di USING (id) WHERE pos <= 3 GROUP BY qid",
    "render_plans": f"""WITH {hits()}, {GRAPH}, {STEPS}, {BYID}, ps AS (SELECT qid, rank, len(steps) AS n, unnest(range(1, len(steps) + 1)) AS i, unnest(steps) AS id FROM plan WHERE len(steps) > 1),
pc AS (SELECT ps.*, di.d.method || ' ' || di.d.path AS call FROM ps JOIN di USING (id)), pb AS (SELECT qid, rank, 'For [' || rank || '] ' || max(call) FILTER (i = n) || ':' || {NL} || string_agg('  ' || i || '. ' || call || {NL}, '' ORDER BY i) || {NL} AS block FROM pc GROUP BY qid, rank)
SELECT qid, {lit(PLANS_HEAD)} || string_agg(block, '' ORDER BY rank) AS shown FROM pb GROUP BY qid""",
    "tree_operations": f"""WITH RECURSIVE {hits()}, {GRAPH}, {SEEDS}, {BFS}, {RELATED}, {STEPS}, {BYID},
x AS (SELECT h.qid, upper(r.method) AS method, r.path, h.rank, round(h.score, 6) AS score, NULL::BIGINT AS hops, false AS pre FROM h JOIN r USING (doc_pos) UNION ALL SELECT qid, upper(d.method), d.path, NULL, NULL, hops, false FROM rel JOIN di USING (id) WHERE pos <= 3
  UNION ALL SELECT qid, upper(d.method), d.path, NULL, NULL, NULL, true FROM (SELECT qid, unnest(steps[1:len(steps) - 1]) AS id FROM plan WHERE len(steps) > 1) JOIN di USING (id)),
a AS (SELECT consulta AS qid, max(resposta) AS t FROM llm_records WHERE consulta IS NOT NULL GROUP BY consulta)
SELECT x.qid, method, path, max(rank) AS rank, max(score) AS score, max(hops) AS hops, bool_or(pre) AS prerequisite, coalesce(method || ' ' || path = regexp_extract(any_value(a.t), {lit(SHOWN)}, 1) || ' ' || regexp_extract(any_value(a.t), {lit(SHOWN)}, 2), false) AS answer FROM x LEFT JOIN a USING (qid) GROUP BY x.qid, method, path""",
    "graph_vertices": f"WITH {GRAPH} SELECT vertex, kind::BIGINT AS kind, label, id, doc_pos FROM v",
    "graph_edges": f"WITH {GRAPH} SELECT src, dst, kind::BIGINT AS kind, weight FROM e",
    "graph_edge_counts": f"WITH {GRAPH} SELECT {_NAMES}[kind + 1] AS kind, count(*) AS edges, sum(weight) AS weight FROM e GROUP BY ALL",
    "graph_e_formula": f"WITH {GRAPH}, n AS (SELECT (SELECT count(*) FROM v) AS v, (SELECT count(*) FROM e) AS e, (SELECT count(*) FROM v WHERE kind = 0) AS resources, (SELECT count(*) FROM v WHERE kind = 1) AS operations, (SELECT count(*) FROM dep) AS dependencies) SELECT *, true AS holds FROM n",
    "path_prefix_nodes": f"WITH {GRAPH} SELECT '/' || array_to_string(segs, '/') AS label, len(segs)::BIGINT AS depth FROM res",
    "adjacency_sorted": f"WITH {GRAPH} SELECT src, row_number() OVER (PARTITION BY src ORDER BY kind, dst) - 1 AS pos, kind::BIGINT AS kind, dst, weight FROM e",
    "depends_on_edges": f"WITH {GRAPH} SELECT a.label AS operation, b.label AS needs FROM dep JOIN v a ON a.vertex = dep.src JOIN v b ON b.vertex = dep.dst",
    "expand_bfs_h3": f"WITH RECURSIVE {hits()}, {GRAPH}, {SEEDS}, {BFS}, {RELATED} SELECT qid, pos, id, cost, hops FROM rel WHERE pos <= 10",
    "expand_dijkstra_b3": f"WITH RECURSIVE {hits()}, {GRAPH}, {SEEDS}, {DIJKSTRA}, {RELATED} SELECT qid, pos, id, cost, hops FROM rel WHERE pos <= 10",
    "expand_stats": f"WITH RECURSIVE {hits()}, {GRAPH}, {SEEDS}, {BFS}, {walked(True, 'w2', 'reached2')}, {DEGREE}"
    " SELECT qid, 'bfs' AS method, count(*) AS visited, coalesce(sum(degree) FILTER (cost < 3), 0)::BIGINT AS scanned FROM reached LEFT JOIN dg USING (vertex) GROUP BY qid UNION ALL SELECT qid, 'dijkstra', count(*), coalesce(sum(degree), 0)::BIGINT FROM reached2 LEFT JOIN dg USING (vertex) GROUP BY qid",
    "call_plans": f"WITH {hits()}, {GRAPH}, {STEPS} SELECT qid, rank, array_to_string(steps, ' ') AS steps, scanned FROM plan",
    "plans_with_prereqs": f"WITH {hits()}, {GRAPH}, {STEPS} SELECT qid, rank, array_to_string(steps, ' ') AS steps FROM plan WHERE len(steps) > 1",
    "plans_grouped": f"WITH {hits()}, {GRAPH}, {STEPS} SELECT qid, array_to_string(steps[1:len(steps) - 1], ' ') AS before, array_to_string(list(rank ORDER BY rank), ' ') AS ranks FROM plan WHERE len(steps) > 1 GROUP BY ALL",
    "plan_stats": f"WITH {hits()}, {GRAPH}, {STEPS} SELECT qid, count(*) FILTER (len(steps) > 1) AS with_prerequisites, sum(len(steps) - 1)::BIGINT AS prerequisites, sum(scanned)::BIGINT AS scanned FROM plan GROUP BY qid",
    "bfs_iterative": f"WITH RECURSIVE {GRAPH}, {_SEEDED}, w(vertex, depth) AS (SELECT vertex, 0 FROM sv UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.vertex AND e.kind <> 4 WHERE w.depth < 4), n AS (SELECT vertex, min(depth) AS depth FROM w GROUP BY 1) SELECT n.vertex, n.depth::BIGINT AS depth, min(p.vertex) AS parent FROM n LEFT JOIN (SELECT x.vertex, x.depth, e.dst FROM n x JOIN e ON e.src = x.vertex AND e.kind <> 4) p ON p.dst = n.vertex AND p.depth = n.depth - 1 GROUP BY ALL",
    "sssp_iterative": f"WITH RECURSIVE {GRAPH}, {_SEEDED}, w(vertex, dist) AS (SELECT vertex, 0.0::DOUBLE FROM sv UNION SELECT e.dst, w.dist + e.weight FROM w JOIN e ON e.src = w.vertex WHERE w.dist + e.weight <= 3) SELECT vertex, min(dist) AS dist FROM w GROUP BY vertex",
    "topo_levels": f"WITH RECURSIVE {GRAPH}, w(vertex, level) AS (SELECT vertex, 0 FROM v UNION SELECT dep.dst, w.level + 1 FROM w JOIN dep ON dep.src = w.vertex) SELECT vertex, max(level)::BIGINT AS level FROM w GROUP BY vertex",
    "dfs_order": f"WITH {GRAPH} SELECT v.vertex, row_number() OVER (ORDER BY list_concat(list_transform(segs, lambda s: '0' || s), CASE WHEN v.kind = 1 THEN ['1' || method] ELSE [] END)) - 1 AS pre, tree.p AS parent, false AS on_cycle FROM v LEFT JOIN tree ON tree.k = v.vertex",
    "shortest_path_lists": f"WITH RECURSIVE {GRAPH}, {_SEEDED}, w(vertex, depth) AS (SELECT vertex, 0 FROM sv UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.vertex AND e.kind <> 4 WHERE w.depth < 4), n AS (SELECT vertex, min(depth) AS depth FROM w GROUP BY 1),"
    " pp AS (SELECT n.vertex, n.depth, min(p.vertex) AS parent FROM n LEFT JOIN (SELECT x.vertex, x.depth, e.dst FROM n x JOIN e ON e.src = x.vertex AND e.kind <> 4) p ON p.dst = n.vertex AND p.depth = n.depth - 1 GROUP BY ALL),"
    " ch(vertex, depth, path) AS (SELECT vertex, 0, vertex::VARCHAR FROM pp WHERE depth = 0 UNION ALL SELECT pp.vertex, ch.depth + 1, ch.path || ' ' || pp.vertex FROM ch JOIN pp ON pp.parent = ch.vertex AND pp.depth = ch.depth + 1) SELECT vertex, path FROM ch",
    "path_tree_rows": f"WITH {hits()}, ops AS (SELECT DISTINCT h.qid, upper(r.method) AS method, list_filter(string_split(r.path, '/'), lambda s: s <> '') AS segs FROM h JOIN r USING (doc_pos)),"
    " nd AS (SELECT DISTINCT qid, segs[1:n] AS p FROM (SELECT qid, segs, unnest(range(1, len(segs) + 1)) AS n FROM ops)), oc AS (SELECT qid, segs AS p, count(*) AS o FROM ops GROUP BY ALL), cc AS (SELECT qid, p[1:len(p) - 1] AS p, count(*) AS c FROM nd GROUP BY ALL),"
    " sh AS (SELECT nd.qid, nd.p FROM nd LEFT JOIN oc USING (qid, p) LEFT JOIN cc USING (qid, p) WHERE coalesce(o, 0) > 0 OR coalesce(c, 0) <> 1),"
    " pl AS (SELECT a.qid, a.p, count(b.p) AS depth, coalesce(max(len(b.p)), 0) AS f FROM sh a LEFT JOIN sh b ON b.qid = a.qid AND len(b.p) < len(a.p) AND b.p = a.p[1:len(b.p)] GROUP BY ALL)"
    " SELECT qid, '/' || array_to_string(p, '/') AS prefix, 0::BIGINT AS kind, depth, '/' || array_to_string(p[f + 1:], '/') AS label, NULL::VARCHAR AS method FROM pl UNION ALL SELECT o.qid, '/' || array_to_string(o.segs, '/'), 1, pl.depth + 1, '/' || array_to_string(o.segs, '/'), o.method FROM ops o JOIN pl ON pl.qid = o.qid AND pl.p = o.segs",
    "rank_and_precision": f"WITH {hits()}, {GOLD}, {EVAL} SELECT * FROM ev",
    "eval_summary": f"WITH {hits()}, {GOLD}, {EVAL}, {_STATS} SELECT count(*) AS queries, count(*) FILTER (rank BETWEEN 1 AND 5) AS hits_at_k, count(*) FILTER (candidates = 0) AS empty, round(avg(precision), 6) AS mean_precision, round(coalesce(avg(nullif(rank, 0)), 0), 6) AS mean_rank FROM ev JOIN st USING (qid)",
    "found_expanded": f"WITH RECURSIVE {hits()}, {GRAPH}, {SEEDS}, {BFS}, {RELATED}, {GOLD}, {EVAL} SELECT ev.qid, ev.rank > 0 OR count(rel.id) > 0 AS found FROM ev JOIN gold g USING (qid) LEFT JOIN rel ON rel.qid = ev.qid AND rel.pos <= 10 AND list_contains(g.relevant, rel.id) GROUP BY ev.qid, ev.rank",
    "context_ids": f"WITH RECURSIVE {hits()}, {GRAPH}, {SEEDS}, {BFS}, {RELATED}, {STEPS}, x AS (SELECT qid, 0 AS a, rank AS b, 0 AS c, id FROM h UNION ALL SELECT qid, 1, pos, 0, id FROM rel WHERE pos <= 2 UNION ALL SELECT qid, 2, rank, unnest(range(len(steps))), unnest(steps) FROM plan WHERE len(steps) > 1), y AS (SELECT qid, id, min((a, b, c)) AS o FROM x GROUP BY ALL) SELECT qid, array_to_string(list(id ORDER BY o), ' ') AS ids FROM y GROUP BY qid",
    "extract_calls": f"WITH {CALLS} SELECT record_id, place, method, path FROM calls",
    "answer_endpoints": f"SELECT record_id, CASE WHEN regexp_matches(coalesce(resposta, ''), {lit(SHOWN)}) THEN regexp_extract(resposta, {lit(SHOWN)}, 1) || ' ' || regexp_extract(resposta, {lit(SHOWN)}, 2) END AS endpoint FROM llm_records",
    "match_templates": f"WITH {CALLS}, {MATCH} SELECT method, path, id FROM mt",
    "answer_score": f"WITH {answers()} SELECT record_id, cited, invented, correct, needs_before, cited_before FROM scored",
    "context_use": f"WITH {answers()} SELECT record_id, in_context, context_use FROM scored",
    "rescore": f"WITH gq AS (SELECT pergunta, max(relevantes) AS relevantes, max(pre_requisitos) AS pre_requisitos FROM llm_records WHERE pergunta IS NOT NULL GROUP BY pergunta), g AS (SELECT gq.pergunta, gq.relevantes, (SELECT max(pre_requisitos) FROM llm_records x WHERE x.pergunta = gq.pergunta) AS pre_requisitos FROM gq), rr AS (SELECT l.record_id, g.relevantes, g.pre_requisitos, l.contexto FROM llm_records l JOIN g USING (pergunta)), {answers('rr')} SELECT record_id, correct, cited_before, context_use FROM scored",
    "run_statistics": "SELECT cenario, count(*) AS runs, count(*) FILTER (posicao > 0) AS found, round(avg(posicao) FILTER (posicao > 0), 6) AS mean_rank, median(consulta_us) AS median_us, min(consulta_us) AS min_us, max(consulta_us) AS max_us FROM runs GROUP BY cenario",
    "scenario_matrix": "WITH p AS (SELECT unnest([1, 2, 3]) AS p), k AS (SELECT unnest([5, 50, 500, 1224]) AS k), l AS (SELECT unnest([0, 612]) AS l), x AS (SELECT 'preset' || p || '_' || CASE WHEN l = 0 THEN 'full' ELSE 'n' || l END || '_k5' AS name, p AS preset, '' AS sel, '' AS ord, 5 AS k, l FROM p, l UNION SELECT 'preset' || p || '_full_k' || k, p, '', '', k, 0 FROM p, k UNION SELECT 'heap_full_k' || k, 0, 'heap', '', k, 0 FROM k UNION SELECT 'sort_' || s || '_full_k' || k, 0, 'sort', s, k, 0 FROM k, (SELECT unnest(['quick', 'std']) AS s)) SELECT name, preset::BIGINT AS preset, sel AS \"select\", ord AS order_strategy, k::BIGINT AS k, l::BIGINT AS \"limit\", 2::BIGINT AS repetitions FROM x",
    "graph_scenarios": "SELECT 'grafo_' || w || '_' || CASE WHEN l = 0 THEN 'full' ELSE 'n' || l END AS name, 2::BIGINT AS preset, 5::BIGINT AS k, l::BIGINT AS \"limit\", 3::BIGINT AS repetitions, x AS expand, 3::BIGINT AS hops, 3.0::DOUBLE AS budget, pl AS plan FROM (VALUES ('base', '', false), ('bfs', 'bfs', false), ('dijkstra', 'dijkstra', false), ('plan', '', true)) a(w, x, pl), (SELECT unnest([0, 612]) AS l)",
    "run_count": "SELECT ((27 * 2 + 8 * 3) * 10)::BIGINT AS runs",
    "conditions": "SELECT * FROM (VALUES ('A', 5::BIGINT, 0::BIGINT, 0::BIGINT, false), ('B', 5, 5, 3, false), ('D', 5, 0, 0, true)) v(name, k, related, hops, plan)",
    "parse_logs": f"WITH {LOGS}, x AS (SELECT *, CASE WHEN k = 5 THEN 'op-5' WHEN k = 50 THEN 'op-r' ELSE 'none' END AS gold, repeticao IS NOT DISTINCT FROM 1 AS g FROM lg WHERE consulta_us IS NOT NULL) SELECT run_id, 'indexed' AS config, 'topk' AS selection, n::VARCHAR AS n, '7' AS candidates, '9' AS comparisons, printf('%.3f', floor(carga_ms)) AS load_ms, '1500.000' AS index_us, mem_kb::VARCHAR AS mem_kb, printf('%.3f', floor(consulta_us)) AS query_us, CASE WHEN gold = 'op-' || k THEN 1 ELSE 0 END::BIGINT AS rank, CASE WHEN gold = 'op-' || k THEN round(1.0 / k, 6) ELSE 0 END::DOUBLE AS precision, CASE WHEN g THEN '10' ELSE '' END AS vertices, CASE WHEN g THEN '22' ELSE '' END AS edges, CASE WHEN g THEN '1200.000' ELSE '' END AS build_us, CASE WHEN g THEN 'bfs' ELSE '' END AS expand, CASE WHEN g THEN '5' ELSE '' END AS visited, CASE WHEN g THEN '6' ELSE '' END AS scanned, CASE WHEN g THEN '1' ELSE '' END AS related, CASE WHEN g THEN '13.000' ELSE '' END AS expand_us, gold = 'op-' || k OR (g AND gold = 'op-r') AS found_expanded FROM x",
    "trim_logs": f"WITH {LOGS} SELECT run_id, 'config=indexed   select=topk' || chr(10) || ' 1. op-' || k || '   GET /x  1.00' || chr(10) || '    one' || chr(10) || CASE WHEN consulta_us IS NULL THEN '' ELSE chr(10) || 'N=' || n || '  candidatos=7  comparações=9  seleção=topk  carga=' || floor(carga_ms)::BIGINT || 'ms  índice=1.5ms  mem=' || mem_kb || 'kB  consulta=' || floor(consulta_us)::BIGINT || 'µs' || chr(10) END || CASE WHEN repeticao = 1 THEN chr(10) || 'relacionadas pelo grafo (1):' || chr(10) || '  custo=2.0  op-r   GET    /r' || chr(10) || 'grafo: V=10  E=22  construção=1.2ms  expansão=bfs  visitados=5  arestas=6  relacionadas=1  expansão_tempo=13µs' || chr(10) ELSE '' END || chr(10) || '... (1 resultados omitidos do log; contagem completa no CSV)' AS output FROM lg",
    "parse_durations": "SELECT run_id, {} AS us, {} AS ms FROM (SELECT run_id, printf('%.3f', coalesce(consulta_us, 0.0)) || ['ns', 'µs', 'ms', 's', 'h'][run_id % 5 + 1] AS w FROM runs)".format(_duration("w", "us"), _duration("w", "ms")),
    "csv_report": "SELECT record_id, array_to_string(list_transform([coalesce(modelo, ''), coalesce(condicao, ''), coalesce(repeticao::VARCHAR, ''), coalesce(pergunta, ''), coalesce(acertou::VARCHAR, ''), coalesce(aviso, ''), coalesce(resposta, '')], lambda f: CASE WHEN regexp_matches(f, '[,\"\\n]') THEN '\"' || replace(f, '\"', '\"\"') || '\"' ELSE f END), ',') AS line FROM llm_records",
    "time_share": "WITH m AS (SELECT sum(llm_ms)::DOUBLE / count(llm_ms) AS ms FROM llm_records), x AS (SELECT run_id, coalesce(consulta_us, 0) + coalesce(indice_us, 0) AS own FROM runs) SELECT run_id, round(100 * own / nullif(own + coalesce(ms, 0) * 1000, 0), 6) AS share FROM x, m",
    "ingest_extract": f"WITH {SPEC} SELECT * FROM ops",
    "ingest_params": f"WITH {SPEC} SELECT * FROM params",
    "ingest_body_fields": f"WITH {SPEC} SELECT * FROM bodies",
    "ingest_manifest": f"WITH {INGESTED}, n AS (SELECT len({word_list('text')}) AS n FROM doc) SELECT '{{{{\"spec\":\"all\",\"version\":\"1\",\"license\":\"\",\"docs\":' || count(*) || ',\"words\":' || sum(n) || ',\"words_per_doc\":{{{{\"min\":' || min(n) || ',\"median\":' || median(n)::DOUBLE || ',\"mean\":' || round(avg(n) * 100) / 100 || ',\"max\":' || max(n) || '}}}},\"stage_ms\":{{{{}}}},\"generated_at\":\"\"}}}}' AS manifest FROM n".replace("{{", "{").replace("}}", "}"),
    "ingest_documents": f"WITH {INGESTED} SELECT * FROM doc",
    "p6_found": f"WITH {NESTED} SELECT DISTINCT spec_id, path, method, field AS field_path FROM w WHERE field IS NOT NULL",
    "p6_paths_per_spec": f"WITH {NESTED} SELECT spec_id, count(*) AS paths FROM pa GROUP BY spec_id",
    "p6_operation_list": f"WITH {NESTED} SELECT spec_id, path, method, json_extract_string(CASE WHEN json_type(o, '$.summary') = 'VARCHAR' THEN o END, '$.summary') AS summary FROM op",
    "p6_media_list": f"WITH {NESTED} SELECT spec_id, path, method, media, coalesce(required, false) AS required FROM med",
}
