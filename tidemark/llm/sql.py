"""The results of training-data queries in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

import unicodedata

from .lookalike import ARMENIAN, CHEROKEE, CYRILLIC, GREEK, LISU

# characters and what they look like, one for one: full-width forms, spaces, letters of other scripts (composed with
# an accent, too)
_LETTERS = {p[0]: p[1] for t in (CYRILLIC, GREEK, ARMENIAN, CHEROKEE, LISU) for p in t.split()}
_WIDE = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
_SPACES = {chr(c): " " for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)}
_ACCENTED = {chr(c): x for c in (*range(0x370, 0x530), *range(0x1F00, 0x2000)) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and d[0] in _LETTERS and len(x := unicodedata.normalize("NFC", _LETTERS[d[0]] + d[1:])) == 1}
_LOOK = _LETTERS | _WIDE | _SPACES | _ACCENTED


def _translated(c: str, table: dict[str, str]) -> str:
    return f"translate({c}, '{''.join(table).replace(chr(39), chr(39) * 2)}', '{''.join(table.values()).replace(chr(39), chr(39) * 2)}')"


def _seen(c: str, table: dict[str, str] = _LOOK) -> str:
    """A text by its look: without invisible characters, composed, other characters as those they look like."""
    bare = f"regexp_replace({c}, '[\\x{{ad}}\\x{{34f}}\\x{{61c}}\\x{{180e}}\\x{{200b}}-\\x{{200f}}\\x{{202a}}-\\x{{202e}}\\x{{2060}}-\\x{{206f}}\\x{{feff}}]', '', 'g')"
    return f"nfc_normalize({_translated(f'nfc_normalize({bare})', table)})"


# words: of each the letters as they look; small letters first unless all of it may be Latin
_WORD = "list_transform(regexp_extract_all({}, '[\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda w: CASE WHEN regexp_full_match({}, '[A-Za-z0-9\\x{{c0}}-\\x{{24f}}]+') THEN lower({}) ELSE {} END)"
_PLAIN = _seen("text", _WIDE | _SPACES)
_WORDS = _WORD.format(_PLAIN, _translated("w", _LOOK), _translated("w", _LOOK), _translated("lower(w)", _LOOK))
# white space that ends an unbroken stretch, and terms
_STRETCH = "list_max(list_transform(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: length(x)))"
_TERMS = "regexp_extract_all(lower({}), '[a-z0-9_]+')"
_RECORD = "concat_ws(' ', summary, path, description, array_to_string(list_transform(params, lambda p: concat_ws(' ', replace(p.name, '_', ' '), p.description)), ' '))"
_COUNTED = f"""t AS (SELECT doc_pos, {_TERMS.format("concat_ws(' ', summary, description)")} AS ts FROM raw_documents),
u AS (SELECT doc_pos, unnest(ts) AS term FROM t),
n AS (SELECT term, count(*) AS occurrences, count(DISTINCT doc_pos) AS records FROM u GROUP BY term),
k AS (SELECT *, CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.25 * (SELECT count(*) FROM raw_documents) THEN 'common' END AS mark FROM n)"""
_TOP = """b AS (SELECT query_text, id, max(score) AS score, min(len) AS len FROM hits WHERE query_text IS NOT NULL AND id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_text ORDER BY score DESC, len, id) AS rank FROM b)"""
_SCORED = f"""t AS (SELECT doc_pos, {_TERMS.format(_RECORD)} AS ts FROM raw_documents),
tf AS (SELECT doc_pos, term, count(*) AS tf, any_value(len) AS len FROM (SELECT doc_pos, len(ts) AS len, unnest(ts) AS term FROM t) GROUP BY ALL),
st AS (SELECT term, count(*) AS df, sum(tf)::DOUBLE AS cf FROM tf GROUP BY term),
al AS (SELECT count(*)::DOUBLE AS n, sum(len(ts))::DOUBLE AS l FROM t),
x AS (SELECT tf.doc_pos, tf.term, tf.tf, st.df, st.cf / al.n AS rate, tf.tf * log2(1 + al.l / al.n / tf.len) AS tfn FROM tf JOIN st USING (term), al),
s AS (SELECT *, (log2(1 + rate) + tfn * log2((1 + rate) / rate)) / (tfn + 1) AS score FROM x)"""

ORACLE: dict[str, str] = {
    "p2_found": f"SELECT doc_pos, CASE WHEN {_STRETCH} > 2000 THEN 'forced' ELSE 'boundary' END AS cut FROM raw_documents WHERE length(text) > 2000",
    "p2_rebuilt": "SELECT doc_pos, md5(text) AS digest, true AS within, true AS shared FROM raw_documents WHERE length(text) > 2000",
    "p3_found": f"WITH {_COUNTED} SELECT term, mark FROM k WHERE mark IS NOT NULL",
    "p3_terms": f"WITH {_COUNTED} SELECT term, occurrences, records, mark FROM k",
    "p4_found": f"WITH {_TOP} SELECT query_text, id FROM r WHERE rank <= 5",
    "p4_ranked": f"WITH {_TOP} SELECT query_text, rank, id, score, len::BIGINT AS len FROM r WHERE rank <= 5",
    "p8_found": f"""WITH dw AS (SELECT doc_id, {_WORDS} AS ws FROM documents WHERE text IS NOT NULL), iw AS (SELECT item_id, {_WORDS} AS ws FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, array_to_string(ws[i:i + 11], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 10)) AS i FROM dw)), ig AS (SELECT item_id, array_to_string(ws[i:i + 11], ' ') AS g FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 10)) AS i FROM iw))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
    "p10_found": f"WITH s AS (SELECT doc_id, text, {_seen('text')} AS look FROM documents WHERE text IS NOT NULL) SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM s a JOIN s b ON a.look = b.look AND a.text <> b.text AND a.doc_id < b.doc_id",
    "p10_classes": f"WITH s AS (SELECT doc_id, text, {_seen('text')} AS look FROM documents WHERE text IS NOT NULL), n AS (SELECT look, min(doc_id) AS class FROM s GROUP BY look HAVING count(DISTINCT text) > 1), t AS (SELECT text, min(doc_id) AS spelling FROM s GROUP BY text) SELECT s.doc_id, n.class, t.spelling FROM s JOIN n USING (look) JOIN t USING (text)",
    "p7_found": f"WITH {_SCORED} SELECT doc_pos, term FROM s WHERE tf >= 3 AND df BETWEEN 2 AND 8",
    "p7_scores": f"WITH {_SCORED} SELECT doc_pos, term, tf, df, round(score, 6) AS score FROM s",
}
