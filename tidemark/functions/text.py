"""Text as column expressions: tokens, cleaning, composition and the small rules of a conversation.

All of it is JVM-side. Byte-wise rules read the UTF-8 bytes as ISO-8859-1, one character a byte. Null counts as
the empty string, unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no search terms.
STOPWORDS = "the a an of to in for is are and or not this that with by on be can you your will if it as at from all any only must use using see more need without when which has have was were been also".split()
# Words that tell a question in Portuguese.
PORTUGUESE = "como qual quais eu uma pra para que meu minha não nao você voce é faço faco criar crio apagar apago deletar excluir listar listo buscar pegar editar atualizar fechar abrir cancelar repositório repositorio organização organizacao usuário usuario elas eles dela dele isso esse essa".split()
PORTUGUESE_LETTERS = "ãõçáéíóúâêô"
# The boilerplate that ends a description, and the orders of language.
BOILERPLATE = r"\*\*Fine-grained access tokens for "
IN_PORTUGUESE = "IMPORTANT: write the whole answer in Brazilian Portuguese (português do Brasil)."
IN_ENGLISH = "Write the answer in English."
ELLIPSIS = " […]"

#: White space of a regular expression, and of Unicode.
SPACE = r"[\t\n\f\r ]"
ANY_SPACE = "[\\t-\\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def tokens(c: Column | str) -> Column:
    """Runs of ``[a-z0-9_]`` of the lower-cased text without stopwords, in order, repeats kept."""
    lowered = F.lower(F.translate(_text(c), "İ", "i"))
    return F.filter(F.regexp_extract_all(lowered, F.lit("[a-z0-9_]+"), F.lit(0)), lambda t: ~t.isin(STOPWORDS))


def joined_fields(*lists: Column | str) -> Column:
    """Names (``_`` as a space) and descriptions of all fields, to be tokenised."""
    whole = F.concat(*[F.coalesce(F.col(x) if isinstance(x, str) else x, F.array()) for x in lists])
    return F.array_join(F.transform(whole, lambda f: F.concat_ws(" ", F.translate(f["name"], "_", " "), f["description"])), " ")


def clean_text(c: Column | str) -> Column:
    """Without boilerplate, note marks, link targets, tags and marks of markup; white space collapsed."""
    steps = (("(?s)" + BOILERPLATE + ".*$", ""), (rf">{SPACE}*\[![0-9A-Za-z_]+\]", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"), ("<[^>]+>", " "), ("[*`>#]+", " "), (f"{SPACE}+", " "))
    out = _text(c)
    for pattern, plain in steps:
        out = F.regexp_replace(out, pattern, plain)
    return F.regexp_replace(out, f"^{ANY_SPACE}+|{ANY_SPACE}+$", "")


def path_words(c: Column | str) -> Column:
    """A path as words: ``/``, ``_`` and ``-`` as spaces, braces left out."""
    return F.trim(F.regexp_replace(F.translate(_text(c), "/_-{}", "   "), f"{SPACE}+", " "))


def composed_text(method: Column, path: Column, summary: Column, description: Column, fields: Column) -> Column:
    """The searchable text: summary (even if empty), method and path words, description, fields, joined by ``. ``."""
    shown = lambda f: F.concat(F.translate(_text(f["name"]), "_", " "), F.when(_text(f["description"]) != "", F.concat(F.lit(": "), f["description"])).otherwise(""))
    head = F.array(_text(summary), F.concat_ws(" ", _text(method), path_words(path)))
    body = F.when(_text(description) != "", F.array(description)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(head, body, F.transform(F.coalesce(fields, F.array()), shown)), ". ")


def word_count(c: Column | str) -> Column:
    """Words between white space of any kind."""
    return F.size(F.filter(F.split(_text(c), f"{ANY_SPACE}+"), lambda w: w != ""))


def truncate(c: Column | str, most: int) -> Column:
    """At most ``most`` bytes, cut at the last space within them, with a mark; a character cut in two is left out.

    ``most`` of 0 or less leaves the text as it is.
    """
    text = _text(c)
    if most <= 0:
        return text
    raw = F.encode(text, "UTF-8")
    head = F.decode(F.substring(raw, 1, most), "ISO-8859-1")
    space = F.length(head) - F.instr(F.reverse(head), " ")  # bytes before the last space
    split = F.decode(F.substring(raw, most + 1, 1), "ISO-8859-1").rlike("[\u0080-\u00bf]")
    whole = F.when(split, F.length(F.regexp_replace(head, "[\u00c0-\u00ff][\u0080-\u00bf]*$", ""))).otherwise(most)
    cut = F.when((F.instr(head, " ") > 0) & (space > 0), space).otherwise(whole)
    kept = F.decode(raw.substr(F.lit(1), cut), "UTF-8")
    return F.when(F.octet_length(text) > most, F.concat(kept, F.lit(ELLIPSIS))).otherwise(text)


def clean_query(c: Column | str) -> Column:
    """A rewritten question as a query: its first line without quotes, lower-cased, without a leading ``query:``."""
    line = F.split(F.regexp_replace(_text(c), f"^{ANY_SPACE}+|{ANY_SPACE}+$", ""), "\n")[0]
    line = F.lower(F.regexp_replace(line, "^[\"'`.“”]+|[\"'`.“”]+$", ""))
    return F.regexp_replace(F.regexp_replace(line, "^query:", ""), f"^{ANY_SPACE}+|{ANY_SPACE}+$", "")


def is_portuguese(c: Column | str) -> Column:
    """Whether a word or a letter of the question tells Portuguese."""
    words = F.transform(F.split(F.lower(_text(c)), f"{ANY_SPACE}+"), lambda w: F.regexp_replace(w, "^[?!.,;:]+|[?!.,;:]+$", ""))
    return F.arrays_overlap(words, F.array(*map(F.lit, PORTUGUESE))) | _text(c).rlike(f"[{PORTUGUESE_LETTERS}]")


def language_order(c: Column | str) -> Column:
    return F.when(is_portuguese(c), IN_PORTUGUESE).otherwise(IN_ENGLISH)


def is_looping(c: Column | str, window: int = 1600, tail: int = 60) -> Column:
    """Whether the last ``tail`` bytes stand at least three times, without overlap, in the last ``window`` bytes."""
    raw = F.decode(F.encode(_text(c), "UTF-8"), "ISO-8859-1")
    seen = F.right(raw, F.lit(window))
    left = F.replace(seen, F.right(raw, F.lit(tail)), F.lit(""))
    return (F.length(raw) >= 3 * tail) & ((F.length(seen) - F.length(left)) / tail >= 3)


def segments(path: Column | str) -> Column:
    """The segments of a path without its outer slashes; the empty path has none, inner empty ones stay."""
    bare = F.trim(_text(path), F.lit("/"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "/"))


def is_slot(segment: Column) -> Column:
    return segment.startswith("{") & segment.endswith("}")


def is_generated_id(segment: Column) -> Column:
    return is_slot(segment) & segment.endswith("_id}")
