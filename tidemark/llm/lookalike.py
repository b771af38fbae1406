"""Visually identical text with different characters: one consistent form for every text.

Characters are taken apart (NFD), width, kinds of space and invisible characters are set aside, and each token's
letters are looked at as glyphs: a glyph belongs to every script that has a letter of that look. The scripts of
all letters of a token are intersected. One script left: the token is spelled in it (a mixed-script look-alike
if it wasn't). Several left: a whole-script confusable, spelled in the script of most resolved tokens of the
text if those use all its glyphs, else in Latin. None left: really mixed, each letter that two scripts share goes
to the script of most of the token's other letters. All choices depend on glyphs only, so texts that look alike get the same form. In
the end accents are composed (NFC).

Case, digits, accents, punctuation, tabs and line breaks stay as they are; every space stays one space. Null
stays null and the empty text stays empty.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

# Letters of other scripts and the Latin letters of the same look.
CYRILLIC = "АA ВB ЕE КK МM НH ОO РP СC ТT ХX ЅS ІI ЈJ ҮY ԌG ԚQ ԜW аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ӏl"
GREEK = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX νv οo ρp ϲc ϳj"
ARMENIAN = "ՕO օo"
CHEROKEE = "ᎪA ᏴB ᏟC ᎠD ᎬE ᏀG ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᏚS ᎢT ᏙV ᎳW ᏃZ"
LISU = "ꓮA ꓐB ꓚC ꓓD ꓰE ꓝF ꓖG ꓧH ꓲI ꓙJ ꓗK ꓡL ꓟM ꓠN ꓳO ꓑP ꓣR ꓢS ꓔT ꓴU ꓦV ꓪW ꓫX ꓬY ꓜZ"
# Characters that leave no mark (soft hyphen, zero widths, joiners, marks of direction and the like).
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufeff\U000e0000-\U000e007f"
#: Joiners between these change what is seen: scripts whose letters join, and emoji.
JOINING = "\u0600-\u08ff\u0900-\u0dff\u0f00-\u109f\u1780-\u17b3\u17b6-\u180d\u180f-\u18af\u2600-\u27bf\u2b00-\u2bff\ufe0f\U0001f000-\U0001faff"

# Ranges of code points of the scripts that have such letters.
SCRIPTS = [("Grek", 0x370, 0x400), ("Cyrl", 0x400, 0x530), ("Armn", 0x530, 0x590), ("Cher", 0x13A0, 0x1400), ("Grek", 0x1F00, 0x2000), ("Lisu", 0xA4D0, 0xA500)]
# Ranges whose characters look like the plain letters they are made of: Roman numerals, ligatures, plain
# letters without serifs and of a typewriter. Bold, slanted and script letters differ to the eye and stay.
SAME_LOOK = [(0x2160, 0x2180), (0xFB00, 0xFB07), (0x1D5A0, 0x1D5D4), (0x1D670, 0x1D6A4), (0x1D7E2, 0x1D7EC), (0x1D7F6, 0x1D800)]

_PAIRS = {s: {p[1]: p[0] for p in t.split()} for s, t in (("Cyrl", CYRILLIC), ("Grek", GREEK), ("Armn", ARMENIAN), ("Cher", CHEROKEE), ("Lisu", LISU))}
_LATIN = {ord(own): latin for t in _PAIRS.values() for latin, own in t.items()}
_SPACES = {c: " " for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)}
_WIDTH = {c: unicodedata.normalize("NFKC", chr(c)) for c in range(0xFF01, 0xFFEF) if unicodedata.normalize("NFKC", chr(c)) != chr(c)}
_LOOK = {c: unicodedata.normalize("NFKC", chr(c)) for low, high in SAME_LOOK for c in range(low, high) if unicodedata.normalize("NFKC", chr(c)).isascii()}
_PLAIN = _SPACES | _WIDTH | _LOOK
_HAS_PLAIN = re.compile("[" + "".join(map(chr, sorted(_PLAIN))) + "]")
_HAS_LATIN = re.compile("[" + "".join(map(chr, sorted(_LATIN))) + "]")
_INVISIBLE = re.compile(f"[{INVISIBLE}]+")
_USUAL = frozenset(map(chr, [*range(128), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC, 0x2122]))
_UNUSUAL = frozenset(c for c in map(chr, range(0x80, 0x370)) if ord(c) in _PLAIN or _INVISIBLE.fullmatch(c))
_NO_JOINER = re.compile(f"[{INVISIBLE}]")
_JOINED = re.compile(f"(?<=[{JOINING}])[\u200c\u200d](?=[{JOINING}])")
_OTHER = re.compile("[\u0370-\u03ff\u1f00-\u1fff\u0400-\u052f\u1c80-\u1c8f\u2de0-\u2dff\ua640-\ua69f\u0530-\u058f\u13a0-\u13ff\ua4d0-\ua4ff]")
_TOKEN = re.compile(r"(?:[^\W\d_]|[\u0300-\u036f\u0483-\u0487])+")
_JOINERS = re.compile("[\u200c\u200d]")


@lru_cache(maxsize=8192)
def _scripts(glyph: str) -> frozenset[str]:
    """Scripts with a letter of this look; no script for what is no letter."""
    if glyph in "ªº" or not glyph.isalpha():
        return frozenset()
    c = ord(glyph)
    if c < 0x250 or 0x1E00 <= c < 0x1F00:
        return frozenset(["Latn", *(s for s, t in _PAIRS.items() if glyph in t)])
    for name, low, high in SCRIPTS:
        if low <= c < high:
            return frozenset([name])
    return frozenset(["other"])


@lru_cache(maxsize=65536)
def _resolve(token: str) -> tuple[frozenset[str], tuple[str, int] | None]:
    """The scripts that fit all letters; if none does, the script of most letters that have only one."""
    sets = [s for ch in token if (s := _scripts(ch))]
    if not sets:
        return frozenset(["Latn"]), None
    if both := frozenset.intersection(*sets):
        return both, None
    most = Counter(next(iter(s)) for s in sets if len(s) == 1)
    return both, max(most.items(), key=lambda x: (x[1], x[0] == "Latn", x[0])) if most else ("Latn", 0)


@lru_cache(maxsize=65536)
def _spell(token: str, script: str) -> str:
    table = _PAIRS.get(script)
    return "".join(table.get(ch, ch) for ch in token) if table else token


def glyphs(text: str) -> str:
    """The text by its look: apart, without width, invisible characters and scripts."""
    if _HAS_PLAIN.search(text):
        text = text.translate(_PLAIN)
    if _JOINERS.search(text) and _JOINED.search(text):
        parts = _JOINED.split(text)
        kept = _JOINED.findall(text)
        text = "".join(_NO_JOINER.sub("", p) + k for p, k in zip(parts, [*kept, ""]))
    else:
        text = _INVISIBLE.sub("", text)
    return to_latin(unicodedata.normalize("NFD", text))


def to_latin(text: str) -> str:
    """Letters of other scripts as the Latin letters of the same look."""
    return text.translate(_LATIN) if _HAS_LATIN.search(text) else text


def latin_alone(text: str) -> bool:
    """Whether no character can need more than composition: Latin letters with or without accents, and usual signs."""
    seen = set(text) - _USUAL
    return not seen or max(seen) < "\u0370" and _UNUSUAL.isdisjoint(seen)


def consistent(text: str | None) -> str | None:
    """The one consistent form of a text."""
    if text is None or text.isascii():
        return text
    if latin_alone(text):
        return unicodedata.normalize("NFC", text)
    look = glyphs(text)
    if not _OTHER.search(look):  # no glyph that only another script has: all of it is Latin
        return unicodedata.normalize("NFC", look)
    tokens = [m.span() for m in _TOKEN.finditer(look)]
    found = [_resolve(look[a:z]) for a, z in tokens]
    votes = Counter(next(iter(s)) for s, _ in found if len(s) == 1)
    main = max(votes.items(), key=lambda x: (x[1], x[0] == "Latn", x[0]))[0] if votes else "Latn"
    used = {ch for (a, z), (s, _) in zip(tokens, found) if s == {main} for ch in look[a:z]} if main != "Latn" else set()
    out, at = [], 0
    for (a, z), (scripts, mixed) in zip(tokens, found):
        if mixed:
            script = mixed[0]
        elif len(scripts) == 1:
            script = next(iter(scripts))
        else:
            script = main if main in scripts and used.issuperset(look[a:z]) else "Latn"
        out += [look[at:a], _spell(look[a:z], script)]
        at = z
    return unicodedata.normalize("NFC", "".join([*out, look[at:]]))


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.int64()), ("text", pa.string()), ("form", pa.string())])
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("text").cast(pa.string()), pa.array([consistent(t) for t in b.column("text").to_pylist()], pa.string())], schema=schema)


def with_form(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, form) for every row; key is a BIGINT."""
    return df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).mapInArrow(_forms, "key bigint, text string, form string")


def digests(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, stored, form): digests of every text and its form, written once; null keys and texts are left out.

    A text of ASCII alone is its own form and doesn't leave the JVM.
    """
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).where("key is not null and text is not null")
    other = F.col("text").rlike(r"[^\x00-\x7F]")
    own = rows.where(~other).select("key", F.unhex(F.md5("text")).alias("stored"), F.unhex(F.md5("text")).alias("form"))
    made = with_form(rows.where(other), "key", "text").select("key", F.unhex(F.md5("text")).alias("stored"), F.unhex(F.md5("form")).alias("form"))
    return checkpoint(own.unionByName(made))


def spellings(told: DataFrame) -> DataFrame:
    """(form, stored, first, copies): every stored spelling of the forms that have more than one."""
    each = told.groupBy("form", "stored").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("copies"))
    varied = each.groupBy("form").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("form")
    return each.join(varied, "form", "left_semi")


def lookalike_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, class, spelling): one row for every text that has another spelling: the least key of its look, and of its spelling."""
    told = digests(df, key, text)
    known = spellings(told)
    best = known.groupBy("form").agg(F.min("first").alias("class"))
    return told.join(known.join(best, "form").select("form", "stored", "class", F.col("first").alias("spelling")), ["form", "stored"]).select("key", "class", "spelling")


def lookalike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key_a, key_b), key_a < key_b: texts of the same form that are stored differently.

    Only digests are shuffled. Spellings of a form are paired before texts are, so exact copies never meet each
    other: the rows that are made are the pairs that come out.
    """
    told = digests(df, key, text)
    known = spellings(told)
    one, two = (known.select("form", F.col("stored").alias(f"stored_{x}")) for x in "ab")
    pairs = one.join(two, "form").where("stored_a < stored_b")
    a, b = (told.select("form", F.col("key").alias(x), F.col("stored").alias(f"stored_{x}")) for x in "ab")
    met = pairs.join(a, ["form", "stored_a"]).join(b, ["form", "stored_b"])
    return met.select(F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b"))
