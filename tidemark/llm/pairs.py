"""Broken prompt and response pairs: each defective pair with its defect.

One pass in Python reads each pair and notes what the pair alone shows: no content, a copy of the prompt, how it
ends, the language of its prose, the calls it writes, and its opening (first sentence that is more than a
courtesy; calls, numbers and words of the prompt masked). The rest needs the collection:

* Openings are clustered by verified MinHash (shingles of five words, similarity 0.8): every pair of openings that
  shares a bucket and is similar is linked; a pair of just 0.8 shares none in 2 of 10,000 cases. A template that recurs
  across unrelated prompts, hardly ever comes with a call and doesn't say that the catalogue lacks the operation
  is a refusal; a rare opening must say so in words of refusal.
* A list that ends without a full stop is finished if its last line, calls masked, closes a list elsewhere,
  before further text or with a stop.
* Calls are looked up in the catalogue by equi-joins: each call makes one key for each pattern of parameter
  segments that templates of its length have.

Precedence: empty, copied, refusal, truncated, other_language, invented; one row per defective pair.

Defined results: a null answer is empty; with a null prompt an answer is neither a copy nor in another language;
repeated pairs are reported each for itself; with an empty catalogue every call is invented.
"""

from __future__ import annotations

import html
import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

# Function words that tell the languages of prompts and answers apart.
WORDS = {
    "en": "the of and to is with you this for in on it are be an what how which does do i need if not first then finally call use without can at by from must that when there until so before people who see get list answer has",
    "pt": "o os um uma em na nas do da dos das não é ou ao pelo pela você isso este seu sua com são tem mais também então até sem depois primeiro qual jeito preciso faço quando eu quem pode lista vem envie por fim use chame antes disso ter como existe uma só vez",
    "es": "el los las una en del al y con es más sin usted puede hay qué cómo esto su lo después luego así hasta llamada necesito si quien ve recibe viene envíe por último use llame antes hace falta tener forma debo la",
    "fr": "le les des du et est une dans pour avec vous pouvez ce cette si ne pas qui au aux sur par avant il faut l'espace appelez puis enfin la liste jusqu'à n'existe la vérifiez utilisez d'abord ensuite code réponse opération bonne",
    "it": "il gli della delle degli dell' dal dalla nella sono è che non per questo questa può anche prima dopo quindi usi chiami senza fino ogni quale viene chiamata risposta operazione giusta",
    "nl": "het een van en niet met voor zijn aan wordt kunt deze dit naar bij ook eerst daarna zonder tot roep gebruik antwoord juiste oproep lijst geen",
    "pl": "i w na nie jest się że dla przed oraz lub jak który która można należy żądanie odpowiedź lista użyj wywołaj najpierw potem bez jeśli właściwa",
    "tr": "ve bir bu için ile olarak değil çok daha sonra önce kadar olan gibi çağrı kullanın liste yanıt doğru işlem ise yok",
    "de": "der die das und ist nicht mit für sie ein eine den dem des zu auf wenn wie von im bis zum danach zuerst schluss kommt wird man kann vorher nötig dies holen senden prüfen ergebnis liste aufruf deshalb antwort richtige ohne",
}
# Placeholders for "no answer", punctuation set aside.
PLACEHOLDERS = {"n a", "na", "nil", "null", "none", "nan", "undefined", "empty", "vazio", "vazia", "vacío", "vacía", "vide", "leer", "sem resposta", "sin respuesta", "no answer", "no response", "no reply", "not available", "no output", "nenhuma resposta", "ninguna respuesta", "sans réponse", "keine antwort", "resposta vazia", "respuesta vacía", "empty answer", "empty response", "no content", "sem conteúdo", "sin contenido", "tbd", "todo", "indisponível", "no disponible", "não disponível"}
# Words of refusal, by language.
REFUSING = re.compile(
    r"\b(?:can['’]?t|cannot|can not|won['’]?t be able|unable to|not able to|must decline|decline to|have to (?:decline|refuse)|refuse to|not (?:allowed|permitted|something i can|comfortable|going to)|outside what i am allowed|am allowed to do|forbid|do(?: not|n['’]t) have (?:clearance|permission|authori[sz]ation)|rather not|leave this one unanswered|no instructions of this kind|prefer not to)\b"
    r"|\bnão (?:posso|poderei|consigo|darei|vou|devo|me é permitido|me sinto|tenho (?:autorização|permissão)|estou autorizad[oa])|\bnão me é permitido|\b(?:recusar|impedid[oa]|proíbe[m]?|prefiro não|sem resposta|melhor não|foge do que tenho permissão)\b"
    r"|\bno (?:puedo|podré|daré|debo|voy a|me es posible|me está permitido|tengo (?:autorización|permiso)|estoy (?:en condiciones|autorizad[oa]))|\b(?:rechazar|prohíbe[n]?|prefiero no|sin respuesta|fuera de lo que tengo permitido)\b"
    r"|\bje ne (?:peux|suis pas|souhaite pas)|\bje (?:préfère|dois) (?:ne pas|refuser|décliner)|\bm'est pas permis|\bsans réponse\b"
    r"|\b(?:kann|darf|möchte|werde) (?:ich )?(?:\w+ )?(?:leider |lieber )?(?:nicht|keine)|\b(?:ablehnen|untersag|verbiet)",
    re.I,
)
# Saying that the catalogue has no such operation.
THING = re.compile(r"catalog|catálog|document|\breference|\brefer[eê]nci|\boperat|\boperaç|\boperaci|\bopérat|\bcall\b|\bchamada|\bllamada|\bappel\b|\bendpoint|\broute|\brota\b|\bruta\b|katalog|aufruf|operation", re.I)
LACKING = re.compile(r"\b(?:found|find|holds?|contains?|covers?|exists?|there (?:is|are)|lists?|offers?|has no|há|existe|traz|encontr\w+|contém|cobre|contiene|hay|cubre|trouvé|contient|gibt|enthält|gefunden)\b", re.I)
NEGATION = re.compile(r"\b(?:no|not|none|nothing|nenhum\w*|não|ningun\w*|ningún|aucun\w*|ne|kein\w*|nicht)\b|n['’]t\b", re.I)
# A first sentence that only greets, thanks or excuses a delay.
COURTESY = re.compile(r"^(?:claro|certo|boa pergunta|ótima pergunta|desculpe a demora|olá|oi|sure|of course|certainly|good question|great question|sorry for the delay|hello|hi|por supuesto|buena pregunta|perdón? por la demora|disculpe la demora|hola|bien sûr|bonne question|désolé pour le retard|bonjour|klar|gute frage|entschuldigung für die verspätung|hallo)[.!,]*$", re.I)

METHODS = "GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS"
HOST = r"https?://api\.kelpforge\.example"
_PLAIN_CALL = re.compile(rf"\b({METHODS})\b[*`]{{0,3}}[ \t]+[*`]{{0,3}}(/[^\s`\"'()*,;|\]]*)", re.I)
_CURL = re.compile(r"curl\b(?:[^\n\\]|\\\n|\\.)*")
_CURL_START = re.compile(r"(?<![^\s;|&`(\"'$])(?=curl\s)")
_CURL_METHOD = re.compile(rf"-X\s*[\"']?({METHODS})\b", re.I)
_CURL_URL = re.compile(rf"{HOST}(/?[^\s`\"')]*)")
_URL = re.compile(r"https?://\S+")
_FENCED = re.compile(r"```.*?(?:```|\Z)", re.S)
_QUOTED = re.compile("\"[^\"\\n]*\"|“[^”\\n]*”|«[^»\\n]*»")
_CODE = re.compile(r"`[^`\n]*`?")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_ITEM = re.compile(r"^\s*(?:[-*+•]|\d{1,3}[.)])\s+")
_MARKER = re.compile(r"^\s*(?:[-*+•]|\d{1,3}[.)]?)\s*$")
_TAGS = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
_UNSEEN = re.compile("[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufeff]")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”»)*_]*\s+|\n+")
_TERMINAL = re.compile(r"[.!?…][\"'”»)\]*_`]*$")
_NOT_WORD = re.compile(r"[\W_]+")
_LISTS = {k: frozenset(v.split()) for k, v in WORDS.items()}
# Ranges of letters that tell a script, and so the language of a word, by themselves.
SCRIPTS = {"ru": "\u0400-\u052f", "el": "\u0370-\u03ff", "he": "\u0590-\u05ff", "ar": "\u0600-\u06ff", "hi": "\u0900-\u097f", "th": "\u0e00-\u0e7f", "ko": "\uac00-\ud7af", "ja": "\u3040-\u30ff", "zh": "\u4e00-\u9fff"}
_SCRIPT = re.compile("|".join(f"(?P<{k}>[{v}])" for k, v in SCRIPTS.items()))
_OPEN, _CLOSE = "([{", ")]}"
NO, YES, ASK = 0, 1, 2


def flat(s: str) -> str:
    return _NOT_WORD.sub(" ", s.lower()).strip()


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    bare = flat(html.unescape(_TAGS.sub(" ", _UNSEEN.sub("", answer))))
    return not bare or bare in PLACEHOLDERS


def _near(a: str, b: str) -> bool:
    """Equal but for one slip: what is left between the common start and the common end is a few letters."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 4 or min(len(a), len(b)) < 8:
        return False
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return max(len(a), len(b)) - i - j <= 4


def is_copy(prompt: str | None, answer: str) -> bool:
    if not prompt or not (q := flat(prompt)):
        return False
    if len(answer) < len(q) // 2:
        return False
    answer = _UNSEEN.sub("", re.sub(r"^\s*```\w*", "", answer))
    told = re.match(r"([^:\n]+):\s*(.+)", answer, re.S)
    # what leads over to the question, said again or not, ends in a colon and names no call
    parts = [p for p in re.split(r"(?<=:)\s+|\n+", answer) if p and not (p.endswith(":") and not calls_in(p))]
    for a in dict.fromkeys([answer, *([told[2]] if told and not (len(told[1]) > 60 and calls_in(told[1])) else []), "\n".join(parts)]):
        a = flat(a)
        for k in range(max(1, (len(a) - 4) // (len(q) + 1)), 1 + round((len(a) + 1) / (len(q) + 1))):
            if _near(a, " ".join([q] * k)):
                return True
    return False


def calls_in(answer: str) -> list[tuple[str, str]]:
    """(METHOD, path) of every call written in the answer, first occurrence first."""
    found = [(m[1].upper(), m[2]) for m in _PLAIN_CALL.finditer(answer)]
    for c in _CURL.finditer(answer):
        method = url = None
        for part in _CURL_START.split(c[0]):  # a line may hold several commands, and a body the word
            m, u = _CURL_METHOD.search(part), _CURL_URL.search(part)
            if m and u:
                method, url = m, u
            else:
                method, url = method or m, url or u
            if method and url:
                found.append((method[1].upper(), url[1]))
                method = url = None
    return list(dict.fromkeys((m, re.split(r"[?#]", p)[0].rstrip(".,;:!").strip("/")) for m, p in found))


def prose(answer: str) -> str:
    text = _QUOTED.sub(" ", _CODE.sub(" ", _FENCED.sub("\n", answer)))
    return _URL.sub(" ", _PLAIN_CALL.sub(" ", text))


def language(words: list[str]) -> tuple[str | None, int]:
    """The language whose function words, or letters, are most, and by how many it leads; None if no word tells."""
    score = {k: sum(w in v for w in words) for k, v in _LISTS.items()}
    if not "".join(words).isascii():
        for w in words:
            if m := _SCRIPT.match(w):
                score[m.lastgroup] = score.get(m.lastgroup, 0) + 1
    (best, n), (_, second) = sorted(score.items(), key=lambda x: -x[1])[:2]
    return (best, n - second) if n > second else (None, 0)


def other_language(prompt: str | None, answer: str) -> bool:
    """Most words of the prose stand in sentences of a language that is not the prompt's."""
    if not prompt or (asked := language(_WORD.findall(prompt.lower()))[0]) is None:
        return False
    own = other = 0
    for s in _SENTENCE.split(prose(answer)):
        words = _WORD.findall(s.lower())
        if (told := language(words)[0]) is not None:
            own, other = own + len(words) * (told == asked), other + len(words) * (told != asked)
    return other > own


def mask(line: str) -> str:
    """A line as a template: calls, code and numbers masked, no list marker, no closing stop."""
    line = _ITEM.sub("", line)
    line = _PLAIN_CALL.sub(" call ", _URL.sub(" call ", line))
    return re.sub(r"\d+", "0", _NOT_WORD.sub(" ", line.lower())).strip()


def list_lines(answer: str) -> list[tuple[str, bool]]:
    """(template, closes) of the list lines outside code: whether the line ends its list for certain."""
    lines = _FENCED.sub("\n\u0000\n", answer).rstrip().split("\n")
    out, following, rests = [], None, []
    for line in reversed(lines):
        rests.append(following)
        following = line if line.strip() else following
    for line, rest in zip(lines, reversed(rests)):
        if _ITEM.match(line):
            if rest is not None:
                out.append((mask(line), not _ITEM.match(rest)))
            elif line.rstrip().endswith((".", "!", "?")):
                out.append((mask(line), True))
    return out


def ending(answer: str) -> tuple[int, str | None]:
    """Whether the answer is cut off: NO, YES, or ASK with the template of its last list line."""
    text = _UNSEEN.sub("", answer).rstrip()
    if text.count("```") % 2:
        return YES, None
    if text.endswith("```"):
        return NO, None
    last = _FENCED.sub("\n", text).rstrip().split("\n")[-1]
    if _MARKER.match(last) or last.count("`") % 2:
        return YES, None
    item = _ITEM.match(last)
    body = last[item.end() :] if item else last
    bare = _CODE.sub("", body)
    depth = 0
    for ch in bare:
        depth += (ch in _OPEN) - (ch in _CLOSE and depth > 0)
    if depth or bare.count('"') % 2 or bare.count("“") > bare.count("”"):
        return YES, None
    if _TERMINAL.search(last):
        return NO, None
    if last[-1] in ",:;-–—/\\=&+(<":
        return YES, None
    if last[-1] in "`)\"'”»]*_|>":
        return NO, None
    tail = _SENTENCE.split(body)[-1]
    if item and tail == body:
        lines = [x for x in text.split("\n") if _ITEM.match(x)]
        if len(lines) > 1 and all(_TERMINAL.search(x.rstrip()) for x in lines[:-1]):
            return YES, None
        return ASK, mask(last)
    if _PLAIN_CALL.fullmatch(tail.strip()):
        return NO, None
    return YES, None


def opening(prompt: str | None, answer: str) -> str:
    """The first sentence that says something, calls, numbers and words of the prompt masked."""
    said = re.sub(r"\bcall(?: call)+\b", "call", "")
    asked = {w for w in _WORD.findall((prompt or "").lower()) if len(w) > 3}
    for s in _SENTENCE.split(_FENCED.sub(" call \n", answer).strip()):
        s = s.strip()
        if s and not COURTESY.match(s):
            words = [w if w == "call" or w not in asked else "asked" for w in mask(s).split()]
            said = " ".join(w for i, w in enumerate(words) if not (w == "asked" and i and words[i - 1] == "asked"))
            break
    return said


_BASE = pa.schema([("record", pa.int64()), ("decided", pa.string()), ("opening", pa.string()), ("prompt", pa.int64()), ("has_call", pa.bool_()), ("cut", pa.int32()), ("line", pa.string()), ("foreign_prose", pa.bool_()), ("calls", pa.list_(pa.struct([("method", pa.string()), ("path", pa.string())]))), ("lines", pa.list_(pa.struct([("line", pa.string()), ("closes", pa.bool_())])))])
_BASE_DDL = "record bigint, decided string, opening string, prompt bigint, has_call boolean, cut int, line string, foreign_prose boolean, calls array<struct<method string, path string>>, lines array<struct<line string, closes boolean>>"


def _read_pair(record: int, prompt: str | None, answer: str | None) -> tuple:
    if is_empty(answer):
        return record, "empty", None, None, None, None, None, None, None, None
    if is_copy(prompt, answer):
        return record, "copied", None, None, None, None, None, None, None, None
    cut, line = ending(answer)
    calls = calls_in(answer)
    asked = xxhash.xxh64_intdigest(flat(prompt or "")) >> 1
    return record, None, opening(prompt, answer), asked, bool(calls), cut, line, other_language(prompt, answer), [{"method": m, "path": p} for m, p in calls], [{"line": x, "closes": y} for x, y in list_lines(answer)]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [_read_pair(*r) for r in zip(*[b.column(c).to_pylist() for c in ("record", "asked", "answer")])]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _BASE)], schema=_BASE)


# ---- refusals: clusters of openings


BANDS, ROWS, SHINGLE, SIMILAR = 16, 4, 5, 0.8
_SEEDS = np.random.default_rng(7).integers(1, 1 << 61, (2, BANDS * ROWS), np.uint64) | np.uint64(1)


def shingles(text: str) -> list[int]:
    words = text.split()
    return sorted({xxhash.xxh64_intdigest(" ".join(words[i : i + SHINGLE])) >> 1 for i in range(max(1, len(words) - SHINGLE + 1))})


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("opening", pa.string()), ("shingles", pa.list_(pa.int64())), ("buckets", pa.list_(pa.int64()))])
    with np.errstate(over="ignore"):
        for b in batches:
            out = []
            for text in b.column("opening").to_pylist():
                own = np.array(shingles(text), np.uint64)
                h = own[:, None] * _SEEDS[0] + _SEEDS[1]
                least = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).min(axis=0).reshape(BANDS, ROWS)
                buckets = [xxhash.xxh64_intdigest(r.tobytes(), seed=i) >> 1 for i, r in enumerate(least)]
                out.append((text, own.astype(np.int64).tolist(), buckets))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


class _Bucket:
    """The openings of one bucket, clustered by every verified link between two of them.

    Sets that reach SIMILAR share one of their first shingles in a fixed order (prefix filter), so only openings
    that do are compared. ``posts`` has them by shingle and cluster; with a cluster that an opening has joined
    already it isn't compared again, as that would add no link between clusters.
    """

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.texts: list[str] = []
        self.sets: list[array] = []
        self.posts: dict[int, dict[int, list[int]]] = {}

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def by_cluster(self, shingle: int) -> dict[int, list[int]]:
        posts = self.posts.setdefault(shingle, {})
        for k in [k for k in posts if self.parent[k] != k]:  # joined to another cluster since
            posts.setdefault(self.root(k), []).extend(posts.pop(k))
        return posts

    def add(self, text: str, shingles: list[int]) -> list[tuple[str, str]]:
        """Its links to the openings before, one for each cluster that it joins."""
        new, own, links = len(self.texts), set(shingles), []
        prefix = sorted(own)[: len(own) - math.ceil(SIMILAR * len(own) - 1e-9) + 1]
        joined, seen = set(), set()
        for shingle in prefix:
            for k, members in self.by_cluster(shingle).items():
                if k in joined:
                    continue
                for i in members:
                    if i not in seen:
                        seen.add(i)
                        theirs = self.sets[i]
                        both = len(own.intersection(theirs))
                        if both >= SIMILAR * (len(own) + len(theirs) - both):
                            links.append((text, self.texts[i]))
                            joined.add(k)
                            break
        self.texts.append(text)
        self.sets.append(array("q", own))
        self.parent.append(new)
        cluster = min(joined, default=new)
        for k in (*joined, new):
            self.parent[k] = cluster
        for shingle in prefix:
            self.posts[shingle].setdefault(cluster, []).append(new)
        return links


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (opening, opening) of verified similarity that join all openings linked within a bucket; rows come ordered by bucket."""
    schema = pa.schema([("a", pa.string()), ("b", pa.string())])
    bucket, members = None, _Bucket()
    for b in batches:
        links = []
        for k, text, own in zip(*[b.column(c).to_pylist() for c in ("bucket", "opening", "shingles")]):
            if k != bucket:
                bucket, members = k, _Bucket()
            links += members.add(text, own)
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*links)], schema=schema)


def _classes(links: DataFrame) -> DataFrame:
    """(opening, class): connected components of links (a, b), by least labels; lineage is cut in every round."""
    links = checkpoint(links.distinct())
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = both.groupBy(F.col("a").alias("opening")).agg(F.least(F.col("opening"), F.min("b")).alias("class"))
    labels = checkpoint(labels)
    while True:
        near = both.join(labels.select(F.col("opening").alias("b"), F.col("class").alias("theirs")), "b").groupBy(F.col("a").alias("opening")).agg(F.min("theirs").alias("theirs"))
        jump = labels.select(F.col("opening").alias("class"), F.col("class").alias("further"))
        moved = labels.join(near, "opening").join(jump, "class", "left").select("opening", F.least("class", "theirs", F.coalesce("further", "class")).alias("new"), "class")
        moved = checkpoint(moved)
        if moved.where("new != class").limit(1).count() == 0:
            return labels
        labels = moved.select("opening", F.col("new").alias("class"))


def _cues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("opening", pa.string()), ("refuses", pa.bool_()), ("lacks", pa.bool_())])
    for b in batches:
        texts = b.column("opening").to_pylist()
        refuses = [bool(REFUSING.search(t)) for t in texts]
        lacks = [bool(THING.search(t) and LACKING.search(t) and NEGATION.search(t)) for t in texts]
        yield pa.RecordBatch.from_arrays([b.column("opening").cast(pa.string()), pa.array(refuses), pa.array(lacks)], schema=schema)


def refusal_openings(base: DataFrame, recurring: int = 8) -> DataFrame:
    """(opening): the openings that refuse."""
    pairs = base.where("opening != ''").groupBy("opening", "prompt").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("has_call").cast("bigint")).alias("with_call"))
    known = pairs.groupBy("opening").agg(F.count(F.lit(1)).alias("prompts"), F.sum("n").alias("n"), F.sum("with_call").alias("with_call"))
    known = checkpoint(known)
    signed = known.select("opening").mapInArrow(_sign, "opening string, shingles array<bigint>, buckets array<bigint>")
    bucketed = signed.select("opening", "shingles", F.explode("buckets").alias("bucket")).repartition("bucket").sortWithinPartitions("bucket", "opening")
    classes = _classes(bucketed.mapInArrow(_link, "a string, b string"))
    cued = known.join(known.select("opening").mapInArrow(_cues, "opening string, refuses boolean, lacks boolean"), "opening")
    cued = cued.join(classes, "opening", "left").withColumn("class", F.coalesce("class", "opening"))
    share = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)) / F.sum("n")
    label = cued.groupBy("class").agg(F.sum("prompts").alias("prompts"), (F.sum("with_call") / F.sum("n")).alias("calls"), share("refuses").alias("refuses"), share("lacks").alias("lacks"))
    template = (F.col("prompts") >= recurring) & (F.col("calls") <= 0.05) & (F.col("lacks") < 0.5)
    said = (F.col("refuses") >= 0.5) & (F.col("lacks") < 0.5) & (F.col("calls") < 0.5)
    return cued.select("opening", "class").join(label.where(template | said).select("class"), "class", "left_semi").select("opening").distinct()


# ---- lists and calls


HEAD = 16


def _begun(asked: DataFrame, closing: DataFrame) -> DataFrame:
    """(line): the asked lines that a longer closing line begins with.

    Short lines meet the first characters of closing lines. Others are sorted with the closing lines that share their
    head: all lines that begin with a line come right after it, so the next closing line decides.
    """
    heads = closing.where(F.char_length("line") > 1).select("line", F.explode(F.sequence(F.lit(1), F.least(F.lit(HEAD - 1), F.char_length("line") - 1))).alias("n"))
    short = asked.where(F.char_length("line") < HEAD).join(heads.select(F.expr("left(line, n)").alias("line")).distinct(), "line", "left_semi")
    both = asked.select("line", F.lit(True).alias("asks")).unionByName(closing.select("line", F.lit(False).alias("asks"))).where(F.char_length("line") >= HEAD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[str] = []
        for b in batches:
            found = []
            for line, asks in zip(b.column("line").to_pylist(), b.column("asks").to_pylist()):
                waiting = [w for w in waiting if line.startswith(w)]
                if asks:
                    waiting.append(line)
                else:
                    found += [w for w in waiting if w != line]
                    waiting = [w for w in waiting if w == line]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["line"])

    ordered = both.repartition(F.left("line", F.lit(HEAD))).sortWithinPartitions("line", F.col("asks").desc())
    return short.unionByName(ordered.mapInArrow(run, "line string")).distinct()


def finished_lines(base: DataFrame) -> DataFrame:
    """(line): templates of last list lines, of answers that end in one without a stop, that are not cut off."""
    asked = base.where(F.col("cut") == ASK).select("line").distinct()
    seen = base.select(F.explode("lines").alias("x")).groupBy(F.col("x.line").alias("line")).agg(F.sum(F.col("x.closes").cast("bigint")).alias("closed"), F.sum((~F.col("x.closes")).cast("bigint")).alias("inner"))
    closing = seen.where("closed > 0 and closed >= inner").select("line")
    longer = _begun(asked, closing)
    judged = asked.join(seen, "line", "left").join(longer.withColumn("longer", F.lit(True)), "line", "left")
    closes = F.coalesce((F.col("closed") > 0) & (F.col("closed") >= F.col("inner")), F.lit(False))
    return judged.where(closes | (F.col("closed").isNull() & F.col("longer").isNull())).select("line")


def unknown_calls(calls: DataFrame, catalogue: DataFrame, method: str = "method", path: str = "path") -> DataFrame:
    """(method, path), distinct, of the calls that no template of the catalogue fits."""
    asked = calls.select("method", "path").distinct().withColumn("segments", F.split("path", "/"))
    templates = catalogue.select(F.upper(method).alias("method"), F.split(F.trim(F.col(path), F.lit("/")), "/").alias("segments")).where("method is not null and segments is not null").distinct()
    is_slot = lambda s: s.startswith("{") & s.endswith("}")
    slots = F.transform("segments", is_slot)
    templates = templates.select("method", F.size("segments").alias("size"), slots.alias("slots"), F.array_join(F.transform("segments", lambda s: F.when(is_slot(s), "{}").otherwise(s)), "/").alias("key")).distinct()
    shapes = templates.select("size", "slots").distinct()
    keys = asked.withColumn("size", F.size("segments")).join(shapes, "size")
    keys = keys.select("method", "path", "size", "slots", F.array_join(F.zip_with("segments", "slots", lambda s, w: F.when(w, "{}").otherwise(s)), "/").alias("key"))
    known = keys.join(templates, ["method", "size", "slots", "key"], "left_semi").select("method", "path").distinct()
    return asked.select("method", "path").join(known, ["method", "path"], "left_anti")


def broken_pairs(df: DataFrame, record: str, prompt: str, answer: str, catalogue: DataFrame, *, recurring: int = 8) -> DataFrame:
    """(record, defect): one row for every defective pair."""
    rows = df.select(F.col(record).cast("bigint").alias("record"), F.col(prompt).alias("asked"), F.col(answer).alias("answer"))
    base = checkpoint(rows.mapInArrow(_read, _BASE_DDL))
    refusals = refusal_openings(base, recurring).withColumn("refuses", F.lit(True))
    finished = finished_lines(base).withColumn("finished", F.lit(True))
    called = base.where("has_call").select("record", F.explode("calls").alias("c")).select("record", "c.method", "c.path")
    invented = called.join(unknown_calls(called, catalogue), ["method", "path"], "left_semi").select("record").distinct().withColumn("invents", F.lit(True))
    open_rows = base.where("decided is null").select("record", "opening", "cut", "line", "foreign_prose")
    judged = open_rows.join(refusals, "opening", "left").join(finished, "line", "left").join(invented, "record", "left")
    cut = (F.col("cut") == YES) | ((F.col("cut") == ASK) & F.col("finished").isNull())
    defect = F.when(F.col("refuses"), "refusal").when(cut, "truncated").when(F.col("foreign_prose"), "other_language").when(F.col("invents"), "invented")
    found = judged.select("record", defect.alias("defect")).where("defect is not null")
    return base.where("decided is not null").select("record", F.col("decided").alias("defect")).unionByName(found)
