"""Markup residue in text: clean text that keeps headings, lists, code and formulas.

HTML, Markdown, wiki and LaTeX notation is recognised by its whole construct (a paired mark, a known tag, a
command with its argument), not by its signs, so comparisons, prices, placeholders in paths, wildcards, indexes,
names with underscores, regular expressions and raw data stay as they are. Code and formulas are taken out
first and are not looked into. Then markup is stripped line by line, and the line-block distribution decides
what is text: over a sliding window of lines the lengths of stripped text and of what stood there before are summed;
a surge, where the text's share of the window reaches ``SHARE``, opens a block and a dive, where it falls below,
closes it. Lines between are kept, and so are lines that carry structure or end a sentence; what falls are blocks of at
least as many lines as a window that were nearly all markup, such as bars of links, and what was only markup (table
rules, closing tags).

In the clean text a heading is a line of its own, a list item starts with a bullet, two spaces in for each list around
it, the cells of a table row are set apart by tabs, code is indented by four spaces and a formula is its source without
delimiters; ``blocks`` has the same with the kind and depth of each block.

Defined results: null gives null, without markup; a value without markup comes out unchanged, empty and blank
ones included; repeated rows are cleaned each for itself; nesting is followed to any depth.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML, and tags of wikis, that count as tags.
TAGS = "a abbr address article aside b blockquote body br button caption center cite code col dd del details div dl dt em figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark meta nav nowiki ol option p pre q ref s samp script section select small span strike strong style sub summary sup svg table tbody td th thead title tfoot tr tt u ul var video"
# Commands of LaTeX that stand without an argument in braces.
BARE_COMMANDS = "item hline maketitle centering noindent newpage tableofcontents bigskip medskip smallskip par newline"

_TAG_NAMES = "|".join(sorted(TAGS.split(), key=len, reverse=True))
_ATTR = r"""\s+[A-Za-z_:][\w:.-]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>=]+))"""
_BARE_ATTR = r"\s+[A-Za-z_:][\w:.-]*"
_TAG = re.compile(rf"<(/?)({_TAG_NAMES})((?:{_ATTR})*(?:{_BARE_ATTR})*(?:{_ATTR})*)\s*/?>", re.I)
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!DOCTYPE[^>]*>|<\?xml[^>]*\?>", re.S | re.I)
_ENTITY = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]{1,31}|#\d{1,7}|#[xX][0-9A-Fa-f]{1,6});")
_FENCE = re.compile(r"^[ \t]*(```+|~~~+)[^\n`]*\n(.*?)(?:^[ \t]*\1[ \t]*$|\Z)|```(?:[a-z]+\s)?(.+?)```", re.S | re.M)
#: Code, formulas and scripts by notation, kind and pattern, with what ends them.
_PRE = re.compile(r"<pre\b[^<>]*>\s*(?:<code\b[^<>]*>)?(.*?)(?:</code>\s*)?</pre>", re.S | re.I)
_BLOCKS = [
    ("html", "code", _PRE, "</pre>"),
    ("html", "code", re.compile(r"<code\b[^<>]*>(.*?)</code>", re.S | re.I), "</code>"),
    ("html", "code", re.compile(r"<source\b[^<>]*>(.*?)</source>", re.S | re.I), "</source>"),
    ("html", "code", re.compile(r"<syntaxhighlight\b[^<>]*>(.*?)</syntaxhighlight>", re.S | re.I), "</syntaxhighlight>"),
    ("latex", "code", re.compile(r"\\begin\{verbatim\}\n?(.*?)\\end\{verbatim\}", re.S), "\\end{verbatim}"),
    ("latex", "code", re.compile(r"\\begin\{lstlisting\}(?:\[[^\]]*\])?\n?(.*?)\\end\{lstlisting\}", re.S), "\\end{lstlisting}"),
    ("latex", "code", re.compile(r"\\begin\{minted\}(?:\[[^\]]*\])?(?:\{[^}]*\})?\n?(.*?)\\end\{minted\}", re.S), "\\end{minted}"),
    ("wiki", "inline code", re.compile(r"\{\{code\|(.*?)\}\}", re.S | re.I), "}}"),
    ("latex", "math", re.compile(r"\$\$(.+?)\$\$", re.S), "$$"),
    ("latex", "math", re.compile(r"\\\[(.+?)\\\]", re.S), "\\]"),
    *[("latex", "math", re.compile(r"\\begin\{%s\}(.+?)\\end\{%s\}" % (re.escape(n), re.escape(n)), re.S), f"\\end{{{n}}}") for e in ("equation", "align", "gather", "math", "displaymath") for n in (e, e + "*")],
    ("latex", "math", re.compile(r"<math\b[^<>]*>(.+?)</math>", re.S | re.I), "</math>"),
    ("latex", "math", re.compile(r"\{\{math\|(.+?)\}\}", re.S), "}}"),
]
_MATH_INLINE = re.compile(r"(?<![\\$\w])\$(?=[^\s$])([^$\n]+?)(?<=[^\s\\$])\$(?![\w$])|\\\((.+?)\\\)")
_MATH_LIKE = re.compile(r"\\[A-Za-z]{2,}|[_^]\{|[A-Za-z0-9)]\s*[\^_=<>+/*-]\s*[A-Za-z0-9\\({]|^[A-Za-z]$")
_SCRIPTS = [(re.compile(rf"<{n}\b[^<>]*>.*?</{n}>", re.S | re.I), f"</{n}>") for n in ("script", "style")]

_INLINE = [
    ("markdown", re.compile(r"!?(?<![\w\]])\[((?:[^\[\]\n]|\[[^\[\]\n]*\])*)\]\(\s*<?(?:[^\s()<>]|\([^\s()]*\))*>?(?:\s+\"[^\"\n]*\")?\s*\)"), 1),
    ("markdown", re.compile(r"(?m)^\[[^\]\n]+\]:\s+\S+.*$"), 0),
    ("markdown", re.compile(r"<((?:https?|mailto|ftp):[^\s<>]+)>"), 1),
    ("wiki", re.compile(r"\[\[(?:[^\[\]\n|]*\|)*(?![\s\d,.\"'{-]*\]\])(?!\s)([^\[\]\n|]+)\]\]"), 1),
    ("wiki", re.compile(r"\[(?:https?|ftp)://[^\s\[\]]+(?:[ \t]+([^\[\]\n]*))?\]"), 1),
    ("wiki", re.compile(r"\{\{(?![\s\"{])[^{}]+\}\}"), 0),
    ("wiki", re.compile(r"'''''(?=\S)(.+?)(?<=\S)'''''|'''(?=\S)(.+?)(?<=\S)'''|(?<!')''(?=[^\s'])([^'\n]+?(?:'[^'\n]+?)*)(?<=\S)''(?!')"), 1),
    ("wiki", re.compile(r"__(?:NO)?(?:TOC|EDITSECTION|FORCETOC|INDEX)__"), 0),
    ("markdown", re.compile(r"(?<![\w`\\])(`{1,2})(?!`)([^`\n]+?)\1(?![\w`])"), 2),
    ("markdown", re.compile(r"(?<![\w*\\])\*\*\*?(?=[^\s*])([^\n]+?)(?<=[^\s*])\*\*\*?(?![\w*])"), 1),
    ("markdown", re.compile(r"(?<![\w*\\/.])\*(?=[\w(\"'\[~_`])([^*\n]+?)(?<=[\w.,!?)\"'\]~_`])\*(?![\w*/.])"), 1),
    ("markdown", re.compile(r"(?<![\w\\./])__(?=[^\s_])([^\n]+?)(?<=[^\s_])__(?![\w(/])"), 1),
    ("markdown", re.compile(r"(?<![\w\\./{<$-])_(?=[^\W_])([^_\n]*[^\W_][.!?]?)_(?![\w/}>-])"), 1),
    ("markdown", re.compile(r"(?<!~)~~(?=[^\s~])([^~\n]+?)(?<=[^\s~])~~(?!~)"), 1),
]
#: What ends the paired marks; in lines longer than LONG it is looked for first, with the same result.
LONG = 2_000
_ENDS = {p: re.compile(e) for (_, p, _), e in zip(_INLINE[-6:], (r"(?<=[^\n])`(?![\w`])", r"(?<=[^\s*])\*\*\*?(?![\w*])", r"(?<=[\w.,!?)\"'\]~_`])\*(?![\w*/.])", r"(?<=[^\s_])__(?![\w(/])", r"(?<=[^\W_])[.!?]?_(?![\w/}>-])", r"(?<=[^\s~])~~(?!~)"))}
#: Every notation within a line has one of these.
_MARKS = re.compile(r"[<&`*_~\[{\\]|''")
_LATEX = re.compile(r"\\(?:begin|end)\{[A-Za-z*]+\}(?:\[[^\]\n]*\]|\{[^{}\n]*\})*|\\href\{[^{}\n]*\}\{([^{}\n]*)\}|\\[A-Za-z]{2,}\*?(?:\[[^\]\n]*\])*\{([^{}\n]*)\}" + rf"|\\(?:{'|'.join(BARE_COMMANDS.split())})\b(?:\[[^\]\n]*\])?[ \t]?")

_HEADING = [re.compile(r"^ {0,3}#{1,6}[ \t]+(\S.*?)[ \t]*#*[ \t]*$"), re.compile(r"^(={1,6})[ \t]*([^=\s](?:.*?[^=\s])?)[ \t]*\1[ \t]*$"), re.compile(r"^\\(?:chapter|section|subsection|subsubsection|paragraph|part)\*?\{(.*?)\}[ \t]*$"), re.compile(r"^[ \t]*<h[1-6]\b[^<>]*>(.*?)(?:</h[1-6]>.*)?$", re.I)]
_UNDERLINE = re.compile(r"^(?:={3,}|-{3,})[ \t]*$")
_RULE = re.compile(r"^[ \t]*(?:-{3,}|\*{3,}|_{3,}|(?:\* ){2,}\*|(?:- ){2,}-)[ \t]*$")
_ITEM = re.compile(r"^([ \t]*)(?:[-*+\u2022]|[*#]+|\d{1,3}[.)]|\\item(?:\[[^\]\n]*\])?)[ \t]+(?:\[[ xX]\][ \t]+)?(\S.*)$")
_QUOTE = re.compile(r"^[ \t]*>+(?:[ \t]|$)(?:\[![A-Za-z]+\][ \t]*)?")
_ROW = re.compile(r"^[ \t]*\|(.+)\|[ \t]*$")
_ROW_RULE = re.compile(r"^[ \t]*\|?(?:[ \t]*:?-{2,}:?[ \t]*\|)+(?:[ \t]*:?-{2,}:?[ \t]*)?$")
_WIKI_TABLE = re.compile(r"^[ \t]*(?:\{\|.*|\|\}|\|-+.*|\|\+.*)$")
_WIKI_CELL = re.compile(r"^[ \t]*[|!][ \t]*(\S.*)$")
#: A value without any of these holds no markup.
_SPECIAL = re.compile(r"[<&`*_~\[{$\\|]|''|^[ \t]*(?:[#>+-]+|•|\d{1,3}[.)])[ \t]|^={1,6}|^-{3,}", re.M)
#: Lines in a window, and the share of text that a window of a block has at least.
WINDOW, SHARE = 3, 0.25
_STRUCTURE = re.compile(r"<(/?)(ul|ol|li|tr|td|th|h[1-6])\b((?:%s)*(?:%s)*(?:%s)*)\s*/?>" % (_ATTR, _BARE_ATTR, _ATTR), re.I)
_SECTION = re.compile(r"[ \t]*(\\(?:chapter|section|subsection|subsubsection|paragraph|part)\*?\{[^{}\n]*\})[ \t]*")
#: Elements of other vocabularies count only with their end.
_CUSTOM = re.compile(r"<(/?)([A-Za-z]\w*[:-][\w:.-]*)(?:%s)*\s*(/?)>" % _ATTR)
_SENTENCE_END = re.compile(r"[.!?:;…][\"'”»)\]]*$")


@lru_cache(maxsize=64)
def _hold_pattern(code: str, math: str, end: str) -> re.Pattern:
    return re.compile(f"[{code}{math}](\\d+){end}")


def _is_row_rule(line: str) -> bool:
    bare = line.strip(" \t")
    return bare[:1] in ("|", ":", "-") and not bare.strip("|:- \t") and _ROW_RULE.match(bare) is not None


def _marks(text: str) -> tuple[str, ...]:
    """Five characters for private use that the text hasn't."""
    return tuple(islice((c for c in map(chr, chain(range(0xE000, 0xF900), range(0xF0000, 0xFFFFE), range(0x100000, 0x10FFFE))) if c not in text), 5))


def _tag_ok(m: re.Match) -> bool:
    """A one-letter name with bare words after it (``a <b and c> d``) is a comparison."""
    return len(m[2]) > 1 or "=" in m[3] or not m[3].strip()


def _entity(m: re.Match) -> str:
    plain = html.unescape(m[0])
    return m[0] if plain == m[0] else "\u00a0" if plain == "\u00a0" else plain


class _Cleaner:
    def __init__(self, text: str) -> None:
        self.kinds: dict[str, int] = {}
        self.held: list[str] = []
        self.code, self.math, self.end, self.item, self.row = _marks(text)
        self.holds = _hold_pattern(self.code, self.math, self.end)

    def note(self, kind: str, n: int = 1) -> None:
        self.kinds[kind] = self.kinds.get(kind, 0) + n

    def hold(self, kind: str, mark: str, unescape: bool = False, block: bool = True):
        def put(m: re.Match) -> str:
            body = next((g for g in reversed(m.groups()) if g is not None), "")
            if m.re is _MATH_INLINE and not _MATH_LIKE.search(body):
                return m[0]
            self.note(kind)
            self.held.append(html.unescape(body) if unescape else body)
            own = block and "\n" in body.strip() or block and mark == self.code and m[0].startswith(("```", "<pre", "<PRE", "\\begin"))
            put_in = f"{mark}{len(self.held) - 1}{self.end}"
            return f"\n{put_in}\n" if own else put_in

        return put

    def paired(self, pattern: re.Pattern, end: str, s: str, put) -> str:
        """The pattern's matches replaced, none of which is looked for after the last ``end``: openings without one cost nothing."""
        last = s.rfind(end)
        if end[0] == "<":  # names of elements in any case
            last = max((m.start() for m in re.finditer(re.escape(end), s, re.I)), default=-1)
        return s if last < 0 else pattern.sub(put, s[: last + len(end)]) + s[last + len(end) :]

    def custom(self, s: str) -> str:
        """Without the elements of other vocabularies that are ended, by their tags in pairs."""
        open_now: dict[str, list[tuple[int, int]]] = {}
        cut = []
        for m in _CUSTOM.finditer(s):
            if m[3]:
                cut.append(m.span())
            elif not m[1]:
                open_now.setdefault(m[2], []).append(m.span())
            elif open_now.get(m[2]):
                cut += [open_now[m[2]].pop(), m.span()]
        if not cut:
            return s
        self.note("html", len(cut))
        at, out = 0, []
        for a, z in sorted(cut):
            out.append(s[at:a])
            at = z
        return "".join([*out, s[at:]])

    def inline(self, s: str) -> str:
        if not _MARKS.search(s):
            return s

        def tag(m: re.Match) -> str:
            if not _tag_ok(m):
                return m[0]
            self.note("html")
            return "\n" if m[2].lower() in ("br", "p", "div", "li", "tr", "ul", "ol", "table", "hr") else " " if m[2].lower() in ("td", "th") else ""

        s = _TAG.sub(tag, s)
        if "<" in s:
            s = self.custom(s)
        for kind, pattern, group in _INLINE:
            while True:  # nested marks

                def plain(m: re.Match, kind: str = kind, group: int = group) -> str:
                    self.note(kind)
                    return "" if not group else next((g for g in m.groups()[group - 1 :] if g is not None), "")

                end = len(s)
                if end > LONG and pattern in _ENDS:  # no opening can be closed after the last end
                    end = max((m.end() for m in _ENDS[pattern].finditer(s)), default=0)
                done, n = pattern.subn(plain, s[:end])
                s = done + s[end:]
                if not n:
                    break
        while True:

            def command(m: re.Match) -> str:
                self.note("latex")
                return m[1] if m[1] is not None else m[2] if m[2] is not None else ""

            s, n = _LATEX.subn(command, s)
            if not n:
                break

        def entity(m: re.Match) -> str:
            plain = _entity(m)
            if plain != m[0]:
                self.note("html")
            return plain

        return _ENTITY.sub(entity, s)

    def structured(self, s: str) -> str:
        """Items, rows and headings on lines of their own: items and rows with a mark, items indented by their lists."""
        depth = 0

        def place(m: re.Match) -> str:
            nonlocal depth
            name, closing = m[2].lower(), bool(m[1])
            if name[0] == "h":  # read as a heading with its tag
                return m[0] + "\n" if closing else "\n" + m[0]
            self.note("html")
            if name in ("ul", "ol"):
                depth = max(0, depth - 1) if closing else depth + 1
                return "\n" if closing and not depth else ""
            if name == "li":
                return "" if closing else f"\n{self.item}{max(0, depth - 1)}{self.end}"
            if name == "tr":
                return "" if closing else "\n" + self.row
            return "" if closing else "\t"

        if "<" in s:
            s = _STRUCTURE.sub(place, s)
        if "\\" in s:
            s = _SECTION.sub(lambda m: f"\n{m[1]}\n", s)
        return s

    def lines(self, text: str) -> list[tuple[str, str, int, float, int]]:
        """(kind, stripped line, length of its text, length before, depth); a line that was all markup has no text."""
        raw, out, i = self.structured(text).split("\n"), [], 0
        table = any(_is_row_rule(x) for x in raw) or any(x.lstrip().startswith("{|") for x in raw)
        while i < len(raw):
            line, kind, body, depth = raw[i], "text", None, 0
            whole = len(line.strip())
            if line[:1] == self.item:
                told, body = line[1:].split(self.end, 1)
                kind, depth = "item", int(told)
            elif line[:1] == self.row:
                kind, body = "row", line[1:].strip("\t")
            elif _QUOTE.match(line):
                self.note("markdown")
                line = _QUOTE.sub("", line)
            if body is not None:
                pass
            elif (m := next((m for p in _HEADING if (m := p.match(line))), None)) is not None and not (m.re is _HEADING[1] and len(m[1]) == 1 and m[2][:1] in "=<>!"):
                self.note("markdown" if m.re is _HEADING[0] else "wiki" if m.re is _HEADING[1] else "latex" if m.re is _HEADING[2] else "html")
                kind, body = "heading", m[m.lastindex]
            elif i + 1 < len(raw) and line.strip() and _UNDERLINE.match(raw[i + 1]) and not _UNDERLINE.match(line):
                self.note("markdown")
                kind, body, i = "heading", line, i + 1
            elif _RULE.match(line) or _UNDERLINE.match(line):
                self.note("markdown")
                body = ""
            elif table and (_is_row_rule(line) or _WIKI_TABLE.match(line)):
                self.note("wiki" if line.lstrip()[:2] in ("{|", "|-", "|}", "|+") and "--" not in line else "markdown")
                body = ""
            elif table and (m := _ROW.match(line) or _WIKI_CELL.match(line)):
                self.note("markdown")
                kind, body = "row", re.sub(r"[ \t]*(?:\|\|?|!!)[ \t]*", "\t", m[1])
            elif m := _ITEM.match(line):
                mark = line[: len(line) - len(m[2])].strip()
                self.note("latex" if "\\item" in mark else "markdown")
                kind, body = "item", m[2]
                depth = len(mark) - 1 if len(mark) > 1 and not mark.strip("*#") else len(m[1].expandtabs(4)) // 2
            body = self.inline(line if body is None else body)
            bare = body.strip()
            if kind == "text" and (held := self.holds.fullmatch(bare)):
                kind = "code" if bare[0] == self.code else "formula"
            parts = body.split("\n") if kind in ("text", "row") else [" ".join(body.split())]
            text_length = sum(len(p.strip()) for p in parts)
            for part in parts:
                n = len(part.strip())
                out.append((kind, part, n, whole * n / text_length if text_length else whole / len(parts), depth))
            i += 1
        return out

    def restore(self, s: str) -> str:
        while self.holds.search(s):
            s = self.holds.sub(lambda m: self.held[int(m[1])], s)
        return s


def _dense(texts: list[int], wholes: list[float]) -> list[bool]:
    """Lines between a surge and a dive of the text's share over WINDOW lines; windows without anything go with the line before."""
    keep, inside = [], False
    for i in range(len(texts)):
        low, high = max(0, i - WINDOW // 2), i + WINDOW // 2 + 1
        text, whole = sum(texts[low:high]), max(sum(wholes[low:high]), sum(texts[low:high]))
        if whole:
            inside = text > 0 and text >= SHARE * whole  # a surge opens the block, a dive closes it
        keep.append(inside)
    at = 0
    for kept, run in groupby(keep[:]):
        n = len(list(run))
        if not kept and sum(t > 0 for t in texts[at : at + n]) < WINDOW:  # too short to be a block of markup
            keep[at : at + n] = [t > 0 for t in texts[at : at + n]]
        at += n
    return keep


def clean(text: str | None) -> tuple[str | None, list[dict], dict[str, int]]:
    """(clean text, blocks, pieces of markup by notation) of a value."""
    if text is None:
        return None, [], {}
    if not _SPECIAL.search(text):
        return text, [{"kind": "text", "text": text, "depth": 0}] if text.strip() else [], {}
    s = text.replace("\r\n", "\n")
    c = _Cleaner(s)
    s = _FENCE.sub(c.hold("markdown", c.code), s)
    for kind, what, pattern, end in _BLOCKS:
        if "</" in s if end[0] == "<" else end in s:
            s = c.paired(pattern, end, s, c.hold(kind, c.math if what == "math" else c.code, unescape=kind == "html", block=what != "inline code"))
    s = _MATH_INLINE.sub(c.hold("latex", c.math, block=False), s)
    s, n = _COMMENT.subn(" ", s)
    if n:
        c.note("html", n)
    for pattern, end in _SCRIPTS if "</" in s else ():
        s = c.paired(pattern, end, s, lambda m: c.note("html") or " ")
    lines = c.lines(s)
    if not c.kinds:
        return text, [{"kind": "text", "text": text, "depth": 0}] if text.strip() else [], {}
    keep = _dense([n for _, _, n, _, _ in lines], [w for *_, w, _ in lines])
    blocks: list[dict] = []
    for (kind, line, _, whole, depth), kept in zip(lines, keep):
        if not kept and whole and kind == "text" and not _SENTENCE_END.search(line.rstrip()):
            continue
        if kind in ("code", "formula"):
            body = c.restore(line.strip()).strip("\n")
        else:
            body = re.sub(r"[ \t]{2,}", " " if kind != "row" else "\t", c.restore(line)).strip()
        if body or kind == "text":
            blocks.append({"kind": kind, "text": body, "depth": depth})
    shown, gap = [], False
    for b in blocks:
        if not b["text"]:
            gap = bool(shown)
            continue
        if gap or (shown and b["kind"] in ("heading", "code")):
            shown.append("")
        gap = b["kind"] in ("heading", "code")
        shown.append("  " * b["depth"] + "\u2022 " + b["text"] if b["kind"] == "item" else "\n".join("    " + x for x in b["text"].split("\n")) if b["kind"] == "code" else b["text"])
    return "\n".join(shown), [b for b in blocks if b["text"]], c.kinds


_OUT = pa.schema([("key", pa.int64()), ("field", pa.string()), ("clean", pa.string()), ("blocks", pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string()), ("depth", pa.int32())]))), ("notations", pa.list_(pa.string())), ("pieces", pa.int32())])
_OUT_DDL = "key bigint, field string, clean string, blocks array<struct<kind: string, text: string, depth: int>>, notations array<string>, pieces int"


def _clean_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        done = [clean(t) for t in b.column("value").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("field").cast(pa.string()), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], _OUT.field("blocks").type), pa.array([sorted(d[2]) for d in done], _OUT.field("notations").type), pa.array([sum(d[2].values()) for d in done], pa.int32())], schema=_OUT)


def clean_markup(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field, clean, blocks, notations, pieces): one row for each of the columns of each row."""
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("f")
    return df.select(F.col(key).cast("bigint").alias("key"), fields).select("key", "f.field", "f.value").mapInArrow(_clean_all, _OUT_DDL)
