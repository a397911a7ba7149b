"""Secret scans: fixed patterns, and a lexer that reads assignments.

The lexer reads the assignments that source code and configuration share as pairs of a name and pieces
of a value (see pairs). A name on the right stands for the literals that it was last given, so constants
propagate through chains of names and through joined strings. A literal is scored by how sensitive the
words of its target names, and of the keys above them, are, and by how little it looks like a word or a
placeholder.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import slices

#: Kinds of spans in their order; the first three are the base.
KINDS = ("assign", "access", "hex", "literal")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24 or more; shorter runs would fail and be dropped

# name, closers, perhaps a type, sign; or a brace. Possessive, and a name begins where none goes on, so linear.
_PAIR = re.compile(r"""(?<![A-Za-z0-9_$.-])([A-Za-z0-9_$.-]++)["'`\])]*+[ \t]*+(?::[ \t]*+[A-Za-z_&][A-Za-z0-9_.\[\]<>|?*,]*+[ \t]*+(?==[^=>]))?(:=|=>|==|::|=|:(?!//))|([{}])""")
_STRING = re.compile(
    r"""[A-Za-z@$]{0,2}(?:\"{3}((?:[^"\\]|\\.|"(?!""))*+)\"{3}|'{3}((?:[^'\\]|\\.|'(?!''))*+)'{3}|"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`((?:[^`\\]|\\.)*+)`)""", re.DOTALL
)
_BARE = re.compile(r"""[A-Za-z0-9_$+/.~-][^\s"'`,;(){}\[\]<>]*+""")
_BLANKS = re.compile(r"[ \t]*+(?:\\\r?\n[ \t]*+)*+")  # and lines that a backslash continues
_SPACE = re.compile(r"\s*+")
_NEXT_LINE = re.compile(r"[ \t]*+\r?\n[ \t]*+(?=[A-Za-z@$]{0,2}[\"'`])")  # a string follows there
_PLUS = re.compile(r"(?:\+|&|\.\.?)(?!=)\s*+")
_BLOCK = re.compile(r"[|>][+0-9-]*+[ \t]*+(?:#[^\n]*+)?\r?\n")
_LINE = re.compile(r"([ \t]*+)([^\n]*+)(?:\n|\Z)")
_SIGN = re.compile(r"[ \t]*+(?::=|=(?![=>]))")
_KEY_SIGN = re.compile(r"[ \t]*+[:=]")
_ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.-]*)>([^<>\n]+)</\1>")
_NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_.$]*\Z")
_ABOVE = 0.8  # of what a name counts for, for the keys above it
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

# How sensitive a word of a name is, and what stands where a secret is left out.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "apikey": 1.0,
    "token": 0.9, "credential": 0.9, "credentials": 0.9, "bearer": 0.7, "auth": 0.5, "private": 0.5,
    "access": 0.4, "key": 0.4, "api": 0.4, "signing": 0.4, "encryption": 0.4, "salt": 0.4, "session": 0.3,
}
PLACEHOLDERS = ("example", "changeme", "placeholder", "your", "dummy", "redacted", "xxxx", "****", "${", "{{", "none", "null", "true", "false")


def sensitive_words(name: str) -> frozenset[str]:
    """The sensitive words of a name in snake, kebab, dotted or camel case."""
    return frozenset(w for w in (x.lower() for x in _WORD.findall(name)) if w in SENSITIVE)


def name_score(own: frozenset[str], above: frozenset[str] = frozenset()) -> float:
    """From 0 to 1, by the sensitive words of a name; those of the keys that it lies under count less."""
    score = lambda words: min(1.0, sum(SENSITIVE[w] for w in words))
    return max(score(own), _ABOVE * score(own | above))


_EDGE = max(map(len, PLACEHOLDERS)) - 1  # characters at an end that can be part of a placeholder across it
_LARGE = 200  # the power of 2 from which counts are scaled down; they stay exact below 2^53


class Summary:
    """What the score of a joined literal follows from: its length, the counts of its characters, whether a
    placeholder is in it, its ends, and whether all of it is quoted. Joining two takes time in the number of
    different characters, whatever the length."""

    __slots__ = ("counts", "head", "placeholder", "power", "quoted", "size", "tail")

    def __init__(self, literal: str = "", quoted: bool = True):
        low = literal.lower()
        self.size, self.quoted = float(len(literal)), quoted
        self.counts, self.power = {c: float(k) for c, k in Counter(literal).items()}, 0  # times 2^power
        self.placeholder = any(p in low for p in PLACEHOLDERS)
        self.head, self.tail = low[:_EDGE], low[-_EDGE:]

    def add(self, other: Summary) -> None:
        across = self.tail + other.head
        self.placeholder = self.placeholder or other.placeholder or any(p in across for p in PLACEHOLDERS)
        self.head, self.tail = (self.head + other.head)[:_EDGE], (self.tail + other.tail)[-_EDGE:]
        self.quoted = self.quoted and other.quoted
        self.size = min(self.size + other.size, 1e300)
        power = max(self.power, other.power)
        if power > self.power:
            self.counts = {c: math.ldexp(k, self.power - power) for c, k in self.counts.items()}
        for c, k in other.counts.items():
            self.counts[c] = self.counts.get(c, 0.0) + math.ldexp(k, other.power - power)
        self.power = power
        if max(self.counts.values(), default=0.0) > 2.0**_LARGE:
            self.counts = {c: math.ldexp(k, -_LARGE) for c, k in self.counts.items()}
            self.power += _LARGE

    def score(self) -> float:
        """From 0 to 1: random-looking literals score high, words and placeholders low."""
        if self.size < 6 or self.placeholder:
            return 0.0
        if " " in self.counts:
            return 0.6 if self.quoted and any(c.isdigit() for c in self.counts) else 0.2
        n = sum(self.counts.values())
        entropy = -sum(k / n * math.log2(k / n) for k in self.counts.values() if k)
        if any(c.isdigit() for c in self.counts) and any(c.isalpha() for c in self.counts) and entropy >= 2.3:
            return 1.0
        if self.size >= 16 and entropy >= 3.5:
            return 0.8
        return 0.6 if self.quoted and self.size >= 8 and entropy >= 2.3 else 0.2


class Value:
    """What a name was given: literals (start, end, text, quoted) and values of other names, which are referred
    to, never copied. What follows from a value is worked out once."""

    __slots__ = ("listed", "parts", "summary")

    def __init__(self, parts: list):
        self.parts, self.summary, self.listed = parts, None, False

    def summed(self) -> Summary:
        waiting = [self]
        while waiting:
            top = waiting[-1]
            open_parts = [p for p in top.parts if isinstance(p, Value) and p.summary is None] if top.summary is None else []
            if open_parts:
                waiting += open_parts
                continue
            waiting.pop()
            if top.summary is None:
                top.summary = Summary()
                for p in top.parts:
                    top.summary.add(p.summary if isinstance(p, Value) else Summary(p[2], p[3]))
        return self.summary

    def list_into(self, out: list[tuple[int, int]]) -> None:
        """Adds the spans of all literals that have not been listed before."""
        waiting = [self]
        while waiting:
            top = waiting.pop()
            if not top.listed:
                top.listed = True
                out += [p[:2] for p in top.parts if not isinstance(p, Value) and p[0] < p[1]]
                waiting += [p for p in top.parts if isinstance(p, Value)]


def literal_score(literal: str, quoted: bool) -> float:
    return Summary(literal, quoted).score()


@dataclass
class Pair:
    """A name and what is assigned to it: pieces (start, end, text, whether it is quoted, name it may be)."""

    own: str
    above: frozenset[str]
    pieces: list[tuple[int, int, str, bool, str | None]]


def _string(text: str, at: int):
    found = _STRING.match(text, at)
    if not found:
        return None
    k = found.lastindex
    inner = found[k]
    return (found.start(k), found.end(k), re.sub(r"\\\r?\n?(.?)", r"\1", inner, flags=re.DOTALL) if "\\" in inner else inner, True, None), found.end()


def _term(text: str, at: int):
    """The string, number, word or name at a place, and where it ends; None if there is none."""
    if found := _string(text, at):
        return found
    bare = _BARE.match(text, at)
    return bare and ((at, bare.end(), bare[0], False, bare[0] if _NAME.match(bare[0]) else None), bare.end())


def _block(text: str, at: int, indent: int):
    """The lines from ``at`` that are indented by more than ``indent``, as one piece."""
    start, end, lines = None, at, []
    while at < len(text):
        line = _LINE.match(text, at)
        if line[2].strip():
            if len(line[1]) <= indent:
                break
            start = line.start(2) if start is None else start
            end = line.start(2) + len(line[2].rstrip())
            lines.append(line[2].strip())
        at = line.end()
    return ([(start, end, "".join(lines), True, None)], end) if lines else ([], at)


def _value(text: str, at: int, sign: str, indent: Callable[[], int]):
    """The pieces of the value after a sign, joined by operators or by standing side by side, and its end."""
    at = _BLANKS.match(text, at).end()
    if sign == ":" and (block := _BLOCK.match(text, at)):
        return _block(text, block.end(), indent())
    if sign != ":" and (line := _NEXT_LINE.match(text, at)):
        at = line.end()
    inside = 0
    while text.startswith("(", at):
        inside, at = inside + 1, _SPACE.match(text, at + 1).end()
    term = _term(text, at)
    if not term:
        return [], at
    pieces, end = [term[0]], term[1]
    while pieces[-1][3] or pieces[-1][4]:
        at = (_SPACE if inside else _BLANKS).match(text, end).end()
        if plus := _PLUS.match(text, at):
            more = _string(text, plus.end()) if plus[0].startswith(".") or not pieces[-1][3] else _term(text, plus.end())
        else:
            if not inside and sign != ":" and (line := _NEXT_LINE.match(text, at)):
                at = line.end()
            more = _string(text, at) if pieces[-1][3] else None
            if more and _KEY_SIGN.match(text, more[1]):
                more = None  # a key, which begins what comes next
        if not more:
            break
        pieces.append(more[0])
        end = more[1]
    return pieces, end


def pairs(text: str) -> list[Pair]:
    """The assignments of source and configuration text, in its order: ``name = value`` in the forms that
    languages share (``=``, ``:=``, ``=>``, ``:``, quoted keys, subscripts, type annotations), values in all
    kinds of quotes with escapes, joined by operators or adjacency, over continued lines and in
    parentheses, YAML block scalars, keys nested in braces or by indentation, and XML elements. One pass from
    left to right, linear in the text: names and values may have any length."""
    found: list[Pair] = []
    at, line, looked = 0, 0, 0
    braces: list[frozenset[str]] = []
    indents: list[tuple[int, frozenset[str]]] = []
    pending = nothing = frozenset()
    while m := _PAIR.search(text, at):
        at = m.end()
        if m[3] == "{":
            braces.append((braces[-1] if braces else nothing) | pending)
            pending = nothing
            continue
        if m[3] == "}":
            if braces:
                braces.pop()
            continue
        pending = nothing
        if m[2] in ("==", "::"):
            continue
        newline = text.rfind("\n", looked, m.start())
        line, looked = newline + 1 if newline >= 0 else line, m.start()
        column = m.start() - line
        while indents and indents[-1][0] >= column:
            indents.pop()
        above = (braces[-1] if braces else nothing) | (indents[-1][1] if indents else nothing)
        pieces, end = _value(text, at, m[2], lambda: len(text[line : m.start()]) - len(text[line : m.start()].lstrip(" \t")))
        if pieces:
            found.append(Pair(m[1], above, pieces))
            chained = len(pieces) == 1 and pieces[0][4] and _SIGN.match(text, end)  # a = b = value
            at = pieces[0][0] if chained else end
        elif text.startswith("{", end):
            pending = above | sensitive_words(m[1])
        elif m[2] == ":" and (end == len(text) or text[end] in "\r\n"):
            indents.append((column, above | sensitive_words(m[1])))
    if "</" in text:
        found += [Pair(m[1], nothing, [(m.start(2), m.end(2), m[2], True, None)]) for m in _ELEMENT.finditer(text)]
        found.sort(key=lambda p: p.pieces[0][0])
    return found


def literals(text: str, least: float = 0.5) -> list[tuple[int, int]]:
    """Spans of literals whose score, for the most sensitive name that they reach, is ``least``. A name on the
    right stands for what it was last given, or else for what it is given later, alone and within joined
    values; every piece of a joined value that reaches ``least`` is a span."""
    found = pairs(text)
    later = {p.own: Value([x[:4] for x in p.pieces]) for p in reversed(found) if any(x[4] is None for x in p.pieces)}
    given: dict[str, Value] = {}
    out: list[tuple[int, int]] = []
    for p in found:
        parts = []
        for a, b, string, quoted, name in p.pieces:
            known = None if name is None else given.get(name) or later.get(name)
            if known or name is None or len(p.pieces) == 1:
                parts.append(known or (a, b, string, quoted))
        given[p.own] = value = Value(parts) if parts else None
        own = sensitive_words(p.own)
        score = name_score(own, p.above) if own or p.above else 0.0
        if score and value and score * value.summed().score() >= least:
            value.list_into(out)
    return sorted(set(out))


def spans(text: str | None) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, secret's start) by start, then kind; places are code points, kind is a place
    in KINDS. A literal that lies within a span of the base is not repeated."""
    if not text:
        return []
    found = []
    if ":" in text or "=" in text:
        found += [(0, m.start(), m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(1, m.start(), m.end(), m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(2, m.start(), m.end(), m.start()) for m in _HEX.finditer(text)]
    base, k, end = sorted((s, e) for _, s, e, _ in found), 0, 0
    for a, b in literals(text) if ":" in text or "=" in text or "</" in text else ():  # both by start
        while k < len(base) and base[k][0] <= a:
            end, k = max(end, base[k][1]), k + 1
        if b > end:
            found.append((3, a, b, a))
    return sorted(found, key=lambda s: (s[1], s[0]))


def redact(text: str, found: list[tuple[int, int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with ``mark`` in place of each secret; overlapping secrets share one."""
    out, at, covered = [], 0, -1
    for a, b in sorted((s[3], s[2]) for s in found):
        if a >= covered:
            out += [text[at:a], mark] if covered < a or not out else []
            at = covered = b
        elif b > covered:
            at = covered = b
    return "".join(out) + text[at:]


def scan(docs: DataFrame, text: str = "text", redacted: bool = False) -> DataFrame:
    """Adds ``secrets``, an array of (kind, start, end, secret_start) for each row's whole text, to the
    columns of ``docs`` (one of that name is replaced); if ``redacted``, the text too is replaced by
    one without the secrets. Null texts have no secrets and stay null. Each row is looked at by
    itself, so repeated rows, ties and null ids make no difference; an empty table gives no rows."""
    docs = docs.select([c for c in docs.columns if c != "secrets"])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "secrets array<struct<kind:string,start:bigint,end:bigint,secret_start:bigint>>"])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret_start", pa.int64())]))
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(place).to_pylist()
            found = [spans(t) for t in texts]
            columns = list(batch.columns)
            if redacted:
                columns[place] = pa.array([redact(t, s) if s else t for t, s in zip(texts, found)], pa.string())
            listed = [[{"kind": KINDS[k], "start": a, "end": b, "secret_start": c} for k, a, b, c in s] for s in found]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(listed, kind)], names=[*docs_names, "secrets"])

    docs_names = docs.columns
    return docs.mapInArrow(run, schema)


def digests(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans written out."""
    written_out = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    of = lambda kind: F.filter("secrets", lambda s: s["kind"] == kind)
    return scanned.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(written_out(F.filter("secrets", lambda s: s["kind"] != KINDS[3])), 256).alias("base_sha256"),
        written_out(F.col("secrets")).alias("spans"),
    )
