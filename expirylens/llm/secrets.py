"""Secret scans by assignment-aware lexing.

A text is read as source or configuration code: targets (names, quoted keys) with what is assigned to them. Literals assigned
to a name are remembered under it, so that a name used later stands for them (constant propagation, also through joined
parts). A literal that reaches a target is scored by how sensitive the target's name is and by how much the literal can hold.
Beside these pairs the lexer has three fixed literal rules: assignments to a list of names, access keys, and hexadecimal runs.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from expirylens.llm.common import arrow_rows

KINDS = ("assign", "access", "hex", "literal")
LEAST_SCORE = 0.5

# The three literal rules. A match is as long as it can be; too short ones are dropped after matching.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs of 32 or more: the same as all runs without the shorter ones
LEAST = {"assign": 8, "access": 16, "hex": 32}

# Words of names that hold secrets, words that make "key" one, and words of names that only speak about secrets.
SECRET_WORDS = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "passcode": 1.0, "secret": 1.0, "secrets": 1.0, "token": 1.0, "apikey": 1.0,
                "credential": 0.9, "credentials": 0.9, "bearer": 0.9, "jwt": 0.9, "pass": 0.8, "auth": 0.7, "authorization": 0.8, "salt": 0.6, "pin": 0.6}
KEY_WORDS = frozenset("api access private secret signing encryption account master session ssh aes hmac service".split())
ABOUT_WORDS = frozenset("""length len count size max min limit url uri path file filename dir folder name type policy field label header prefix
suffix regex pattern expires expiry ttl timeout id hint prompt help message""".split())
PLACEHOLDER = re.compile(r"""(?i)(?:[x*.#_?-]+|change_?me.*|your[_ -].*|my_?password|example.*|placeholder|dummy.*|none|null|nil|undefined|true|false|todo|
                         test|password|passwd|secret|token|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s|%\w+%|\$\w+)""", re.VERBOSE | re.DOTALL)

# A name or quoted key with a sign of assignment behind it. Possessive parts, and no start inside a name: linear in the text.
_TARGET = re.compile(r"""(?:(?<![\w"'])(?P<quote>["'])(?P<key>[^"'\n]*+)(?P=quote)|(?<![\w$.-])(?P<name>[^\W\d][\w$.-]*+|\$[\w$.-]++))
                     [ \t]*+\]?[ \t]*+(?P<sign>:=|=>|[=:])(?![=>])[ \t]*+""", re.VERBOSE)
_OPEN = re.compile(r"[rRbBfFuU]{0,2}(\"\"\"|'''|[\"'`])")
_BODY = {q: re.compile(rf"(?:[^{q}\\\n]|\\.)*+", re.DOTALL) for q in "\"'"} | {"`": re.compile(r"(?:[^`\\]|\\.)*+", re.DOTALL)}
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>#&|]++""")
_NAME = re.compile(r"[^\W\d][\w$.-]*|\$\{?[\w$.-]+\}?")
_JOINED = re.compile(r"[ \t]*+(?:\+|\.\.|\|\||&)[ \t\n\\]*+")
_BESIDE = re.compile(r"[ \t]++(?=[\"'])")
_CALL = re.compile(r"[ \t]*+[(\[]")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_]+")


def sensitivity(name: str) -> float:
    """How surely a name's value is secret, 0 to 1."""
    words = [w.lower() for w in _PARTS.findall(name)]
    best = max((SECRET_WORDS.get(w, 0.0) for w in words), default=0.0)
    if any(b in ("key", "keys") and a in KEY_WORDS or (a + b) in SECRET_WORDS for a, b in zip(words, words[1:])):
        best = max(best, 0.9)
    return best * (0.3 if words and words[-1] in ABOUT_WORDS else 1.0)


class Value:
    """What an expression stands for: literals of its own and the values it is joined from. Never unfolded, so chains stay linear."""

    __slots__ = ("chars", "length", "literals", "marked", "parts", "plain")

    def __init__(self, literals: list[tuple[int, int]], texts: list[str], parts: list[Value]):
        self.literals, self.parts, self.marked = literals, parts, False
        self.length = sum(map(len, texts)) + sum(p.length for p in parts)
        self.chars = frozenset().union(*texts, *[p.chars for p in parts])
        self.plain = bool(parts) or not (len(texts) == 1 and PLACEHOLDER.fullmatch(texts[0]))

    def strength(self) -> float:
        """0 for placeholders, prose and short values; 1 from 24 bits on, if all of its characters were drawn alike."""
        if not self.plain or self.length < 6 or any(c.isspace() for c in self.chars):
            return 0.0
        return min(1.0, self.length * math.log2(max(1, len(self.chars))) / 24)


def _string(text: str, at: int) -> tuple[int, int, int] | None:
    """Start, end and the place behind a string literal that begins at ``at``."""
    m = _OPEN.match(text, at)
    if m is None:
        return None
    quote, start = m.group(1), m.end()
    if len(quote) == 3:
        end = text.find(quote, start)
        return (start, end, end + 3) if end >= 0 else None
    end = _BODY[quote].match(text, start).end()
    return (start, end, end + 1) if text.startswith(quote, end) else None


def _expression(text: str, at: int, known: dict[str, Value]) -> tuple[Value | None, int]:
    """The value that begins at ``at``: strings, names and bare words, joined by signs or standing side by side."""
    literals, texts, parts, bare, terms, end = [], [], [], [], 0, at
    while True:
        string = _string(text, at)
        if string:
            literals.append(string[:2])
            texts.append(text[string[0]:string[1]])
            end = string[2]
        else:
            m = _BARE.match(text, at)
            if m is None:
                break
            word, end = m.group().rstrip(".:"), m.end()
            if not word:
                break
            if _NAME.fullmatch(word) and (v := known.get(word.strip("${}"))) is not None:
                parts.append(v)
            elif not _CALL.match(text, end):  # what a call gives isn't known
                bare.append((at, at + len(word)))
        terms += 1
        m = _JOINED.match(text, end) or (_BESIDE.match(text, end) if string else None)
        if m is None:
            break
        at = m.end()
    if terms == 1 and bare:  # in a joined value a bare word is a name that isn't known
        literals, texts = bare, [text[a:b] for a, b in bare]
    return (Value(literals, texts, parts) if literals or parts else None), end


def assigned_secrets(text: str) -> list[tuple[int, int, str, float]]:
    """Start, end, target name and score of every literal that reaches a sensitive target."""
    known: dict[str, Value] = {}
    found, at = [], 0
    while m := _TARGET.search(text, at):
        name = m.group("name") or m.group("key") or ""
        start = m.end()
        if m.group("sign") == ":" and (typed := _TARGET.match(text, start)) and typed.group("sign") == "=":
            start = typed.end()  # name: type = value
        value, end = _expression(text, start, known)
        at = max(end, m.end())
        if value is None:
            continue
        known[name.strip("$")] = value
        score = sensitivity(name) * value.strength()
        if score >= LEAST_SCORE:
            stack = [value]
            while stack:
                v = stack.pop()
                if not v.marked:
                    v.marked = True
                    found += [(a, b, name, score) for a, b in v.literals]
                    stack += v.parts
    return found


def lex(text: str) -> list[tuple[str, int, int, str, float]]:
    """All spans of a text by start, then kind: kind, start, end (code points), target name and score (the fixed rules: their word, 1)."""
    found = []
    if "=" in text or ":" in text:
        found = [("assign", m.start(), m.end(), m.group()[:m.start(1) - m.start()].rstrip("\"' :="), 1.0)
                 for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST["assign"]]
        found += [("literal", *x) for x in assigned_secrets(text)]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), "", 1.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [("hex", m.start(), m.end(), "", 1.0) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """One row for each document: its id and the array of its secrets (kind, start, end, name, score) by start, then kind.

    ``assign``, ``access`` and ``hex`` are the fixed rules; ``literal`` spans are literals that an assignment, or a chain of them, brings to a
    sensitive name. Whole texts are read, in time linear in their length. Null and empty texts hold nothing; repeated rows
    and null ids get their own rows; an empty table gives no rows; other columns are left out. No shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrow_rows(whole):
                spans = [[dict(zip(("kind", "start", "end", "name", "score"), s, strict=True)) for s in lex(t or "")] for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(SPAN))], [id_col, spans_col])

    kind = docs.schema[id_col].dataType.simpleString()
    span = "struct<kind: string, start: bigint, end: bigint, name: string, score: double>"
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, `{spans_col}` array<{span}>")
