"""Secret scan: patterns, and assignment-aware lexing of source and configuration syntax.

Three patterns give the base findings (:data:`PATTERNS`).  The lexer then reads every text that has an assignment mark
as name-literal pairs: ``name = "x"``, ``"name": "x"``, ``name: Type = x``, ``name := x``, ``name => x``, ``NAME=x``,
``obj.name``, ``obj["name"]``, ``--name x``, ``<name>x</name>``, ``key="name" value="x"`` and ``scheme://user:x@host``.
A value is a chain of literals, names and calls of literals joined by ``+``, ``.``, ``..`` or by standing side by side.
Constants propagate: a name stands for the value it was last given, inside a chain and inside ``${name}`` or ``{name}``
of a literal, so a literal counts for every name that its value reaches.  A literal's score is the weight of the most
sensitive such name times the strength of the value (length, distinct characters, kinds of characters; placeholders and
prose have none); from ``least`` on it is a finding of kind ``literal``.

Values form a graph whose nodes are assignments.  Sensitive names mark what they reach in the order of their weights,
each node once, so the work of a text grows with its length, however its constants refer to each other.

Results for odd input: a null or empty text has no findings; a null ``doc_id`` is scanned like any other; repeated rows
are scanned one by one; a text is scanned whole, and one without assignment marks costs only the patterns; offsets are
code points; findings that lie inside a base finding are not added again; an empty table gives an empty result; other
columns are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import by_batch

# The patterns of the base findings, in the order of their kinds, with the group that counts and its least length.
PATTERNS: list[tuple[str, re.Pattern[bytes], int, int]] = [
    ("assign", re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    ("access", re.compile(rb"AKIA[A-Z0-9]{14,}"), 0, 18),
    ("hex", re.compile(rb"[0-9a-f]{16,}"), 0, 16),
]
KINDS = ["assign", "access", "hex", "literal"]

#: How sensitive a target is whose name holds these words side by side.
WEIGHTS: dict[tuple[str, ...], float] = {
    ("password",): 1.0, ("passwd",): 1.0, ("passphrase",): 1.0, ("pwd",): 1.0, ("secret",): 1.0, ("token",): 1.0, ("apikey",): 1.0,
    ("api", "key"): 1.0, ("access", "key"): 1.0, ("private", "key"): 1.0, ("account", "key"): 1.0, ("encryption", "key"): 1.0, ("signing", "key"): 1.0,
    ("credential",): 0.9, ("credentials",): 0.9, ("auth", "key"): 0.9, ("bearer",): 0.8, ("pass",): 0.8, ("auth",): 0.7, ("authorization",): 0.7, ("key",): 0.55, ("salt",): 0.55,
}
#: A name that ends in one of these speaks about a secret and holds none.
ABOUT = frozenset("type name length len count size url uri path file field label hint prompt policy max min expiry expires ttl regex pattern header error message format placeholder limit algorithm version".split())
#: With one of these anywhere the literal is meant to be seen.
OPEN = frozenset(["public", "example", "sample", "dummy", "fake"])

_NAME = rb"[A-Za-z_$@][\w$]*"
#: A target with its assignment mark; ``[:=]`` followed by more of an operator is none.
SITE = re.compile(
    rb"(?:(?P<quoted>[\"'][\w .$@/-]{1,100}[\"'])|(?P<path>" + _NAME + rb"(?:(?:\.|->|::|-|\?\.)[A-Za-z_$][\w$]*|\[[\"']?[\w.$-]{1,100}[\"']?\])*))"
    rb"[ \t]*(?P<mark>:=|=>|\?=|\+=|=(?![=~>])|:(?![:=/]))"
)
FLAG = re.compile(rb"(?<![\w-])--(?P<path>[A-Za-z][\w-]{0,99})[ \t]+(?=[^\s-])")
TAG = re.compile(rb"<(?P<path>[A-Za-z_][\w.:-]*)(?:[ \t][^<>\n]*)?>[ \t]*(?P<value>[^<>\s]+)[ \t]*</(?P=path)>")
LOGIN = re.compile(rb"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{0,30}://[^\s/:@\"']*:(?P<value>[^\s/:@\"']+)@")
TYPED = re.compile(rb"[ \t]*[A-Za-z_][\w.<>\[\], |&?]{0,80}?[ \t]*=(?![=~>])")
GAP = re.compile(rb"[ \t]*")
STRING = re.compile(
    rb"(?:[bBrRuUfF]{0,2})(?:\"\"\"(?P<a>(?:[^\"\\]|\\.|\"(?!\"\"))*)\"\"\"|'''(?P<b>(?:[^'\\]|\\.|'(?!''))*)'''"
    rb"|\"(?P<c>(?:[^\"\\\n]|\\.)*)\"|'(?P<d>(?:[^'\\\n]|\\.)*)'|`(?P<e>[^`\n]*)`)", re.S,
)
CALL = re.compile(_NAME + rb"(?:(?:\.|::|->)" + _NAME + rb")*\([ \t\n]*")
#: Calls whose first argument names what is looked up.
LOOKUP = re.compile(rb"(?i:(?:get|env|environ|fetch|config|property|setting|lookup|param|arg)\w*)\([ \t\n]*$")
BARE = re.compile(rb"[^\s\"'`,;<>(){}\[\]|&=]+(?:={1,2}(?![^\s\"'`,;<>(){}\[\]|&]))?")
COMMA, CLOSED = re.compile(rb"[ \t]*,[ \t\n]*"), re.compile(rb"[ \t\n]*\)")
WHOLE_NAME = re.compile(_NAME + rb"(?:\." + _NAME + rb")*")
JOIN = re.compile(rb"[ \t]*(?:\\\n[ \t]*)?(?:(?:\+|\.\.|\.(?=[ \t]*[\"'$]))[ \t]*(?:\\?\n[ \t]*)?|(?:\\?\n[ \t]*)?(?=[\"']))")
INSIDE = re.compile(rb"\$?\{(" + _NAME + rb")\}")
WORDS = re.compile(rb"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
PLACEHOLDER = re.compile(rb"(?i)(?:x+|\*+|\.+|-+|0+|<.*>|\[.*\]|%.*%|\$.*|.*\{.*\}.*|(?:your|my|the|some|insert|enter|change|replace)[ _-]?.*|.*(?:example|placeholder|dummy|redacted|changeme|todo|fixme).*|none|null|true|false|undefined)$", re.S)


def name_weight(path: bytes) -> float:
    """How sensitive a target is: by the words of its last part, and of the part before it for one word alone."""
    words = [x.decode().lower() for x in WORDS.findall(path)]
    if not words or words[-1] in ABOUT or OPEN & set(words):
        return 0.0
    return max((w for parts, w in WEIGHTS.items() for k in range(len(words) - len(parts) + 1) if tuple(words[k : k + len(parts)]) == parts), default=0.0)


_DIGITS, _LOWER, _UPPER, _MARKS = (sum(1 << b for b in x) for x in (range(48, 58), range(97, 123), range(65, 91), b"!#$%&*+=?@^~"))


def strength(length: int, seen: int) -> float:
    """0 to 1 from a value's length and the set of its bytes, as bits: letters with digits, or three kinds, are strong."""
    letters = bool(seen & _LOWER) + bool(seen & _UPPER)
    if length < 8 or not letters or letters + bool(seen & _MARKS) + 2 * bool(seen & _DIGITS) < 3:
        return 0.0
    return min(1.0, length / 12) * min(1.0, seen.bit_count() / 8)


@dataclass
class Node:
    """A value: spans of its own literals, the values it refers to, and what :func:`strength` asks of the whole."""

    spans: list[tuple[int, int]] = field(default_factory=list)
    refs: list[Node] = field(default_factory=list)
    length: int = 0
    seen: int = 0
    score: float = -1.0

    def take(self, other: Node) -> None:
        self.refs.append(other)
        self.length = min(self.length + other.length, 1 << 30)
        self.seen |= other.seen


def _bits(data: bytes) -> int:
    out = 0
    for b in set(data):
        out |= 1 << b
    return out


class Lexer:
    """The name-literal pairs of one text."""

    def __init__(self, data: bytes):
        self.data = data
        self.known: dict[bytes, Node] = {}
        self.sinks: list[tuple[float, bytes, Node]] = []

    def literal(self, node: Node, start: int, end: int) -> None:
        text = self.data[start:end]
        for m in INSIDE.finditer(text):
            if m[1] in self.known:
                node.take(self.known[m[1]])
        if len(text) <= 200 and PLACEHOLDER.match(text) or len(text.split(None, 1)) > 1:
            return
        node.spans.append((start, end))
        node.length = min(node.length + end - start, 1 << 30)
        node.seen |= _bits(text)

    def value(self, at: int) -> tuple[Node, int]:
        """The chain of terms that begins at ``at``, and where it ends."""
        node, data, first = Node(), self.data, True
        while True:
            at = GAP.match(data, at).end()
            if m := STRING.match(data, at):
                self.literal(node, *m.span(m.lastgroup))
                at = m.end()
            elif m := CALL.match(data, at):
                at = self.arguments(node, m.end(), bool(LOOKUP.search(m[0])))
            elif m := BARE.match(data, at):
                whole = WHOLE_NAME.match(data, at)
                if whole and (held := self.known.get(whole[0].rpartition(b".")[2])) is not None and (whole.end() == m.end() or data[whole.end() : whole.end() + 1] in b"+."):
                    node.take(held)
                    at = whole.end()
                elif first:  # configuration without quotes
                    self.literal(node, *m.span())
                    return node, m.end()
                else:
                    return node, at
            else:
                return node, at
            m = JOIN.match(data, at)
            if not m:
                return node, at
            first, at = False, m.end()

    def arguments(self, node: Node, at: int, lookup: bool) -> int:
        """Literals and names among a call's arguments; of a lookup the first only says what is asked for."""
        while m := STRING.match(self.data, at) or WHOLE_NAME.match(self.data, at):
            if lookup:
                lookup = False
            elif m.re is STRING:
                self.literal(node, *m.span(m.lastgroup))
            elif m[0] in self.known:
                node.take(self.known[m[0]])
            at = m.end()
            comma = COMMA.match(self.data, at)
            if not comma:
                break
            at = comma.end()
        closed = CLOSED.match(self.data, at)
        return closed.end() if closed else at

    def sites(self) -> Iterator[tuple[bytes, Node]]:
        data, at, keyed = self.data, 0, (b"", -1)
        while m := SITE.search(data, at):
            path, begin = (m["quoted"][1:-1] if m["quoted"] else m["path"]), m.end()
            if m["mark"] == b":" and (typed := TYPED.match(data, begin)):
                begin = typed.end()
            node, end = self.value(begin)
            last = path.lower()
            line = data.count(b"\n", at, m.start())
            if last in (b"key", b"name") and m["mark"] == b"=":
                string = STRING.match(data, begin)
                keyed = (string[string.lastgroup], m.end()) if string else keyed
            elif last == b"value" and keyed[0] and m.start() - keyed[1] < 400 and b"\n" not in data[keyed[1] : m.start()]:
                path, keyed = keyed[0], (b"", -1)
            elif line:
                keyed = (b"", -1)
            if m["mark"] == b"+=" and (before := self.known.get(self.short(path))) is not None:
                node.take(before)
            yield path, node
            # what stands inside a literal may be assignments too, as in connection strings
            at = begin if end <= begin or b"=" in data[begin:end] else end
        for m in FLAG.finditer(data):
            yield m["path"], self.value(m.end())[0]
        for pattern, name in ((TAG, None), (LOGIN, b"password")):
            for m in pattern.finditer(data):
                node = Node()
                self.literal(node, *m.span("value"))
                yield name or m["path"], node

    def short(self, path: bytes) -> bytes:
        return re.split(rb"\.|->|::|\[", path.rstrip(b"\"']"))[-1].strip(b"\"' ")

    def findings(self, least: float) -> list[tuple[int, int, bytes, float]]:
        """``start, end, target, score`` of every literal that reaches a sensitive name."""
        for path, node in self.sites():
            self.known[self.short(path)] = node
            weight = max(name_weight(self.short(path)), 0.99 * name_weight(path))
            score = weight * strength(node.length, node.seen)
            if score >= least:
                self.sinks.append((score, path, node))
        out = []
        for score, path, node in sorted(self.sinks, key=lambda x: -x[0]):
            open_ = [node]
            while open_:
                now = open_.pop()
                if now.score < 0:
                    now.score = score
                    out += [(a, b, path, score) for a, b in now.spans]
                    open_ += now.refs
        return out


MARKS = (b"=", b":", b"--", b"</")


def find(data: bytes, least: float) -> list[tuple[str, int, int, str | None, float]]:
    """``kind, start, end, name, score`` of all findings of a text in UTF-8, by start and then kind; offsets are bytes."""
    found: list[tuple[str, int, int, str | None, float]] = []
    marked = any(x in data for x in MARKS)
    for kind, pattern, group, chars in PATTERNS:
        if kind != "assign" or marked:
            found += [(kind, *m.span(), None, 1.0) for m in pattern.finditer(data) if m.end(group) - m.start(group) >= chars]
    if marked:
        inside = sorted((a, b) for _, a, b, _, _ in found)
        added, reach, k = set(), -1, 0
        for a, b, name, score in sorted(Lexer(data).findings(least)):
            while k < len(inside) and inside[k][0] <= a:
                reach, k = max(reach, inside[k][1]), k + 1
            if b > reach and (a, b) not in added and b - a >= 4:
                added.add((a, b))
                found.append(("literal", a, b, name.decode("utf-8", "replace"), score))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


SPAN_TYPE = "struct<kind: string, start: bigint, end: bigint, name: string, score: double>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())])


def mask(data: bytes, spans: list[tuple]) -> bytes:
    """The text with every finding replaced by its kind in brackets; findings that overlap are one, of the first kind."""
    out, at, k = [], 0, 0
    while k < len(spans):
        kind, start, end = spans[k][:3]
        while k < len(spans) and spans[k][1] < end or k < len(spans) and spans[k][1] == start:
            end, k = max(end, spans[k][2]), k + 1
        out += [data[at:start], f"[{kind}]".encode()]
        at = end
    return b"".join([*out, data[at:]])


def scan(docs: DataFrame, least: float = 0.5, masked: bool = False) -> DataFrame:
    """``doc_id, spans`` of every row of ``docs (doc_id, text)``, and with ``masked`` the text without its secrets.

    ``spans`` are by start and then kind, in code points, the end exclusive; ``name`` is the target of a literal.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans, texts = [], []
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            found = find(text or b"", least)
            if masked:
                texts.append(mask(text or b"", found))
            if found:
                points = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
                found = [(kind, int(points[a]), int(points[b]), name, score) for kind, a, b, name, score in found]
            spans.append([dict(zip(("kind", "start", "end", "name", "score"), x, strict=True)) for x in found])
        columns = [batch.column("doc_id"), pa.array(spans, pa.list_(_SPAN))]
        names = ["doc_id", "spans"]
        if masked:
            columns.append(pa.array(texts, pa.binary()).cast(pa.string()))
            names.append("masked")
        return pa.RecordBatch.from_arrays(columns, names)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return by_batch(plain, work, f"doc_id long, spans array<{SPAN_TYPE}>" + ", masked string" * masked)


def listed(spans: Column, base: bool) -> Column:
    """``kind:start:end`` of all spans or of the base ones, joined by commas, as a column."""
    chosen = F.filter(spans, lambda x: x["kind"] != "literal") if base else spans
    return F.array_join(F.transform(chosen, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    """How many spans are of a kind."""
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
