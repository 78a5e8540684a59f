"""Secret scans by assignment-aware lexing.

Three patterns give the *base* spans: assignments to a sensitive name, access key ids, and runs of
hexadecimal digits. The method then reads the text as source or configuration: around every ``=``
and ``:`` it lexes a name on the left and a value on the right; in ``name: type = value`` the name
before the type gets the value. A value is a sum of literals and names. Literals are strings in
single, double, triple or back quotes, whose backslashes escape, bare words, and the indented lines
after ``name: |``; strings that stand next to each other, also inside brackets and over several lines,
are one value. A comment between them counts as a blank; a secret in a comment is still a secret.

*Constants.* Each assignment is a node with its literals and references to the nodes that its names
stood for at that point. How sensitive a literal is, is the most sensitive name that it reaches: a
single pass over the nodes from last to first hands each node's sensitivity on to what it refers to.
Time and memory grow with the text, whatever is assigned to what.

Each literal that reaches a name is scored by how sensitive the name is and how random the literal
looks, and literals that score high enough become spans of kind ``literal``. Base spans always stay.

Offsets are code points, ends exclusive. A null text counts as empty. Rows are independent; repeated
rows get equal answers and an empty table gives an empty one. Whole texts are read, of any length.
Columns of docs are passed on; columns of the result's names are replaced.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table

# Kinds in the order that ties follow, their patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run that is too short has no part that is long enough
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex", "literal")

#: How sensitive a part of a name is.
WEIGHTS = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.8, "credentials": 0.8, "private": 0.6, "auth": 0.5, "bearer": 0.8, "signature": 0.4, "salt": 0.4, "key": 0.6, "access": 0.3, "api": 0.3, "cert": 0.3, "dsn": 0.5, "connection": 0.3}
STRING = r"""[rbufRBUF]{0,2}+(?:\"\"\"((?:[^"\\]|\\.|"(?!""))*+)\"\"\"|'''((?:[^'\\]|\\.|'(?!''))*+)'''|"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`((?:[^`\\]|\\.)*+)`)"""
#: A string, a name, another bare word, and what joins one value to the next.
TEXT = re.compile(STRING, re.DOTALL)
NAME = re.compile(r"[A-Za-z_][\w.]*+")
BARE = re.compile(r"""[^\s"'`,;(){}\[\]+]++""")
CALL, QUOTED = re.compile(r"\x20*+[(\[]"), re.compile(r"""[rbufRBUF]{0,2}["'`]""")
JOIN = re.compile(r"\+|\.(?=\s)|\|\|")
BLANKS, SPACES = re.compile(r"[\x20\t]*+(?:\\\r?\n[\x20\t]*+)?+"), re.compile(r"\s*+")
#: A block scalar's head and its lines.
BLOCK_HEAD, LINE = re.compile(r"[\x20\t]*+[|>][+-]?\d?[\x20\t]*+\r?\n"), re.compile(r"([\x20\t]*+)([^\n]*+)(?:\n|$)")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
THRESHOLD = 1.2
OPERATOR = re.compile("[=:]")
BLANK = " \t"
#: Pieces of a type: a path, a word, a lifetime, a sign before or between types, brackets, other pieces inside them.
TYPE = re.compile(r"""[\x20\t]*+(?:(::)|([A-Za-z_][\w.]*+)|('\w++(?!'))|([&*?!|]++)|([<\[(])|([>\])])|(=(?![=>]))|([,;\d]++|"[^"\n]*+"|'[^'\n]*+'))""")
MODIFIERS = {"const", "mut", "static", "readonly", "dyn", "final", "volatile", "unsigned"}


class Span(NamedTuple):
    start: int
    order: int
    end: int


def base_spans(text: str) -> list[Span]:
    found = [Span(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST] if ":" in text or "=" in text else []
    if "AKIA" in text:
        found += [Span(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [Span(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def sensitivity(name: str) -> float:
    """The strongest part of the name, a little more for a second one."""
    low = [x.lower() for x in PARTS.findall(name)]
    joined = [a + b for a, b in zip(low, low[1:], strict=False)]
    scores = sorted((WEIGHTS[x] for x in [*low, *joined] if x in WEIGHTS), reverse=True)
    return scores[0] + 0.5 * sum(scores[1:2]) if scores else 0.0


def randomness(value: str) -> float:
    """0 to 1: entropy of characters against the most that this length could have."""
    if len(value) < 6 or " " in value:
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    mixed = sum(any(f(x) for x in value) for f in (str.isdigit, str.islower, str.isupper)) / 3
    return min(1.0, entropy / math.log2(min(n, 64))) * (0.5 + 0.5 * mixed)


class Literal(NamedTuple):
    start: int
    end: int


class Node(NamedTuple):
    """An assignment: how sensitive its name is, its own literals, and earlier nodes that its names stood for."""

    sensitivity: float
    literals: list[Literal]
    refers: list[int]


def name_before(text: str, op: int) -> str | None:
    """The name that ends before an operator, however long it is and however far away on its line."""
    end = op
    if end and text[end - 1] == "\n":
        end -= 1
    if end and text[end - 1] == ":":
        end -= 1
    while end and text[end - 1] in BLANK:
        end -= 1
    if end and text[end - 1] == "]":
        end -= 1
    if end and text[end - 1] in "\"'":
        end -= 1
    start = end
    while start and (text[start - 1].isalnum() or text[start - 1] in "_.-"):
        start -= 1
    while start < end and not (text[start] == "_" or (text[start].isascii() and text[start].isalpha())):
        start += 1
    return text[start:end] or None


def after_type(text: str, at: int) -> int:
    """Where the value of `name: type = value` begins, given the end of the colon; -1 if there is none."""
    depth, word, apart = 0, False, True
    while m := TYPE.match(text, at):
        at = m.end()
        if m[1] or m[4]:
            apart = True
        elif m[2]:
            if not depth and not apart:
                return -1  # prose: two words
            word, apart = True, m[2] in MODIFIERS
        elif m[5]:
            depth += 1
        elif m[6]:
            depth -= 1
            if depth < 0:
                return -1
        elif m[7]:
            return at if word and not depth else -1
        elif m[8] and not depth:
            return -1
    return -1


def one_literal(text: str, at: int) -> tuple[Literal, int] | None:
    """The string that begins at a place, without its quotes, and where it ends."""
    if m := TEXT.match(text, at):
        return Literal(*m.span(m.lastindex)), m.end()
    return None


def block_lines(text: str, at: int, indent: int) -> list[Literal]:
    """The lines of a block scalar: those further in than its name."""
    found = []
    while at < len(text) and (m := LINE.match(text, at)):
        if m[2].strip() and len(m[1]) <= indent:
            break
        if m[2].strip():
            found.append(Literal(m.start(2), m.start(2) + len(m[2].rstrip())))
        at = m.end()
    return found


class Gaps:
    """Steps over blanks and at most one comment. The end of a comment is looked for once for all places before it."""

    def __init__(self, text: str) -> None:
        self.text, self.since, self.close = text, 0, -2

    def closing(self, at: int) -> int:
        if self.close == -2 or (self.close >= 0 and not self.since <= at <= self.close):
            self.since, self.close = at, self.text.find("*/", at)
        return self.close

    def over(self, at: int, blank: re.Pattern) -> int:
        at = blank.match(self.text, at).end()
        if self.text.startswith("/*", at) and (close := self.closing(at + 2)) >= 0:
            at = blank.match(self.text, close + 2).end()
        return at


def value_at(text: str, at: int, nodes: dict[str, int], gaps: Gaps) -> tuple[list[Literal], list[int]]:
    """The literals of the value that begins at a place, and the nodes of its names."""
    literals, refers, wide, inner = [], [], False, at
    for _ in range(8):  # brackets around
        inner = gaps.over(inner, SPACES)
        if text[inner : inner + 1] != "(":
            break
        inner += 1
        if QUOTED.match(text, gaps.over(inner, SPACES)):
            at, wide = inner, True
            break
    while True:
        at = gaps.over(at, SPACES if wide else BLANKS)
        if found := one_literal(text, at):
            literals.append(found[0])
            at = found[1]
            after = gaps.over(at, SPACES if wide else BLANKS)
            if QUOTED.match(text, after):
                at = after
                continue
        elif m := NAME.match(text, at):
            if CALL.match(text, m.end()):
                break  # what a function returns
            if m[0] in nodes:
                refers.append(nodes[m[0]])
            else:
                m = BARE.match(text, at)
                literals.append(Literal(*m.span()))
            at = m.end()
        elif m := BARE.match(text, at):
            literals.append(Literal(*m.span()))
            at = m.end()
        else:
            break
        if not (m := JOIN.match(text, gaps.over(at, SPACES if wide else BLANKS))):
            break
        at = gaps.over(m.end(), SPACES)
    return literals, refers


def assignments(text: str) -> list[Node]:
    """All assignments, in order; names on the right stand for their constants."""
    nodes: list[Node] = []
    latest: dict[str, int] = {}
    at, end, gaps = 0, len(text), Gaps(text)
    while m := OPERATOR.search(text, at):
        op = m.start()
        at = op + 1
        while at < end and text[at] in "=:>":
            at += 1
        if at - op > 2 or not (left := name_before(text, op)):
            continue
        pos, plain = at, text[op:at] == ":"
        if plain and (typed := after_type(text, at)) >= 0:
            first = gaps.over(typed, BLANKS)
            if TEXT.match(text, first) or ((m := NAME.match(text, first)) and m[0] in latest):
                pos = typed
        if plain and (m := BLOCK_HEAD.match(text, at)):
            line = text.rfind("\n", 0, op) + 1
            literals, refers = block_lines(text, m.end(), len(text[line:op]) - len(text[line:op].lstrip())), []
        else:
            literals, refers = value_at(text, pos, latest, gaps)
        if literals or refers:
            latest[left] = len(nodes)
            nodes.append(Node(sensitivity(left), literals, refers))
    return nodes


def literal_spans(text: str) -> list[Span]:
    if "=" not in text and ":" not in text:
        return []
    nodes = assignments(text)
    most = [x.sensitivity for x in nodes]
    for i in range(len(nodes) - 1, -1, -1):  # names refer to earlier nodes only
        if most[i]:
            for j in nodes[i].refers:
                most[j] = max(most[j], most[i])
    found = set()
    for s, node in zip(most, nodes, strict=True):
        if s:
            for x in node.literals:
                r = randomness(text[x.start : x.end])
                if r > 0.55 and s + r >= THRESHOLD:
                    found.add(Span(x.start, 3, x.end))
    return sorted(found)


def written_out(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.order]}:{s.start}:{s.end}" for s in spans)


def scan_text(text: str | None) -> tuple[int, int, int, str, str]:
    base = base_spans(text or "")
    every = sorted({*base, *literal_spans(text or "")})
    n = Counter(s.order for s in base)
    return n[0], n[1], n[2], hashlib.sha256(written_out(base).encode()).hexdigest(), written_out(every)


NEW = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")


def scan(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    rest = docs.drop(*(c for c in NEW if c != text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        for batch in batches:
            got = [scan_text(x.as_py()) for x in batch.column(text_col)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([g[i] for g in got], k) for i, k in enumerate(kinds))], [*batch.schema.names, *NEW])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema), "n_assign long", "n_access long", "n_hex long", "base_sha256 string", "spans string"])
    return rest.mapInArrow(run, schema)


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def secret_scan_base(spark, sf_dir: str) -> DataFrame:
    """The base answers of op3_secret_scan, which SQL can express."""
    return op3_secret_scan(spark, sf_dir).drop("spans")


#: Places are summed lengths of what stands between matches and of the matches.
BASE_SQL = r"""
WITH kinds(o, kind, re, least, part) AS (VALUES
  (0, 'assign', '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 12, 2),
  (1, 'access', 'AKIA[A-Z0-9]+', 18, 0), (2, 'hex', '[0-9a-f]+', 16, 0)),
m AS (SELECT doc_id, o, kind, least, string_split_regex(t, re) AS gaps, regexp_extract_all(t, re, 0) AS hits, CASE WHEN part = 2 THEN regexp_extract_all(t, re, 2) ELSE regexp_extract_all(t, re, 0) END AS parts FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents), kinds),
x AS (SELECT doc_id, o, kind, least, unnest(range(1, len(hits) + 1)) AS i, gaps, hits, parts FROM m),
s AS (SELECT doc_id, o, kind, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS a, length(hits[i]) AS n FROM x WHERE length(parts[i]) >= least)
SELECT d.doc_id, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
 sha256(coalesce(string_agg(kind || ':' || a::BIGINT || ':' || (a + n)::BIGINT, ',' ORDER BY a, o), '')) AS base_sha256
FROM documents d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id
"""
