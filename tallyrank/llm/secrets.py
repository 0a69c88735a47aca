"""Secret scan by assignment-aware lexing.

One pass over each text finds three pattern kinds (assignments to sensitive names, access keys, long
hex runs) and, by the lexer, a fourth: string literals that reach a sensitive name. The lexer reads
``name op value`` pairs of source code, JSON, YAML, INI and shell files, keeps the constants it has
seen in the text, follows names and ``+`` concatenations to their literals, and scores each literal by
the words of the name that receives it and by its own form.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import uncovered

# The three base patterns and the least length of each.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # maximal runs, as [0-9a-f]+ with shorter matches dropped
KINDS = ("assign", "access", "hex", "literal")
LEAST = {"assign": 8, "access": 16, "hex": 32, "literal": 8}

# Words of a target name and their weight as a sign of a secret.
NAME_WEIGHTS = {
    "password": 1.0,
    "passwd": 1.0,
    "passphrase": 1.0,
    "pwd": 0.9,
    "secret": 1.0,
    "token": 0.8,
    "apikey": 1.0,
    "credential": 0.9,
    "credentials": 0.9,
    "auth": 0.6,
    "authorization": 0.7,
    "bearer": 0.7,
    "private": 0.5,
    "access": 0.3,
    "api": 0.4,
    "key": 0.4,
    "salt": 0.4,
    "signature": 0.5,
    "pin": 0.4,
}
# Words in a name or a literal that speak for a harmless value.
HARMLESS_NAMES = {"name": -0.4, "path": -0.5, "file": -0.5, "url": -0.3, "length": -0.8, "count": -0.8, "type": -0.6, "id": -0.1}
PLACEHOLDERS = ("example", "changeme", "placeholder", "your_", "your-", "xxxx", "****", "<", "${", "{{", "todo")
THRESHOLD = 0.75

_PAIR = re.compile(
    r"""(?<![\w$.\-])(?P<q>["']?)(?P<name>[A-Za-z_$][\w$.\-]*+)(?P=q)[ \t]*+(?:=>|:=|=(?!=)|:(?!:))[ \t]*+"""
    r"""(?P<value>(?:"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|[A-Za-z_$][\w$.\-]*+)"""
    r"""(?:[ \t]*+\+[ \t]*+(?:"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|[A-Za-z_$][\w$.\-]*+))*+|[A-Za-z0-9+/_.=\-]++)""",
    re.A,
)
_TERM = re.compile(r""""((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|([A-Za-z_$][\w$.\-]*+)|([^\s"'+]++)""", re.A)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def name_score(name: str) -> float:
    """Sum of the weights of the words in the last part of a dotted name, split at case and marks."""
    words = [w.lower() for w in _WORDS.findall(name.rpartition(".")[2])]
    if "".join(words).endswith("apikey"):
        words.append("apikey")
    return sum(NAME_WEIGHTS.get(w, 0.0) + HARMLESS_NAMES.get(w, 0.0) for w in dict.fromkeys(words))


def literal_score(literal: str) -> float:
    """Bits a character over three, at most 1; 0 for short, spaced or placeholder values."""
    low = literal.lower()
    if len(literal) < LEAST["literal"] or re.search(r"\s", literal) or any(p in low for p in PLACEHOLDERS):
        return 0.0
    n = len(literal)
    return min(1.0, -sum(c / n * math.log2(c / n) for c in Counter(literal).values()) / 3.0)


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each base kind, too short ones dropped."""
    found = [Span("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [Span("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [Span("hex", *m.span()) for m in HEX.finditer(text)]
    return ordered(found)


def ordered(spans: Iterable[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def lexed_spans(text: str, threshold: float = THRESHOLD) -> list[Span]:
    """Literals that reach a sensitive name, directly, through a constant or in a concatenation.

    A constant stands for the literals last assigned to its name further up in the text, all of them. An
    assignment holds its own literals and refers to those of its constants, so chains take linear room; each is
    walked again only for a name of more weight than before.
    """
    constants: dict[str, int] = {}
    nodes: list[tuple[list[tuple[int, int]], list[int]]] = []
    walked: dict[int, float] = {}
    found: dict[tuple[int, int], None] = {}
    for pair in _PAIR.finditer(text):
        at, parts, parents = pair.start("value"), [], []
        for term in _TERM.finditer(pair["value"]):
            if term.group(3) is not None:
                known = constants.get(term[3])
                if known is not None:
                    parents.append(known)
                elif term.end() - term.start() == len(pair["value"]):
                    parts.append((at + term.start(), at + term.end()))  # a bare value of a shell or YAML file
            else:
                k = next(i for i in (1, 2, 4) if term.group(i) is not None)
                parts.append((at + term.start(k), at + term.end(k)))
        constants[pair["name"]] = len(nodes)
        nodes.append((parts, list(dict.fromkeys(parents))))
        weight = name_score(pair["name"])
        rest = [len(nodes) - 1]
        while rest:
            node = rest.pop()
            if weight > walked.get(node, 0.0):
                walked[node] = weight
                found |= {p: None for p in nodes[node][0] if weight * literal_score(text[p[0] : p[1]]) >= threshold}
                rest += nodes[node][1]
    return ordered(Span("literal", *p) for p in found)


def scan(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: literals that no base span covers are added."""
    text = text or ""
    base = base_spans(text)
    if "=" not in text and ":" not in text:
        return base, base
    more = [Span("literal", *p) for p in uncovered([s[1:] for s in lexed_spans(text)], [s[1:] for s in base])]
    return base, ordered([*base, *more]) if more else base


def encode(spans: Iterable[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_literal long, base string, spans string"


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, every = [], []
        for text in batch.column("text"):
            b, e = scan(text.as_py())
            base.append(b)
            every.append(e)
        counts = [[sum(s.kind == k for s in spans) for spans in every] for k in KINDS]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.int64()),
                *(pa.array(c, pa.int64()) for c in counts),
                pa.array(map(encode, base), pa.string()),
                pa.array(map(encode, every), pa.string()),
            ],
            names=["doc_id", "n_assign", "n_access", "n_hex", "n_literal", "base", "spans"],
        )


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, ``base`` and ``spans`` as kind:start:end lists, one row per input row.

    Reads doc_id and text only, whatever other columns there are; whole texts, no shuffle. A null or
    empty text has no spans; repeated rows give repeated results; a null doc_id is kept; an empty
    table gives an empty table. Spans are sorted by start, then kind (assign, access, hex, literal).
    Positions are code points with the end exclusive. Time is linear in the text.
    """
    return docs.select("doc_id", "text").mapInArrow(scan_batches, SCHEMA)


def digest(encoded: str) -> str:
    """What the query's base_sha256 holds of an encoded list."""
    return hashlib.sha256(encoded.encode()).hexdigest()
