"""Secret scans: fixed patterns, and assignments lexed from source and configuration text."""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from haruspex.llm import common as C
from haruspex.llm import lexer

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

_HEX = np.zeros(256, bool)
_HEX[[*range(0x30, 0x3A), *range(0x61, 0x67)]] = True

#: What a target's name says about its value; the first that matches counts.
NAME_WEIGHTS = (
    (re.compile(r"pass(?:word|wd|phrase)|^pwd$|[_.\-]pwd$"), 0.6),
    (re.compile(r"private[_.\-]?key|secret[_.\-]?key|access[_.\-]?key|api[_.\-]?key|client[_.\-]?secret|signing[_.\-]?key|encryption[_.\-]?key"), 0.6),
    (re.compile(r"secret|credential|(?:auth|access|refresh|bearer|session)[_.\-]?token"), 0.55),
    (re.compile(r"token|authorization|connection[_.\-]?string"), 0.45),
)
_GATE = (b"pass", b"pwd", b"secret", b"token", b"key", b"credential", b"authorization", b"connection")
#: What stands where a secret will be put: told by a value's beginning, by a whole short value, or by a value of one character only.
PLACEHOLDER = re.compile(rb"(?i)(?:\$\{|\{\{|<|(?:your|my|the|some|enter|insert)[_\- ]|example|placeholder|dummy)")
PLACEHOLDERS = frozenset((b"changeme", b"change_me", b"change-me", b"none", b"null", b"nil", b"true", b"false", b"undefined", b"todo", b"test"))
THRESHOLD = 0.75


def name_weight(name: bytes) -> float:
    """How sensitive a target's name is, 0 to 0.6."""
    low = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name.decode("ascii", "replace")).lower()
    return next((w for p, w in NAME_WEIGHTS if p.search(low)), 0.0)


def literal_weight(value: lexer.Value) -> float:
    """How much a value looks like a secret, 0 to 0.4: its length and the entropy of its bytes."""
    size, counts, head, last = value.facts()
    if size < MIN_ASSIGN or PLACEHOLDER.match(head) or (size <= len(head) and head.lower() in PLACEHOLDERS) or (head[:1] == last == b"%"):
        return 0.0
    if counts.keys() <= {0x58, 0x78} or (len(counts) == 1 and counts.keys() <= {0x2A, 0x2E}):
        return 0.0
    entropy = -sum((p := c / size) and p * math.log2(p) for c in counts.values())
    spaces = 0.15 if 0x20 in counts else 0.0
    return max(0.0, min(0.2, size / 100) + min(0.25, entropy / 16) - spaces)


def lexed(text: bytes) -> list[tuple[int, int, float]]:
    """(start, end, score) of literals that reach a sensitively named target, directly or through constants.

    A value joined from literals is scored as a whole; each literal is a span, once,
    with the best score of the values that it is part of.
    """
    found: dict[tuple[int, int], float] = {}
    for base, own in lexer.pairs(text):
        scored = []
        for name, value in own:
            if (weight := name_weight(name)) and (lit := literal_weight(value)) and weight + lit >= THRESHOLD:
                scored.append((weight + lit, value))
        seen: set[int] = set()
        for score, value in sorted(scored, key=lambda x: -x[0]):
            for a, b, _ in value.literals(seen):
                found.setdefault((base + a, base + b), score)
    return [(a, b, s) for (a, b), s in found.items() if a < b]


def spans(text: bytes, hexes: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes: the base spans and the lexed literals."""
    low = text.lower()
    out: list[tuple[str, int, int]] = []
    if any(w in low for w in _ASSIGN_WORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if b"AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    out += [("hex", a, b) for a, b in hexes]
    if any(w in low for w in _GATE):
        out += [("literal", a, b) for a, b, _ in lexed(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _hex_runs(data: np.ndarray, off: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Runs of MIN_HEX or more hexadecimal digits, by document, counted from its start."""
    edge = np.zeros(len(data) + 2, np.int8)
    edge[1:-1] = _HEX[data]
    turn = np.diff(edge)
    a, b = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    long_ = b - a >= MIN_HEX
    out: dict[int, list[tuple[int, int]]] = {}
    for x, y in zip(a[long_].tolist(), b[long_].tolist()):
        d = int(np.searchsorted(off, x, "right")) - 1
        while x < y:  # a run may go on in the next documents
            z = min(y, int(off[d + 1]))
            if z - x >= MIN_HEX:
                out.setdefault(d, []).append((x - int(off[d]), z - int(off[d])))
            x, d = z, d + 1
    return out


def secret_scan(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with counts of the base kinds, ``base_sha256`` and ``spans``.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then
    by kind.  The kind ``literal`` is the lexer's (``lexer.pairs``): a literal assigned
    to a sensitively named target, or to a constant that such a target is assigned
    in its scope, scored by name, length and entropy.  It may lie inside a base span, which stays.

    * Null text counts as empty: no spans, the digest of nothing.
    * Repeated rows are scanned alike; input columns named like a new one give way.
    * Empty input: empty result.  Columns not named in ``keep`` aren't read.
    """

    def make(data: np.ndarray, off: np.ndarray) -> dict[str, object]:
        raw = data.tobytes()
        runs = _hex_runs(data, off)
        counts = np.zeros((3, len(off) - 1), np.int64)
        digest, joined = [], []
        for d, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
            found = spans(raw[a:b], runs.get(d, []))
            if found:
                points = np.cumsum((data[a:b] & 0xC0) != 0x80)
                at = lambda i: int(points[i - 1]) if i else 0
                found = [(k, at(x), at(y)) for k, x, y in found]
            for k, _, _ in found:
                if k != "literal":
                    counts[KINDS.index(k), d] += 1
            text_of = lambda kinds: ",".join(f"{k}:{x}:{y}" for k, x, y in found if k in kinds)
            digest.append(hashlib.sha256(text_of(KINDS[:3]).encode()).hexdigest())
            joined.append(text_of(KINDS))
        return {"n_assign": counts[0], "n_access": counts[1], "n_hex": counts[2], "base_sha256": pa.array(digest, pa.string()), "spans": pa.array(joined, pa.string())}

    fields = [T.StructField(c, T.LongType()) for c in ("n_assign", "n_access", "n_hex")] + [T.StructField(c, T.StringType()) for c in ("base_sha256", "spans")]
    return C.arrow_append(docs, make, fields, text, keep=keep)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(C.load(spark, sf_dir, "documents"), keep=["doc_id"])
