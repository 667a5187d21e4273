"""Assignments of source and configuration text as pairs of a target's name and its literals.

One scanner serves code, JSON, YAML, INI, environment files and XML: they share
names, quoted strings with escapes, comments and brackets.  What differs is told
where it stands: a bare value at a line's end is configuration, ``name: |``
starts a YAML block, ``<name>`` an element.

Constants are followed by scope: a brace block, and a function or class that is
told by indentation, see outer names and keep their own.  A value that uses a
constant refers to it, so values form a graph and are never copied.  Comments are
read as texts of their own, with scopes of their own; comments in them are plain text.

Every step is linear in the text, up to logarithms, whatever the text holds.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

#: A literal's place in the text, and what it stands for.
Piece = tuple[int, int, bytes]

_NEXT = re.compile(rb"""[A-Za-z_$][\w$]*|\d[\w.]*|["'`\n]|//|/\*|<!--|\#|:=|=>|->|[=!<>]=|<[/?!]?(?=[A-Za-z])|/>|[=:+.,;()\[\]{}<>&|*\\-]""")
_ESCAPE = re.compile(rb"\\(?:u\{?([0-9A-Fa-f]{4,6})\}?|x([0-9A-Fa-f]{2})|(.))", re.S)
_PLAIN = {b"n": b"\n", b"t": b"\t", b"r": b"\r", b"0": b"\0"}
_BARE = re.compile(rb"""[^\s"'`,;(){}\[\]<>]+""")
_LINE_START = re.compile(rb"[\x20\t]*(?:-[\x20\t]+)?(?:export[\x20\t]+|set[\x20\t]+)?", re.I)
_WHOLE_LINE_START = re.compile(_LINE_START.pattern + rb"$", re.I)
_INDENT = re.compile(rb"\x20*")
_BLOCK = re.compile(rb"[\x20\t]*[|>][+-]?\d?[\x20\t]*\r?\n")
_BODY = re.compile(rb"(?:async[\x20\t]+)?(?:def|class)[\x20\t]+([A-Za-z_]\w*)")
_ATTRIBUTE_NAMES = (b"name", b"key", b"id")
#: A word that stands for no constant.
_WORDS = frozenset(b"true false null none nil undefined this self new await return in not and or is if else str string int bytes".split())


@dataclass
class _Token:
    kind: str  # name, str, num, op, nl
    start: int
    end: int
    value: bytes


@dataclass
class _Scope:
    depth: int
    indent: int  # of the line that opened it, -1 for braces
    owner: bytes = b""
    names: set[bytes] = field(default_factory=set)


class Value:
    """What a target is given: literals, and values of constants, in order."""

    #: Bytes of a value's beginning that are kept.
    HEAD = 24
    __slots__ = ("parts", "known")

    def __init__(self, parts: list[Piece | Value]):
        self.parts, self.known = parts, None

    def _order(self) -> list[Value]:
        """This value and those that it needs, parts first, without those whose facts are known."""
        out, todo, seen = [], [(self, False)], set()
        while todo:
            v, done = todo.pop()
            if done:
                out.append(v)
            elif v.known is None and id(v) not in seen:
                seen.add(id(v))
                todo.append((v, True))
                todo += [(p, False) for p in v.parts if isinstance(p, Value)]
        return out

    def facts(self) -> tuple[int, Counter, bytes, bytes]:
        """Length, how often each byte occurs, the first HEAD bytes and the last one, of the joined value."""
        for v in self._order():
            size, counts, head, last = 0, Counter(), b"", b""
            for p in v.parts:
                n, c, h, z = p.known if isinstance(p, Value) else (len(p[2]), Counter(p[2]), p[2][: self.HEAD], p[2][-1:])
                size += n
                counts.update(c)
                head = (head + h)[: self.HEAD]
                last = z or last
            if (over := size.bit_length() - 62) > 0:  # constants that double again and again: only shares matter
                counts = Counter({b: max(1, n >> over) for b, n in counts.items()})
                size = counts.total()
            v.known = size, counts, head, last
        return self.known

    def literals(self, seen: set[int]) -> Iterator[Piece]:
        """The literals that the value is joined from, each once; values in ``seen`` are passed over and new ones added."""
        todo: list[Piece | Value] = [self]
        while todo:
            p = todo.pop()
            if not isinstance(p, Value):
                yield p
            elif id(p) not in seen:
                seen.add(id(p))
                todo += reversed(p.parts)


Pair = tuple[bytes, Value]


def unescaped(raw: bytes) -> bytes:
    def one(m: re.Match) -> bytes:
        if m[1] or m[2]:
            code = int(m[1] or m[2], 16)
            return chr(code).encode("utf-8", "replace") if code <= 0x10FFFF else m[0]
        return _PLAIN.get(m[3], m[3])

    return _ESCAPE.sub(one, raw) if b"\\" in raw else raw


def _escaped(text: bytes, at: int, first: int) -> bool:
    """Whether an odd number of backslashes stands before ``at``, counted back to ``first``."""
    k = at
    while k > first and text[k - 1] == 0x5C:
        k -= 1
    return (at - k) % 2 == 1


def _string_end(text: bytes, at: int, mark: bytes, one_line: bool) -> int:
    """Where the string's closing mark starts, or -1; a line may end in it only behind a backslash."""
    i = at
    while (j := text.find(mark, i)) >= 0:
        b = text.find(b"\n", i, j) if one_line else -1
        while b >= 0:
            if not _escaped(text, b, at):
                return -1
            b = text.find(b"\n", b + 1, j)
        if not _escaped(text, j, at):
            return j
        i = j + 1
    return -1


def scan(text: bytes, *, comment: bool = False) -> tuple[list[_Token], list[tuple[int, int]]]:
    """Tokens outside comments, and the spans of the comments' texts; a text that is a ``comment`` has none in it."""
    out: list[_Token] = []
    comments: list[tuple[int, int]] = []
    unclosed: set[bytes] = set()  # marks that have no end in the rest of the text
    i, n = 0, len(text)
    while m := _NEXT.search(text, i):
        a, i, t = m.start(), m.end(), m[0]
        before = text[a - 1 : a]
        if t == b"\n":
            out.append(_Token("nl", a, i, t))
        elif t in (b'"', b"'", b"`"):
            if t == b"'" and before.isalnum() and text[i : i + 1].isalpha():
                continue  # an apostrophe
            mark = t * 3 if t != b"`" and text.startswith(t * 3, a) else t
            long_ = len(mark) == 3 or t == b"`"
            if long_ and mark in unclosed:
                continue
            j = _string_end(text, a + len(mark), mark, not long_)
            if j < 0:
                if long_:
                    unclosed.add(mark)
                continue
            out.append(_Token("str", a + len(mark), j, unescaped(text[a + len(mark) : j])))
            i = j + len(mark)
        elif comment and t in (b"/*", b"<!--", b"//", b"#"):
            continue
        elif t in (b"/*", b"<!--"):
            end = b"*/" if t == b"/*" else b"-->"
            j = -1 if end in unclosed else text.find(end, i)
            if j < 0:
                unclosed.add(end)
                continue
            comments.append((i, j))
            i = j + len(end)
        elif (t == b"//" and before != b":") or (t == b"#" and (not before or before.isspace())) or (t == b";" and not comment and (not before or before == b"\n")):
            j = text.find(b"\n", i)
            j = n if j < 0 else j
            comments.append((i, j))
            i = j
        elif t in (b"//", b"#"):
            continue
        elif t[0] == 0x24 or t[0] == 0x5F or t[:1].isalpha():
            if before.isdigit() or before > b"\x7f":
                continue
            out.append(_Token("name", a, i, t))
        elif t[:1].isdigit():
            out.append(_Token("num", a, i, t))
        else:
            out.append(_Token("op", a, i, t))
    return out, comments


class _Reader:
    def __init__(self, text: bytes, found: list[Pair], comment: bool):
        self.text, self.found = text, found
        self.tokens, self.comments = scan(text, comment=comment)
        self.scopes = [_Scope(0, -1)]
        self.owners = [0]  # the places of scopes that self and this stand for; the outermost else
        self.names: dict[bytes, tuple[list[int], list[Value]]] = {}  # by name: places of scopes that keep it, ascending, and values
        self.depth = 0
        self.run = (0, 0, -1)  # the last run that was tried as a bare value: start, end, its last digit
        self.begins = (-1, 0)  # a line's start, and where its first target may begin

    # -- constants

    def look_up(self, name: bytes) -> Value | None:
        held = self.names.get(name)
        return held[1][-1] if held and held[1] else None

    def put(self, name: bytes, value: Value, place: int) -> None:
        at, values = self.names.setdefault(name, ([], []))
        k = bisect_left(at, place)
        if k < len(at) and at[k] == place:
            values[k] = value
        else:
            at.insert(k, place)
            values.insert(k, value)
            self.scopes[place].names.add(name)

    def keep(self, name: bytes, value: Value) -> None:
        top = len(self.scopes) - 1
        if name.startswith((b"self.", b"this.")):  # seen by the whole class
            self.put(name, value, self.owners[-1])
            return
        self.put(name, value, top)
        if (owner := self.scopes[-1].owner) and top:
            self.put(owner + b"." + name, value, top - 1)

    def forget(self, name: bytes) -> None:
        place = self.owners[-1] if name.startswith((b"self.", b"this.")) else len(self.scopes) - 1
        self.drop(name, place)

    def drop(self, name: bytes, place: int) -> None:
        at, values = self.names.get(name, ([], []))
        k = bisect_left(at, place)
        if k < len(at) and at[k] == place:
            del at[k], values[k]
            self.scopes[place].names.discard(name)

    def enter(self, scope: _Scope) -> None:
        self.scopes.append(scope)
        if scope.owner:
            self.owners.append(len(self.scopes) - 1)

    def leave(self) -> None:
        place = len(self.scopes) - 1
        for name in list(self.scopes[place].names):
            self.drop(name, place)
        self.scopes.pop()
        if self.owners[-1] == place:
            self.owners.pop()

    def line(self, start: int) -> None:
        """Leaves the functions and classes whose indentation the line at ``start`` hasn't, and enters its own."""
        stop = start
        while self.text[stop : stop + 1] in (b" ", b"\t"):
            stop += 1
        if self.text[stop : stop + 1] in (b"", b"\n", b"\r", b"#"):
            return
        indent = stop - start
        while len(self.scopes) > 1 and self.scopes[-1].indent >= indent and self.scopes[-1].depth == self.depth:
            self.leave()
        if m := _BODY.match(self.text, stop):
            self.enter(_Scope(self.depth, indent, m[1] if m[0].startswith(b"class") else b""))

    # -- grammar

    def is_op(self, i: int, *ops: bytes) -> bool:
        return i < len(self.tokens) and self.tokens[i].kind == "op" and self.tokens[i].value in ops

    def joined(self, i: int, j: int) -> bool:
        """Whether nothing but blanks lies between tokens i and j."""
        return not self.text[self.tokens[i].end : self.tokens[j].start].strip(b" \t\"'`")

    def chain(self, i: int) -> tuple[bytes, int]:
        """A dotted or hyphenated name from token i on, and the token after it; an index of a string counts as a part."""
        t = self.tokens
        name, j = [t[i].value], i + 1
        while j < len(t):
            touching = j + 1 < len(t) and t[j].start == t[j - 1].end and t[j + 1].start == t[j].end
            if touching and self.is_op(j, b".", b"-", b"->") and t[j + 1].kind in ("name", "num"):
                name += [t[j].value, t[j + 1].value]
                j += 2
            elif self.is_op(j, b"[") and j + 2 < len(t) and t[j + 1].kind == "str" and self.is_op(j + 2, b"]"):
                name += [b".", t[j + 1].value]
                j += 3
            else:
                break
        return b"".join(name), j

    def expression(self, i: int) -> tuple[list[Piece | Value] | None, int]:
        """The literals that a value is joined from, or None if it is something else, and the token after it."""
        t, pieces, opened, want = self.tokens, [], 0, True
        while i < len(t):
            k = t[i]
            if k.kind == "str":
                pieces.append((k.start, k.end, k.value))
                want = False
                i += 1
            elif k.kind == "name" and want:
                if i + 1 < len(t) and t[i + 1].kind == "str" and t[i + 1].start - 1 <= k.end and len(k.value) <= 2:
                    i += 1  # a string's prefix
                    continue
                name, j = self.chain(i)
                if self.is_op(j, b"(") and t[j].start == t[j - 1].end:
                    return None, j
                known = self.look_up(name)
                if known is None:
                    return None, j
                pieces.append(known)
                want = False
                i = j
            elif self.is_op(i, b"+", b".", b"&") and not want:
                want = True
                i += 1
            elif self.is_op(i, b"(") and want:
                opened += 1
                i += 1
            elif self.is_op(i, b")") and opened:
                opened -= 1
                want = False
                i += 1
            elif k.kind == "nl" and (opened or want and pieces):
                i += 1
            elif self.is_op(i, b"\\") and i + 1 < len(t) and t[i + 1].kind == "nl":
                i += 2
            else:
                break
        return (pieces or None) if not want or not pieces else pieces, i

    def bare(self, at: int, whole_line: bool, plain: bool = False) -> Piece | None:
        """An unquoted value: the rest of a configuration line, or a run without blanks and marks; with a digit in it, unless ``plain``."""
        while self.text[at : at + 1] in (b" ", b"\t"):
            at += 1
        if whole_line:
            stop = self.text.find(b"\n", at)
            raw = self.text[at : len(self.text) if stop < 0 else stop]
            raw = re.split(rb"[\x20\t][#;]", raw, maxsplit=1)[0].rstrip(b" \t\r")
            if raw and raw[:1] not in b"\"'`([{<|>&*!" and raw[-1:] not in b";,{([":
                return (at, at + len(raw), raw) if plain or re.search(rb"\d", raw) else None
        if not self.run[0] <= at < self.run[1]:  # else the run that was tried ends this one too
            m = _BARE.match(self.text, at)
            if m is None:
                return None
            digit = max((m[0].rfind(b"%d" % d) for d in range(10)), default=-1)
            self.run = (at, m.end(), at + digit if digit >= 0 else -1)
        stop = self.run[1]
        return (at, stop, self.text[at:stop]) if (plain or self.run[2] >= at) and self.text[stop : stop + 1] != b"(" else None

    def block(self, at: int, line: int) -> Piece | None:
        """The lines of a YAML block scalar, which are indented more than the line of its key."""
        own = _INDENT.match(self.text, line).end() - line
        first, last, lines, pos = -1, -1, [], at
        while pos < len(self.text):
            stop = self.text.find(b"\n", pos)
            stop = len(self.text) if stop < 0 else stop
            raw = self.text[pos:stop]
            if raw.strip():
                if len(raw) - len(raw.lstrip(b" ")) <= own:
                    break
                first = pos + len(raw) - len(raw.lstrip(b" ")) if first < 0 else first
                last = pos + len(raw.rstrip())
                lines.append(raw.strip())
            pos = stop + 1
        return (first, last, b"\n".join(lines)) if lines else None

    def configures(self, line: int, start: int) -> bool:
        """Whether the target at ``start`` is the first thing on its line, as in configuration."""
        if self.begins[0] != line:
            self.begins = (line, _LINE_START.match(self.text, line).end())
        first = self.begins[1]
        if start < first:  # the target is a word like export itself
            return bool(_WHOLE_LINE_START.match(self.text, line, start))
        return start <= first + 3 and not self.text[first:start].strip(b"\"'")

    def value(self, name: bytes, i: int, line: int, target_start: int, op: bytes) -> int:
        """Reads what token i - 1 assigns to ``name``; the token to go on from."""
        t = self.tokens
        after = t[i - 1].end
        if i >= len(t):
            if piece := self.bare(after, True, plain=True):
                self.give(name, [piece])
            return i
        config = self.configures(line, target_start)
        if op == b":" and config and (m := _BLOCK.match(self.text, after)):
            piece = self.block(m.end(), line)
            if piece:
                self.give(name, [piece])
            while i < len(t) and piece and t[i].start < piece[1]:
                i += 1
            return i
        if t[i].kind == "nl":
            return i
        parts, j = self.expression(i)
        ended = j >= len(t) or t[j].kind == "nl" or self.is_op(j, b",", b";", b")", b"}", b"]", b">", b"/>") or t[i].kind == "str"
        if parts and ended:
            self.give(name, parts)
            return j
        if raw := self.bare(after, config and op in (b"=", b":")):
            self.give(name, [raw])
            while i < len(t) and t[i].start < raw[1]:
                i += 1
            return i
        self.forget(name)  # something else now
        return i

    def give(self, name: bytes, parts: list[Piece | Value]) -> None:
        value = Value(parts)
        self.keep(name, value)
        self.found.append((name, value))

    def element(self, i: int) -> int:
        """An XML tag from token i on: its attributes, and the text up to its closing tag."""
        t = self.tokens
        tag, j = self.chain(i + 1)
        given: dict[bytes, Piece] = {}
        while j < len(t) and not self.is_op(j, b">", b"/>", b"<"):
            if t[j].kind == "name":
                name, k = self.chain(j)
                if self.is_op(k, b"=") and k + 1 < len(t) and t[k + 1].kind == "str":
                    given[name.lower()] = (t[k + 1].start, t[k + 1].end, t[k + 1].value)
                    self.found.append((name, Value([given[name.lower()]])))
                    k += 2
                j = k
            else:
                j += 1
        label = next((given[k][2] for k in _ATTRIBUTE_NAMES if k in given), b"")
        if label and b"value" in given:
            self.found.append((label, Value([given[b"value"]])))
        if self.is_op(j, b">"):
            at = t[j].end
            stop = self.text.find(b"<", at)
            if stop > at and self.text.startswith(b"</" + tag, stop):
                raw = self.text[at:stop]
                body = raw.strip()
                if body:
                    first = at + len(raw) - len(raw.lstrip())
                    self.found += [(x, Value([(first, first + len(body), body)])) for x in (tag, label) if x]
                while j < len(t) and t[j].start < stop:
                    j += 1
                return j
        return j

    def read(self) -> None:
        t, i, line = self.tokens, 0, 0
        self.line(0)
        while i < len(t):
            k = t[i]
            if k.kind == "nl":
                line = k.end
                self.line(line)
                i += 1
            elif self.is_op(i, b"{"):
                self.depth += 1
                self.enter(_Scope(self.depth, -1))
                i += 1
            elif self.is_op(i, b"}"):
                while len(self.scopes) > 1 and self.scopes[-1].depth >= self.depth > 0:
                    self.leave()
                self.depth = max(0, self.depth - 1)
                i += 1
            elif self.is_op(i, b"<") and i + 1 < len(t) and t[i + 1].kind == "name" and t[i + 1].start == k.end:
                i = max(i + 1, self.element(i))
            elif k.kind in ("name", "str"):
                i = self.target(i, line)
            else:
                i += 1

    def target(self, i: int, line: int) -> int:
        t = self.tokens
        start = t[i].start
        name, j = (t[i].value, i + 1) if t[i].kind == "str" else self.chain(i)
        if j >= len(t) or not self.joined(j - 1, j):
            return j
        if self.is_op(j, b":") and j + 2 < len(t) and t[j + 1].kind == "name" and t[i].kind == "name":
            kind, k = self.chain(j + 1)  # a declared type
            if self.is_op(k, b"=") and self.joined(k - 1, k):
                return self.value(name, k + 1, line, start, b"=")
        if self.is_op(j, b"=", b":=", b":", b"=>"):
            return self.value(name, j + 1, line, start, t[j].value)
        if t[i].kind == "str" and self.is_op(j, b",") and j + 1 < len(t) and t[j + 1].kind in ("str", "name"):
            pieces, k = self.expression(j + 1)  # put("name", "literal")
            if pieces and self.is_op(k, b")"):
                self.found.append((name, Value(pieces)))
            return j + 1
        if t[i].kind == "name" and self.is_op(j, b"(") and t[j].start == t[j - 1].end and name.rsplit(b".", 1)[-1].lower().startswith((b"set", b"with")):
            pieces, k = self.expression(j + 1)  # setName("literal")
            if pieces and self.is_op(k, b")"):
                self.found.append((name, Value(pieces)))
            return j + 1
        if t[i].kind == "name" and name.lower() == b"define" and t[j].kind == "name":
            named, k = self.chain(j)  # a macro
            pieces, k = self.expression(k)
            if pieces:
                self.give(named, pieces)
            return max(k, j)
        return j


def pairs(text: bytes) -> Iterator[tuple[int, list[Pair]]]:
    """(where a text begins, its assignments in order) for the text and for each comment in it; places count from that beginning."""
    own: list[Pair] = []
    reader = _Reader(text, own, False)
    reader.read()
    yield 0, own
    for a, b in reader.comments:
        if b > a:
            own = []
            _Reader(text[a:b], own, True).read()
            yield a, own
