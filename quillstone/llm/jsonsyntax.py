"""A recursive-descent parser for strict JSON with panic-mode recovery, over token letters like pysyntax."""

from __future__ import annotations

import re

_TOKEN = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?![\w.])|(?:true|false|null)(?!\w)|[{}\[\]:,]|\n|[^ \t\r]')
_LETTER = {"true": "v", "false": "v", "null": "v", **{c: c for c in "{}[]:,\n"}}
_NUMBER = frozenset("-0123456789")
#: Deepest nesting that the parser follows.
DEEPEST = 900


class _Reader:
    def __init__(self, letters: str):
        self.s, self.p, self.errors = letters + "\0", 0, []

    def fault(self, cause: str) -> None:
        self.errors.append((self.p, cause))

    def recover(self) -> None:
        """To the next comma or closing bracket of the present level."""
        s, depth = self.s, 0
        while (c := s[self.p]) != "\0":
            if c in "[{":
                depth += 1
            elif c in "]}":
                if not depth:
                    return
                depth -= 1
            elif c == "," and not depth:
                return
            self.p += 1

    def value(self, depth: int) -> None:
        c = self.s[self.p]
        if c in "sv":
            self.p += 1
        elif depth > DEEPEST:
            self.fault("nested too deeply")
            self.p = len(self.s) - 1
        elif c == "{":
            self.p += 1
            self.members(depth)
        elif c == "[":
            self.p += 1
            self.items(depth)
        else:
            self.fault("value expected" if c != "\0" else "unexpected end")
            self.recover()

    def items(self, depth: int) -> None:
        s = self.s
        if s[self.p] == "]":
            self.p += 1
            return
        while True:
            self.value(depth + 1)
            if s[self.p] == ",":
                self.p += 1
                continue
            if s[self.p] == "]":
                self.p += 1
                return
            self.fault("',' or ']' expected" if s[self.p] != "\0" else "unexpected end")
            if s[self.p] in "}\0":
                return
            self.p += 1
            self.recover()

    def members(self, depth: int) -> None:
        s = self.s
        if s[self.p] == "}":
            self.p += 1
            return
        while True:
            if s[self.p] == "s":
                self.p += 1
                if s[self.p] == ":":
                    self.p += 1
                    self.value(depth + 1)
                else:
                    self.fault("':' expected")
                    self.recover()
            else:
                self.fault("property name expected" if s[self.p] != "\0" else "unexpected end")
                self.recover()
            if s[self.p] == ",":
                self.p += 1
                continue
            if s[self.p] == "}":
                self.p += 1
                return
            self.fault("',' or '}' expected" if s[self.p] != "\0" else "unexpected end")
            if s[self.p] in "]\0":
                return
            self.p += 1
            self.recover()


def errors_of(text: str) -> list[tuple[int, str]]:
    """All errors of a JSON text: (line from 1, cause); empty if it is strict JSON."""
    known = _LETTER.get
    letters = "".join([known(t) or ("s" if len(t) > 1 and t[0] == '"' else "v" if t[0] in _NUMBER and t != "-" else "E") for t in _TOKEN.findall(text)])
    plain = letters.replace("\n", "")
    r = _Reader(plain)
    r.value(0)
    if r.s[r.p] != "\0":
        r.fault("text after the value")
    if not r.errors:
        return []
    places = [i for i, c in enumerate(letters) if c != "\n"] + [len(letters)]
    return [(letters.count("\n", 0, places[min(p, len(places) - 1)]) + 1, cause) for p, cause in r.errors]
