"""A recursive-descent parser for Python 3.13 with precedence climbing and panic-mode recovery.

Source is cut into logical lines; every token becomes one letter (its class), so that a line is a short string such as
``n=n.n(s,n=s)``. The statement parser works on that string alone and its verdict is kept by string: lines that differ
only in names and literals are parsed once. Blocks are a second recursive descent over lines and their indents. After
an error the parser goes on at the next logical line, so that one file yields all of its errors.

The parser accepts nothing that Python's own grammar rejects; where it is stricter (a number glued to a keyword, say),
the caller's exact check decides.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

#: The keywords of the language with the letters that stand for them here.
KEYWORDS = {
    "False": "T", "None": "T", "True": "T", "and": "K", "as": "Q", "assert": "V", "async": "Y", "await": "w", "break": "B", "class": "C",
    "continue": "B", "def": "F", "del": "X", "elif": "L", "else": "e", "except": "x", "finally": "y", "for": "o", "from": "r", "global": "G",
    "if": "i", "import": "I", "in": "j", "is": "z", "lambda": "l", "nonlocal": "G", "not": "!", "or": "O", "pass": "B", "raise": "R",
    "return": "u", "try": "t", "while": "h", "with": "v", "yield": "d", "match": "m", "case": "k", "type": "p", "_": "n",
}
#: Operators of more than one character, and single ones that share a class. `/` has a letter apart
#: from // and %, as it also marks positional-only parameters.
OPERATORS = {
    **{x: "a" for x in ("+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**=")},
    "**": "P", "//": "/", "%": "/", "/": "\x01", "<<": "S", ">>": "S", "==": "c", "!=": "c", "<=": "c", ">=": "c", "<": "c", ">": "c",
    "...": "T", ":=": "W", "->": "A", "-": "+", "+": "+",
}
NAMES = "nmkp"  # letters that can be a name

_PREFIX = r"(?:[rRuUbB]|[rR][bB]|[bB][rR])?"
_STRING = _PREFIX + r"(?:'''(?:[^\\']|\\.|'(?!''))*'''|\"\"\"(?:[^\\\"]|\\.|\"(?!\"\"))*\"\"\"|'(?!'')(?:[^\\'\n]|\\.)*'|\"(?!\"\")(?:[^\\\"\n]|\\.)*\")"
_OPS = r"\*\*=|//=|>>=|<<=|\.\.\.|:=|->|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|\*\*|//|<<|>>|[-+*/%@&|^~<>()\[\]{},:.;=]"
_TOKEN = re.compile(rf"{_STRING}|[^\W\d]\w*|\.?[0-9](?:[eE][+-]|[\w.])*|\n[ \t\f]*|#[^\n]*|\\\n|{_OPS}|[^ \t\f]", re.S)
_NUMBER = re.compile(
    r"(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:0(?:_?0)*|[1-9](?:_?[0-9])*)|"
    r"(?:[0-9](?:_?[0-9])*(?:\.(?:[0-9](?:_?[0-9])*)?)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?[jJ]|"
    r"(?:[0-9](?:_?[0-9])*\.(?:[0-9](?:_?[0-9])*)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?|[0-9](?:_?[0-9])*[eE][+-]?[0-9](?:_?[0-9])*)\Z"
)
_FSTRING = re.compile(r"(?<!\w)(?:[fF][rR]?|[rR][fF])(?=['\"])")
_BAD_ESCAPE = re.compile(r"(?<!\\)(?:\\\\)*\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4})|U(?!000[0-9a-fA-F]{5}|0010[0-9a-fA-F]{4})|N(?!\{[^{}]+\}))")
_NAMED = re.compile(r"(?<!\\)(?:\\\\)*\\N\{([^{}]+)\}")
_BAD_BYTES_ESCAPE = re.compile(r"(?<!\\)(?:\\\\)*\\x(?![0-9a-fA-F]{2})")

#: Most line verdicts and token classes that a worker keeps.
KEEP = 200_000


def _bad_escape(body: str) -> bool:
    """Whether a text has an escape of wrong form, or one that names no character."""
    if _BAD_ESCAPE.search(body):
        return True
    return "\\N" in body and not all(map(_is_character, _NAMED.findall(body)))


@lru_cache(maxsize=4096)
def _is_character(name: str) -> bool:
    try:
        return len(unicodedata.lookup(name)) == 1  # a named sequence is no character
    except KeyError:
        return False

#: Deepest nesting of brackets, as in the language's own tokenizer, and most digits of an integer.
DEEPEST, DIGITS = 200, 4300


class Classes(dict):
    """The letter of each token, worked out once per spelling."""

    def __missing__(self, t: str) -> str:
        if len(self) > KEEP:
            self.clear()
            self.update(KEYWORDS)
            self.update(OPERATORS)
        c = self[t] = self.classify(t)
        return c

    @staticmethod
    def classify(t: str) -> str:
        first = t[0]
        if first == "\n":
            return "\n"
        if first == "#":
            return "#"
        if t == "\\\n":
            return "\\"
        if t[-1] in "'\"" and len(t) > 1:
            start = min(i for i in (t.find("'"), t.find('"')) if i >= 0)
            prefix, body = t[:start].lower(), t[start:]
            if "b" in prefix:
                return "E" if not body.isascii() or "r" not in prefix and "\\" in body and _BAD_BYTES_ESCAPE.search(body) else "b"
            return "E" if "r" not in prefix and "\\" in body and _bad_escape(body) else "s"
        if first.isdigit() and first.isascii() or first == "." and len(t) > 1 and t != "...":
            return "0" if _NUMBER.match(t) and (len(t) <= DIGITS) else "E"
        if t.isidentifier():
            return "n"
        return t if t in "*@&|^~()[]{},:.;=" else "E"


CLASSES = Classes(KEYWORDS | OPERATORS)


class Bad(Exception):
    """A syntax error at a token of the line."""

    def __init__(self, at: int, cause: str):
        self.at, self.cause = at, cause


# What an expression may be used as.
NAME, PLACE, TARGET, STAR, GROUP, GENERATOR = 1, 2, 4, 8, 16, 32
#: Binding powers of binary operators; higher binds tighter.
POWER = {"|": 1, "^": 2, "&": 3, "S": 4, "+": 5, "*": 6, "/": 6, "\x01": 6, "@": 6}
_CLOSER = {"(": ")", "[": "]", "{": "}"}


class Line:
    """The statements of one logical line."""

    def __init__(self, s: str):
        self.s, self.p = s + "\0", 0

    # -- helpers
    def eat(self, c: str) -> bool:
        if self.s[self.p] == c:
            self.p += 1
            return True
        return False

    def need(self, c: str, cause: str = "invalid syntax") -> None:
        if self.s[self.p] != c:
            raise Bad(self.p, cause)
        self.p += 1

    def name(self) -> None:
        if self.s[self.p] not in NAMES:
            raise Bad(self.p, "name expected")
        self.p += 1

    def dotted(self) -> None:
        self.name()
        while self.eat("."):
            self.name()

    # -- expressions: precedence climbing
    def atom(self) -> int:
        s, c = self.s, self.s[self.p]
        if c in NAMES:
            self.p += 1
            return NAME | PLACE | TARGET
        if c in "0T":
            self.p += 1
            return 0
        if c in "sbf":
            kind = c == "b"
            while s[self.p] in "sbf":
                if (s[self.p] == "b") != kind:
                    raise Bad(self.p, "bytes and text literals mixed")
                self.p += 1
            return 0
        if c == "(":
            self.p += 1
            if self.eat(")"):
                return GROUP | TARGET
            if s[self.p] == "d":
                self.yields()
                self.need(")", "'(' was never closed")
                return GROUP
            first = self.element()
            if s[self.p] in "oY":
                if first & STAR:
                    raise Bad(self.p, "unpacking in a comprehension")
                self.comprehension()
                self.need(")", "'(' was never closed")
                return GROUP | GENERATOR
            if s[self.p] != ",":
                self.need(")", "'(' was never closed or comma missing")
                if first & STAR:
                    raise Bad(self.p, "starred expression in brackets")
                return (first & (NAME | PLACE | TARGET)) | GROUP
            ok = first & TARGET
            while self.eat(","):
                if s[self.p] == ")":
                    break
                ok &= self.element()
            self.need(")", "'(' was never closed or comma missing")
            return GROUP | ok & TARGET
        if c == "[":
            self.p += 1
            if self.eat("]"):
                return GROUP | TARGET
            first = self.element()
            if s[self.p] in "oY":
                if first & STAR:
                    raise Bad(self.p, "unpacking in a comprehension")
                self.comprehension()
                self.need("]", "'[' was never closed")
                return GROUP
            ok = first & TARGET
            while self.eat(","):
                if s[self.p] == "]":
                    break
                ok &= self.element()
            self.need("]", "'[' was never closed or comma missing")
            return GROUP | ok & TARGET
        if c == "{":
            self.p += 1
            self.braces()
            return GROUP
        raise Bad(self.p, "invalid character" if c == "E" else "expression expected" if c != "\0" else "unexpected end")

    def braces(self) -> None:
        s, mapping, n = self.s, None, 0
        while s[self.p] != "}":
            pair = True
            if self.eat("P"):
                self.binary(1)
                unpack = True
            else:
                unpack = bool(self.element() & STAR)
                pair = False
                if self.eat(":"):
                    if unpack or s[self.p] == "*":
                        raise Bad(self.p, "starred expression in a pair")
                    self.ternary()
                    pair = True
            if mapping is not None and pair != mapping:
                raise Bad(self.p, "pairs and single values mixed")
            mapping = pair
            if s[self.p] in "oY":
                if n or unpack:
                    raise Bad(self.p, "unpacking in a comprehension" if unpack else "comma before a comprehension")
                self.comprehension()
                break
            n += 1
            if not self.eat(","):
                break
        self.need("}", "'{' was never closed or comma missing")

    def comprehension(self) -> None:
        s = self.s
        while s[self.p] in "oY":
            if self.eat("Y") and s[self.p] != "o":
                raise Bad(self.p, "'for' expected")
            self.need("o")
            self.targets("j")
            self.need("j", "'in' expected")
            self.disjunction()
            while self.eat("i"):
                self.disjunction(True)

    def arguments(self) -> None:
        """Call arguments after the opening bracket."""
        s, keyword, double, n = self.s, False, False, 0
        while s[self.p] != ")":
            if self.eat("*"):
                if double:
                    raise Bad(self.p, "iterable after keyword unpacking")
                self.ternary()
            elif self.eat("P"):
                self.ternary()
                double = True
            elif s[self.p] in NAMES and s[self.p + 1] == "=":
                self.p += 2
                self.ternary()
                keyword = True
            else:
                if keyword or double:
                    # a lone generator can't follow either
                    raise Bad(self.p, "positional argument after keyword argument")
                self.named()
                if s[self.p] in "oY":
                    self.comprehension()
                    if n or s[self.p] != ")":
                        raise Bad(self.p, "generator must be bracketed")
                if s[self.p] == "=":
                    raise Bad(self.p, "assignment in an expression")
            n += 1
            if not self.eat(","):
                break
        self.need(")", "'(' was never closed or comma missing")

    def subscript(self) -> None:
        s = self.s
        while True:
            if self.eat("*"):
                self.binary(1)
            elif s[self.p] == ":":
                self.slice_rest()
            else:
                self.named()
                if s[self.p] == ":":
                    self.slice_rest()
            if not self.eat(",") or s[self.p] == "]":
                break
        self.need("]", "'[' was never closed or comma missing")

    def slice_rest(self) -> None:
        for _ in range(2):
            if not self.eat(":"):
                return
            if self.s[self.p] not in ":],":
                self.ternary()

    def primary(self) -> int:
        s = self.s
        awaited = self.eat("w")
        f = self.atom()
        while True:
            c = s[self.p]
            if c == ".":
                self.p += 1
                self.name()
                f = PLACE | TARGET
            elif c == "(":
                self.p += 1
                self.arguments()
                f = 0
            elif c == "[":
                self.p += 1
                if s[self.p] == "]":
                    raise Bad(self.p, "expression expected")
                self.subscript()
                f = PLACE | TARGET
            else:
                return 0 if awaited else f

    def unary(self) -> int:
        if self.s[self.p] in "+~":
            self.p += 1
            self.unary()
            return 0
        f = self.primary()
        if self.eat("P"):
            self.unary()
            return 0
        return f

    def binary(self, least: int) -> int:
        f = self.unary()
        while (power := POWER.get(self.s[self.p], 0)) >= least:
            self.p += 1
            self.binary(power + 1)
            f = 0
        return f

    def comparison(self) -> int:
        f, s = self.binary(1), self.s
        while True:
            c = s[self.p]
            if c == "c" or c == "j":
                self.p += 1
            elif c == "!" and s[self.p + 1] == "j":
                self.p += 2
            elif c == "z":
                self.p += 2 if s[self.p + 1] == "!" else 1
            else:
                return f
            self.binary(1)
            f = 0

    def inversion(self) -> int:
        if self.eat("!"):
            self.inversion()
            return 0
        return self.comparison()

    def disjunction(self, named: bool = False) -> int:
        f = self.inversion()
        while self.s[self.p] in "KO":
            self.p += 1
            self.inversion()
            f = 0
        return f

    def ternary(self) -> int:
        if self.s[self.p] == "l":
            self.p += 1
            self.parameters(":", False)
            self.need(":", "':' expected")
            self.ternary()
            return 0
        f = self.disjunction()
        if self.eat("i"):
            self.disjunction()
            self.need("e", "'else' expected after 'if' expression")
            self.ternary()
            return 0
        return f

    def named(self) -> int:
        if self.s[self.p] in NAMES and self.s[self.p + 1] == "W":
            self.p += 2
            self.ternary()
            return 0
        return self.ternary()

    def element(self) -> int:
        """An item of a display: starred or named expression."""
        if self.eat("*"):
            return STAR | self.binary(1) & TARGET
        return self.named()

    def starred_list(self, stops: str, named: bool = False) -> int:
        """star_expressions; the flags say what it may be assigned as."""
        s = self.s

        def one() -> int:
            if self.eat("*"):
                return STAR | self.binary(1) & TARGET
            return self.named() if named else self.ternary()

        f = one()
        if s[self.p] != ",":
            return f
        ok = f & TARGET
        while self.eat(","):
            if s[self.p] in stops:
                break
            ok &= one()
        return ok & TARGET

    def yields(self) -> None:
        self.need("d")
        if self.eat("r"):
            self.ternary()
        elif self.s[self.p] not in ")]}=;\0":
            self.starred_list(")]}=;\0")

    def targets(self, stop: str) -> None:
        """Targets of a loop: primaries, starred or not, that can be assigned to."""
        s, n = self.s, 0
        while True:
            self.eat("*")
            at = self.p
            if not self.primary() & TARGET:
                raise Bad(at, "cannot assign here")
            n += 1
            if not self.eat(",") or s[self.p] == stop:
                return

    def parameters(self, stop: str, annotated: bool) -> None:
        s, default, star, slash, names, after_star = self.s, False, False, False, 0, 0
        while s[self.p] != stop:
            if self.eat("\x01"):
                if slash or star or not names:
                    raise Bad(self.p, "misplaced '/'")
                slash = True
            elif self.eat("*"):
                if star:
                    raise Bad(self.p, "'*' twice")
                star = True
                if s[self.p] in NAMES:
                    self.p += 1
                    after_star = 1
                    if annotated and self.eat(":"):
                        if self.eat("*"):
                            self.binary(1)
                        else:
                            self.ternary()
                    if s[self.p] == "=":
                        raise Bad(self.p, "default of a starred parameter")
                elif s[self.p] != "," or s[self.p + 1] not in NAMES:
                    raise Bad(self.p, "named parameter expected after '*'")
            elif self.eat("P"):
                self.name()
                if annotated and self.eat(":"):
                    self.ternary()
                if s[self.p] == "=":
                    raise Bad(self.p, "default of a starred parameter")
                self.eat(",")
                if s[self.p] != stop:
                    raise Bad(self.p, "parameter after '**'")
                return
            else:
                self.name()
                names += 1
                if annotated and self.eat(":"):
                    self.ternary()
                if self.eat("="):
                    self.ternary()
                    default = True
                elif default and not star:
                    raise Bad(self.p, "parameter without a default after one with")
            if not self.eat(","):
                break
        if s[self.p] != stop:
            raise Bad(self.p, "invalid parameters")

    # -- simple statements
    def simple(self) -> None:
        s, c = self.s, self.s[self.p]
        if c == "B":
            self.p += 1
        elif c == "u":
            self.p += 1
            if s[self.p] not in ";\0":
                self.starred_list(";\0")
        elif c == "R":
            self.p += 1
            if s[self.p] not in ";\0":
                self.ternary()
                if self.eat("r"):
                    self.ternary()
        elif c == "G":
            self.p += 1
            self.name()
            while self.eat(","):
                self.name()
        elif c == "X":
            self.p += 1
            while True:
                at = self.p
                f = self.primary()
                if not f & TARGET:
                    raise Bad(at, "cannot delete this")
                if not self.eat(",") or s[self.p] in ";\0":
                    break
        elif c == "V":
            self.p += 1
            self.ternary()
            if self.eat(","):
                self.ternary()
        elif c == "I":
            self.p += 1
            while True:
                self.dotted()
                if self.eat("Q"):
                    self.name()
                if not self.eat(","):
                    break
        elif c == "r":
            self.imports()
        else:
            if c == "p" and s[self.p + 1] in NAMES:
                self.p += 2
                if self.eat("["):
                    self.type_parameters()
                self.need("=")
                self.ternary()
            else:
                self.assignment()
        if s[self.p] not in ";\0":
            raise Bad(self.p, "invalid character" if s[self.p] == "E" else "unmatched bracket" if s[self.p] in ")]}" else "invalid syntax")

    def imports(self) -> None:
        s = self.s
        self.need("r")
        dots = self.p
        while s[self.p] == "." or s[self.p] == "T":
            self.p += 1
        if s[self.p] in NAMES:
            self.dotted()
        elif self.p == dots:
            raise Bad(self.p, "module name expected")
        self.need("I", "'import' expected")
        if self.eat("*"):
            return
        bracket = self.eat("(")
        while True:
            self.name()
            if self.eat("Q"):
                self.name()
            if not self.eat(","):
                break
            if bracket and s[self.p] == ")":
                break
        if bracket:
            self.need(")", "'(' was never closed")

    def assignment(self) -> None:
        s, at = self.s, self.p
        if s[self.p] == "d":
            self.yields()
            if s[self.p] == "=":
                raise Bad(at, "cannot assign to yield")
            return
        if s[at] in NAMES and s[at + 1] == "W":
            raise Bad(at + 1, "':=' at statement level")
        f = self.starred_list("=;:\0")
        if s[self.p] == ":":
            if not f & PLACE:
                raise Bad(at, "only single targets can be annotated")
            self.p += 1
            self.ternary()
            if self.eat("="):
                if s[self.p] == "d":
                    self.yields()
                else:
                    self.starred_list(";\0")
            return
        if s[self.p] == "a":
            if not f & PLACE:
                raise Bad(at, "cannot assign in place here")
            self.p += 1
            if s[self.p] == "d":
                self.yields()
            else:
                self.starred_list(";\0")
            return
        while s[self.p] == "=":
            if not f & TARGET:
                raise Bad(at, "cannot assign here")
            self.p += 1
            at = self.p
            if s[self.p] == "d":
                self.yields()
                f = 0
            else:
                f = self.starred_list("=;\0")

    def type_parameters(self) -> None:
        while True:
            star = self.eat("*") or self.eat("P")
            self.name()
            if self.eat(":"):
                if star:
                    raise Bad(self.p, "bound of a starred type parameter")
                self.ternary()
            if self.eat("="):
                self.ternary()
            if not self.eat(",") or self.s[self.p] == "]":
                break
        self.need("]")

    # -- heads of blocks
    def head(self) -> str:
        """The head of a compound statement up to its colon; what it is."""
        s = self.s
        is_async = self.eat("Y")
        c = s[self.p]
        if is_async and c not in "Fov":
            raise Bad(self.p, "invalid syntax after 'async'")
        self.p += 1
        if c in "iLh":
            self.named()
        elif c == "o":
            self.targets("j")
            self.need("j", "'in' expected")
            self.starred_list(":")
        elif c == "F":
            self.name()
            if self.eat("["):
                self.type_parameters()
            self.need("(", "'(' expected")
            self.parameters(")", True)
            self.need(")", "'(' was never closed")
            if self.eat("A"):
                self.ternary()
        elif c == "C":
            self.name()
            if self.eat("["):
                self.type_parameters()
            if self.eat("("):
                self.arguments()
        elif c == "v":
            self.withs()
        elif c == "x":
            self.eat("*")
            if s[self.p] != ":":
                self.ternary()
                if self.eat("Q"):
                    self.name()
            elif s[self.p - 1] == "*":
                raise Bad(self.p, "exception type expected")
        elif c == "m":
            self.starred_list(":", True)
        elif c == "k":
            self.pattern_top()
            if self.eat("i"):
                self.named()
        self.need(":", "':' expected")
        return c

    def withs(self) -> None:
        s, start = self.s, self.p
        if s[self.p] == "(":  # bracketed items, if they fit; else an expression that begins with a bracket
            try:
                self.p += 1
                while True:
                    self.with_item()
                    if not self.eat(",") or s[self.p] == ")":
                        break
                self.need(")")
                if s[self.p] == ":":
                    return
            except Bad:
                pass
            self.p = start
        while True:
            self.with_item()
            if not self.eat(","):
                return

    def with_item(self) -> None:
        self.ternary()
        if self.eat("Q"):
            at = self.p
            self.eat("*")
            if not self.primary() & TARGET:
                raise Bad(at, "cannot assign here")

    def pattern_top(self) -> None:
        s = self.s
        while True:
            if self.eat("*"):
                self.name()
            else:
                self.pattern()
            if not self.eat(",") or s[self.p] in "i:":
                return

    def pattern(self) -> None:
        while True:
            self.closed_pattern()
            if not self.eat("|"):
                break
        if self.eat("Q"):
            self.name()

    def closed_pattern(self) -> None:
        s, c = self.s, self.s[self.p]
        if c in "+0":
            self.eat("+")
            self.need("0")
            if self.eat("+"):
                self.need("0")
        elif c in "sb":
            self.atom()
        elif c == "T":
            self.p += 1
        elif c in NAMES:
            self.dotted()
            if self.eat("("):
                keyword = False
                while s[self.p] != ")":
                    if s[self.p] in NAMES and s[self.p + 1] == "=":
                        self.p += 2
                        keyword = True
                    elif keyword:
                        raise Bad(self.p, "positional pattern after keyword pattern")
                    self.pattern()
                    if not self.eat(","):
                        break
                self.need(")")
        elif c in "([":
            self.p += 1
            while s[self.p] != _CLOSER[c]:
                if self.eat("*"):
                    self.name()
                else:
                    self.pattern()
                if not self.eat(","):
                    break
            self.need(_CLOSER[c])
        elif c == "{":
            self.p += 1
            while s[self.p] != "}":
                if self.eat("P"):
                    self.name()
                    self.eat(",")
                    break
                if s[self.p] in NAMES:
                    self.dotted()
                    if s[self.p - 2] != ".":
                        raise Bad(self.p, "literal key expected")
                else:
                    self.closed_pattern()
                self.need(":")
                self.pattern()
                if not self.eat(","):
                    break
            self.need("}")
        else:
            raise Bad(self.p, "pattern expected")

    def statements(self) -> None:
        """simple (; simple)* to the end of the line."""
        while True:
            self.simple()
            if not self.eat(";") or self.s[self.p] == "\0":
                break


#: Verdicts by line: (what it opens or "", whether a block must follow, position and cause of an error or None).
VERDICTS: dict[str, tuple[str, bool, tuple[int, str] | None]] = {}
_OPENERS = "iLhoFCvxetyY"


def verdict(s: str) -> tuple[str, bool, tuple[int, str] | None]:
    got = VERDICTS.get(s)
    if got is None:
        if len(VERDICTS) >= KEEP:
            VERDICTS.clear()
        got = VERDICTS[s] = _verdict(s)
    return got


def _verdict(s: str) -> tuple[str, bool, tuple[int, str] | None]:
    line, c = Line(s), s[0]
    try:
        if c == "@":
            line.p = 1
            line.named()
            if line.s[line.p] != "\0":
                raise Bad(line.p, "invalid decorator")
            return "@", False, None
        if c in _OPENERS:
            kind = line.head()
        elif c in "mk":  # soft keywords: a name wherever that fits
            try:
                line.statements()
                return "", False, None
            except Bad as plain:
                line = Line(s)
                try:
                    kind = line.head()
                except Bad as soft:
                    raise max(plain, soft, key=lambda b: b.at) from None
                if line.s[line.p] != "\0" and c == "m":
                    raise Bad(line.p, "block expected") from None
        else:
            line.statements()
            return "", False, None
        if line.s[line.p] == "\0":
            return kind, True, None
        line.statements()
        return kind, False, None
    except Bad as b:
        # the shape still says whether a block follows
        return (c if c in _OPENERS + "@" else ""), s[-1] == ":" and c in _OPENERS, (b.at, b.cause)
    except RecursionError:
        return "", False, (0, "nested too deeply")


def _fstrings(src: str) -> tuple[str, list[tuple[int, str]]]:
    """`src` with every formatted string replaced by a plain literal of as many lines; errors inside of them."""
    out, pos, errors = [], 0, []
    spans = re.compile(rf"{_STRING}|#[^\n]*|(?P<f>(?<!\w)(?:[fF][rR]?|[rR][fF])(?=['\"]))", re.S)
    while m := spans.search(src, pos):
        if m.lastgroup != "f":
            out.append(src[pos : m.end()])
            pos = m.end()
            continue
        end, bad = _fstring(src, m.end(), "r" in m.group().lower())
        line = src.count("\n", 0, m.start())
        errors += [(line, b) for b in bad]
        out.append(src[pos : m.start()] + "''" + "\\\n" * src.count("\n", m.start(), end))
        if end < 0:
            errors.append((line, "unterminated formatted string"))
            return "".join(out), errors
        pos = end
    out.append(src[pos:])
    return "".join(out), errors


def _fstring(src: str, p: int, raw: bool, spec_of: str = "") -> tuple[int, list[str]]:
    """The end of a formatted string whose quote is at `p` (or of a format spec), -1 if there is none; errors in it."""
    errors: list[str] = []
    if spec_of:
        quote = spec_of
    else:
        quote = src[p : p + 3] if src[p : p + 3] in ("'''", '"""') else src[p]
        p += len(quote)
    n, lit = len(src), p
    while p < n:
        c = src[p]
        if src.startswith(quote, p):
            if not raw and not spec_of and _bad_escape(src[lit:p]):
                errors.append("bad escape")
            return (p, errors) if spec_of else (p + len(quote), errors)
        if c == "\n" and len(quote) == 1:
            return -1, errors
        if c == "\\" and not (raw and src[p + 1 : p + 2] in "{}"):
            if not raw and src.startswith("N{", p + 1):
                p = src.find("}", p)
                if p < 0:
                    return -1, errors
                p += 1
                continue
            p += 1 if src[p + 1 : p + 2] in ("{", "}") else 2
            continue
        if spec_of and c == "}":
            return p, errors
        if c == "{":
            if src.startswith("{{", p) and not spec_of:
                p += 2
                continue
            p, bad = _field(src, p + 1, quote, raw)
            errors += bad
            if p < 0:
                return -1, errors
            continue
        if c == "}":
            if src.startswith("}}", p):
                p += 2
                continue
            errors.append("single '}' in a formatted string")
        p += 1
    return -1, errors


def _field(src: str, p: int, quote: str, raw: bool) -> tuple[int, list[str]]:
    """A replacement field after its brace."""
    start, depth, n, errors = p, 0, len(src), []
    strings = re.compile(_STRING, re.S)
    while p < n:
        c = src[p]
        if m := _FSTRING.match(src, p):
            p, bad = _fstring(src, m.end(), "r" in m.group().lower())
            errors += bad
            if p < 0:
                return -1, errors
            continue
        if c in "'\"rRbBuU" and (m := strings.match(src, p)) and (c in "'\"" or not src[p - 1].isidentifier()):
            p = m.end()
            continue
        if c in "'\"":
            return -1, errors
        if c in "([{":
            depth += 1
        elif c in ")]" or c == "}" and depth:
            depth -= 1
            if depth < 0:
                errors.append("unmatched bracket in a formatted string")
                return p + 1, errors
        elif not depth and (c in ":}" or c == "!" and src[p + 1 : p + 2] != "=" or c == "=" and src[p + 1 : p + 2] != "=" and src[p - 1] not in "=!<>"):
            break
        p += 1
    else:
        return -1, errors
    expression = src[start:p]
    bad = _expression(expression)
    if bad:
        errors.append(bad)
    if src[p] == "=":
        p += 1
        while src[p : p + 1] in (" ", "\t", "\n") and p < n:
            p += 1
    if src[p : p + 1] == "!":
        if src[p + 1 : p + 2] not in tuple("sra"):
            errors.append("invalid conversion")
        p += 2
        while src[p : p + 1] == " ":
            p += 1
    if src[p : p + 1] == ":":
        p, more = _fstring(src, p + 1, raw, quote)
        errors += more
        if p < 0:
            return -1, errors
    if src[p : p + 1] != "}":
        errors.append("'}' expected")
        return (p, errors) if p < n else (-1, errors)
    return p + 1, errors


def _expression(text: str) -> str | None:
    """Why `text` is no expression of a replacement field."""
    if _FSTRING.search(text):
        text, inner = _fstrings(text)
        if inner:
            return inner[0][1]
    s = "".join(c for c in (CLASSES[t] for t in _TOKEN.findall(text)) if c not in "\n\\#")
    if not s:
        return "empty expression"
    line = Line(s)
    try:
        if s[0] == "d":
            line.yields()
        else:
            line.starred_list("\0", True)
        return None if line.s[line.p] == "\0" else "invalid syntax in a formatted string"
    except Bad as b:
        return b.cause
    except RecursionError:
        return "nested too deeply"


def errors_of(src: str) -> list[tuple[int, str]]:
    """All syntax errors of a Python file: (line from 1, cause) in order of lines; empty if it parses."""
    if "\r" in src:
        src = src.replace("\r\n", "\n").replace("\r", "\n")
    errors: list[tuple[int, str]] = []
    if _FSTRING.search(src):
        src, inner = _fstrings(src)
        errors += [(a + 1, b) for a, b in inner]
    tokens = _TOKEN.findall("\n" + src)
    classes = CLASSES
    letters = "".join([classes[t] for t in tokens])
    if "#" in letters or "\\" in letters:
        keep = [i for i, c in enumerate(letters) if c not in "#\\"]
        if letters[-1:] == "\\":
            errors.append((src.count("\n") + 1, "unexpected end after a backslash"))
        tokens = [tokens[i] for i in keep]
        plain = "".join([letters[i] for i in keep])
        numbers, n = [], 0
        for c in letters:  # physical lines, with the joined ones counted
            n += c == "\n" or c == "\\"
            if c == "\n":
                numbers.append(n)
        letters = plain
    else:
        numbers = None
    Blocks(letters, tokens, numbers, errors).run()
    errors.sort(key=lambda e: e[0])
    return errors


class Blocks:
    """Logical lines and their nesting."""

    def __init__(self, letters: str, tokens: list[str], numbers: list[int] | None, errors: list[tuple[int, str]]):
        self.errors = errors
        self.lines: list[tuple[str, str, int]] = []  # indent, letters, line number
        at, number, parts = 0, 0, letters.split("\n")[1:]
        k, n = 0, len(parts)
        while k < n:
            part, indent = parts[k], tokens[at]
            number = numbers[k] if numbers else k + 1
            at += 1 + len(part)
            k += 1
            if not part:
                continue
            if "(" in part or "[" in part or "{" in part:
                depth = sum(part.count(c) for c in "([{") - sum(part.count(c) for c in ")]}")
                while depth > 0 and k < n:
                    more = parts[k]
                    at += 1 + len(more)
                    k += 1
                    depth += sum(more.count(c) for c in "([{") - sum(more.count(c) for c in ")]}")
                    part += more
                if depth > 0:
                    errors.append((number, "bracket was never closed"))
            if part.count("(") + part.count("[") + part.count("{") > DEEPEST:
                deep = most = 0
                for c in part:
                    deep += (c in "([{") - (c in ")]}")
                    most = max(most, deep)
                if most >= DEEPEST:
                    errors.append((number, "nested too deeply"))
                    continue
            self.lines.append((indent[1:], part, number))
        self.k = 0

    @staticmethod
    def column(indent: str) -> tuple[int, int]:
        """Columns with tabs to 8 and to 1; both must order lines alike."""
        if "\f" in indent:
            indent = indent[indent.rindex("\f") + 1 :]
        if "\t" not in indent:
            return len(indent), len(indent)
        return len(indent.expandtabs(8)), len(indent)

    def run(self) -> None:
        lines, errors = self.lines, self.errors
        stack: list[tuple[int, int]] = [(0, 0)]
        opened: list[str] = [""]  # per level: what the last statement of the level opened, and clauses can follow
        pending = False  # a head without its block
        for indent, s, number in lines:
            col = self.column(indent)
            if pending:
                pending = False
                if col[0] > stack[-1][0] and col[1] > stack[-1][1]:
                    stack.append(col)
                    opened.append("")
                else:
                    errors.append((number, "indented block expected"))
            elif col[0] > stack[-1][0]:
                errors.append((number, "unexpected indent"))
                stack.append(col)
                opened.append("")
            if col[0] < stack[-1][0]:
                while len(stack) > 1 and col[0] < stack[-1][0]:
                    stack.pop()
                    self.close(opened.pop(), number)
                if col[0] != stack[-1][0]:
                    errors.append((number, "unindent matches no outer level"))
                    stack.append(col)
                    opened.append("")
            if col[1] != stack[-1][1]:
                errors.append((number, "inconsistent tabs and spaces"))
                stack[-1] = col
            kind, pending, bad = verdict(s)
            if bad:
                errors.append((number, bad[1]))
            before = opened[-1]
            # clauses that continue a statement
            if kind in ("L", "e", "x", "y") and kind:
                if not self.continues(before, kind):
                    errors.append((number, "clause without its statement"))
                now = "t+" if kind == "x" else {"L": "i", "e": "te" if before == "t+" else "", "y": ""}[kind]
            else:
                if before in ("t", "@"):
                    if before == "t" or kind not in ("F", "C", "@"):
                        errors.append((number, "'except' or 'finally' expected" if before == "t" else "definition expected after a decorator"))
                if len(opened) > 1 and opened[-2] == "m" and kind != "k":
                    errors.append((number, "'case' expected"))
                elif kind == "k" and not (len(opened) > 1 and opened[-2] == "m"):
                    errors.append((number, "'case' outside of 'match'"))
                now = kind if kind in ("i", "o", "h", "t", "@", "m") else ""
            opened[-1] = now
        last = lines[-1][2] if lines else 1
        if pending:
            errors.append((last, "indented block expected"))
        while opened:
            self.close(opened.pop(), last)

    def close(self, what: str, number: int) -> None:
        if what in ("t", "@"):
            self.errors.append((number, "'except' or 'finally' expected" if what == "t" else "definition expected after a decorator"))

    @staticmethod
    def continues(before: str, kind: str) -> bool:
        if kind == "L":
            return before == "i"
        if kind == "e":
            return before in ("i", "o", "h", "t+")
        if kind == "x":
            return before in ("t", "t+")
        return before in ("t", "t+", "te")
