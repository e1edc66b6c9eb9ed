"""Data-step expressions: text to a small tree to Columns."""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import formats, values
from .functions import FUNCTIONS, call

_TOKEN = re.compile(
    r"""\s*(?:(?P<str>(?:'(?:[^']|'')*'|"(?:[^"]|"")*")(?:dt|d|t|n)?(?!\w))|(?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
    |(?P<name>(?:first|last)\.\w+|\$?[A-Za-z_]\w*\.(?:\d+)?(?=\s*[,)])|[A-Za-z_]\w*)|(?P<op>\*\*|\|\||<>|><|<=|>=|\^=|~=|!!|[-+*/()<>=&|^~,{}\[\].:]))""",
    re.I | re.X,
)
_WORDS = {"eq": "=", "ne": "^=", "lt": "<", "gt": ">", "le": "<=", "ge": ">=", "and": "&", "or": "|", "not": "^"}
#: Arguments that shape the plan and so are constants, by position.
CONSTANT = {
    "INTCK": {0}, "INTNX": {0, 3}, "SCAN": {2}, "COMPRESS": {1}, "FINDC": {1}, "VERIFY": {1}, "COUNT": {1, 2}, "COUNTC": {1}, "TRANSLATE": {1, 2}, "CATX": {0}, "CATQ": {0}, "PRXMATCH": {0}, "PRXCHANGE": {0, 1},
    "PRXPOSN": {0, 1}, "PRXPARSE": {0}, "PRXPAREN": {0}, "PUT": {1}, "INPUT": {1}, "CDF": {0}, "PDF": {0}, "SDF": {0}, "LOGCDF": {0}, "QUANTILE": {0}, "PROPCASE": {1}, "DATDIF": {2}, "YRDIF": {2}, "FIND": {1, 2, 3}, "LARGEST": {0}, "SMALLEST": {0},
    "RAND": {0, 1, 2}, "RANUNI": {0}, "RANNOR": {0}, "RANEXP": {0}, "RANBIN": {0, 1, 2},
}
TEXT = set("UPCASE LOWCASE TRIM TRIMN STRIP LEFT REVERSE CAT CATS CATT CATX CATQ REPEAT BYTE CHAR SUBSTR SUBSTRN COMPRESS TRANSLATE TRANWRD COMPBL PROPCASE SCAN PRXCHANGE PRXPOSN PUT NLDATE SOUNDEX SYMGET COALESCEC _PREFIX".split())


@dataclass
class Node:
    kind: str  # num str date datetime time var call bin un in index missing
    value: object = None
    args: tuple = ()


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise SyntaxError(f"can't read {text[at : at + 30]!r}")
        kind = m.lastgroup
        word = m[kind]
        if kind == "name" and word.lower() in _WORDS:
            kind, word = "op", _WORDS[word.lower()]
        out.append((kind, {"~=": "^=", "~": "^", "!!": "||"}.get(word, word) if kind == "op" else word))
        at = m.end()
    return out


class Parser:
    def __init__(self, text: str):
        self.t, self.k = tokens(text), 0

    def peek(self) -> str | None:
        return self.t[self.k][1] if self.k < len(self.t) and self.t[self.k][0] == "op" else None

    def take(self, *ops: str) -> str | None:
        if self.peek() in ops:
            self.k += 1
            return self.t[self.k - 1][1]
        return None

    def parse(self) -> Node:
        out = self.either()
        if self.k < len(self.t):
            raise SyntaxError(f"unexpected {self.t[self.k][1]!r}")
        return out

    def _left(self, ops: tuple, lower) -> Node:
        a = lower()
        while op := self.take(*ops):
            a = Node("bin", op, (a, lower()))
        return a

    def either(self) -> Node:
        return self._left(("|",), self.both)

    def both(self) -> Node:
        return self._left(("&",), self.compare)

    def compare(self) -> Node:
        first = a = self.join()
        out = None
        while True:
            negated = bool(self.peek() == "^" and self.k + 1 < len(self.t) and self.t[self.k + 1][1].lower() == "in")
            if negated:
                self.k += 1
            if self.k < len(self.t) and self.t[self.k][0] == "name" and self.t[self.k][1].lower() in ("in", "contains", "between", "is"):
                word = self.t[self.k][1].lower()
                self.k += 1
                if word == "in":
                    self.take("(")
                    items = [self.join()]
                    while not self.take(")"):
                        self.take(",")
                        items.append(self.join())
                    one = Node("in", negated, (a, *items))
                elif word == "contains":
                    one = Node("call", "INDEX", (a, self.join()))
                elif word == "between":
                    low = self.join()
                    self.take("&")
                    one = Node("bin", "&", (Node("bin", "<=", (low, a)), Node("bin", "<=", (a, self.join()))))
                else:
                    no = bool(self.take("^"))
                    self.k += 1  # missing or null
                    one = Node("call", "MISSING", (a,))
                    one = Node("un", "^", (one,)) if no else one
                out = one if out is None else Node("bin", "&", (out, one))
                a = out
                continue
            op = self.take("=", "^=", "<", ">", "<=", ">=")
            if not op:
                return out if out is not None else first
            prefix = self.take(":")
            b = self.join()
            one = Node("bin", op, (Node("call", "_PREFIX", (a, b)), Node("call", "_PREFIX", (b, a))) if prefix else (a, b))
            out = one if out is None else Node("bin", "&", (out, one))
            a = b

    def join(self) -> Node:
        return self._left(("||",), self.sum)

    def sum(self) -> Node:
        return self._left(("+", "-"), self.product)

    def product(self) -> Node:
        return self._left(("*", "/"), self.unary)

    def unary(self) -> Node:
        if op := self.take("-", "+", "^"):
            return Node("un", op, (self.unary(),))
        return self.power()

    def power(self) -> Node:
        a = self.atom()
        if self.take("**"):
            return Node("bin", "**", (a, self.unary()))
        while op := self.take("<>", "><"):
            a = Node("call", "MAX" if op == "<>" else "MIN", (a, self.atom()))
        return a

    def atom(self) -> Node:
        if self.take("("):
            a = self.either()
            self.take(")")
            return a
        if self.take("."):
            return Node("missing")
        kind, word = self.t[self.k]
        self.k += 1
        if kind == "num":
            return Node("num", float(word))
        if kind == "str":
            m = re.fullmatch(r"(?s)(['\"])(.*)\1(dt|d|t|n)?", word, re.I)
            body = m[2].replace(m[1] * 2, m[1])
            mark = (m[3] or "").lower()
            if mark == "d":
                return Node("date", datetime.datetime.strptime(body.title(), "%d%b%Y" if len(body) > 7 else "%d%b%y").date())
            if mark == "dt":
                return Node("datetime", datetime.datetime.strptime(body.title(), "%d%b%Y:%H:%M:%S"))
            if mark == "t":
                h, mi, *s = body.split(":")
                return Node("num", float(int(h) * 3600 + int(mi) * 60 + (float(s[0]) if s else 0)))
            return Node("var", body) if mark == "n" else Node("str", body)
        if kind == "op":
            raise SyntaxError(f"unexpected {word!r}")
        if re.fullmatch(r"\$?\w+\.\d*", word) and not word.lower().startswith(("first.", "last.")):
            return Node("str", word)  # a format
        if op := self.take("(", "{", "["):
            close = {"(": ")", "{": "}", "[": "]"}[op]
            args = []
            if self.k < len(self.t) and self.t[self.k][1].lower() == "of":
                self.k += 1
                while not self.take(close):
                    args.append(Node("of", self.t[self.k][1]))
                    self.k += 1
                    if self.take("-"):
                        self.take("-")
                        args[-1] = Node("of", (args[-1].value, self.t[self.k][1]))
                        self.k += 1
                    self.take(",")
            else:
                while not self.take(close):
                    args.append(self.either())
                    self.take(",")
            return Node("call" if op == "(" else "index", word.upper(), tuple(args))
        return Node("var", word)


def parse(text: str) -> Node:
    return Parser(text).parse()


class Scope:
    """What an expression can see: the columns' kinds, arrays of variables, known PRX ids, the format catalog."""

    def __init__(self, kinds: dict[str, str], arrays: dict[str, list[str]] | None = None, constants: dict | None = None, catalog=None, order: list[str] | None = None):
        self.kinds, self.arrays, self.constants, self.catalog = {k.lower(): (k, v) for k, v in kinds.items()}, arrays or {}, constants or {}, catalog
        self.order = order or []

    def column(self, name: str) -> tuple[Column, str]:
        low = name.lower().replace("first.", "first_").replace("last.", "last_")
        if low in self.constants:
            v = self.constants[low]
            return F.lit(v), "c" if isinstance(v, str) else "n"
        if low not in self.kinds:
            return F.lit(None).cast("double"), "n"
        real, kind = self.kinds[low]
        return F.col(f"`{real}`"), "c" if kind == "string" else "d" if kind in ("date", "timestamp", "timestamp_ntz") else "b" if kind == "boolean" else "n"

    def names(self, spec) -> list[str]:
        """Variable lists: a1-a5, a--b, prefix:, _NUMERIC_, _CHARACTER_, _ALL_, array{*}."""
        real = [r for r, _ in self.kinds.values()]
        if isinstance(spec, tuple):
            m, n = re.fullmatch(r"(\D*?)(\d+)", spec[0]), re.fullmatch(r"(\D*?)(\d+)", spec[1])
            if m and n and m[1].lower() == n[1].lower():
                return [f"{m[1]}{k}" for k in range(int(m[2]), int(n[2]) + 1)]
            low = [r.lower() for r in real]
            return real[low.index(spec[0].lower()) : low.index(spec[1].lower()) + 1]
        word = spec.lower().rstrip("*").rstrip("{[(")
        if word in self.arrays:
            return self.arrays[word]
        if word in ("_numeric_", "_character_", "_all_"):
            return [r for r, k in self.kinds.values() if not r.startswith("__") and (word == "_all_" or (k == "string") == (word == "_character_"))]
        return [spec]


def _missing_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def number(c: Column, kind: str) -> Column:
    return F.trim(c).try_cast("double") if kind == "c" else c.cast("int").cast("double") if kind == "b" else c


def text_of(c: Column, kind: str) -> Column:
    if kind == "c":
        return F.coalesce(c, F.lit(""))
    return F.lpad(F.coalesce(formats.best(c), F.lit(".")), 12, " ") if kind in "nb" else _missing_text(c)


def truth(c: Column, kind: str) -> Column:
    if kind == "b":
        return F.coalesce(c, F.lit(False))
    return F.trim(F.coalesce(c, F.lit(""))) != "" if kind == "c" else values.truth(c) if kind == "n" else c.isNotNull()


def compile_(node: Node, scope: Scope) -> tuple[Column, str]:
    """(Column, kind): n number, c character, d date or timestamp, b condition."""
    k = node.kind
    if k == "num":
        v = node.value
        return F.lit(int(v)) if v == int(v) and abs(v) < 2**31 else F.lit(v), "n"
    if k == "str":
        return F.lit(node.value), "c"
    if k in ("date", "datetime"):
        return F.lit(node.value), "d"
    if k == "missing":
        return F.lit(None).cast("double"), "n"
    if k == "var":
        return scope.column(node.value)
    if k == "un":
        c, kind = compile_(node.args[0], scope)
        if node.value == "^":
            return ~truth(c, kind), "b"
        return (-number(c, kind) if node.value == "-" else number(c, kind)), "n"
    if k == "in":
        c, kind = compile_(node.args[0], scope)
        out = F.lit(False)
        for a in node.args[1:]:
            b, other = compile_(a, scope)
            out = out | values.eq(c if kind == "c" else number(c, kind), b if kind == "c" else number(b, other), kind == "c")
        return (~out if node.value else out), "b"
    if k == "bin":
        return _binary(node, scope)
    if k == "index" or (k == "call" and node.value.lower() in scope.arrays):
        cols = scope.arrays[node.value.lower()]
        at = node.args[0]
        if at.kind == "num":
            return scope.column(cols[int(at.value) - 1])
        if at.kind == "var" and at.value.lower() in scope.constants:
            return scope.column(cols[int(scope.constants[at.value.lower()]) - 1])
        c, kind = compile_(at, scope)
        return F.try_element_at(F.array(*[scope.column(n)[0] for n in cols]), number(c, kind).cast("int")), scope.column(cols[0])[1]
    if k == "call":
        return _call(node, scope)
    raise SyntaxError(f"can't use {k}")


def _binary(node: Node, scope: Scope) -> tuple[Column, str]:
    (a, ka), (b, kb) = (compile_(x, scope) for x in node.args)
    op = node.value
    if op in ("&", "|"):
        a, b = truth(a, ka), truth(b, kb)
        return (a & b if op == "&" else a | b), "b"
    if op == "||":
        return F.concat(text_of(a, ka), text_of(b, kb)), "c"
    if op in ("=", "^=", "<", ">", "<=", ">="):
        both = ka == "c" and kb == "c"
        if ka == "d" and kb == "n" or ka == "n" and kb == "d":
            a, b = (values.date_number(x) if kind == "d" else x for x, kind in ((a, ka), (b, kb)))
        elif not both and "d" not in (ka, kb):
            a, b = number(a, ka), number(b, kb)
        if both:
            a, b = _missing_text(a), _missing_text(b)
        fn = {"=": values.eq, "^=": values.ne, "<": values.lt, ">": values.gt, "<=": values.le, ">=": values.ge}[op]
        return fn(a, b, both), "b"
    if ka == "d" and kb == "n" and op in "+-":
        return F.date_add(a, (b if op == "+" else -b).cast("int")), "d"
    if ka == "d" and kb == "d" and op == "-":
        return F.datediff(a, b), "n"
    a, b = number(a, ka), number(b, kb)
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: values.divide(a, b), "**": lambda: values.power(a, b)}[op](), "n"


def _call(node: Node, scope: Scope) -> tuple[Column, str]:
    name = node.value
    args = [Node("var", n) for a in node.args for n in scope.names(a.value)] if node.args and node.args[0].kind == "of" else list(node.args)
    if m := re.fullmatch(r"(LAG|DIF)(\d*)", name):
        from pyspark.sql import Window

        c, kind = compile_(args[0], scope)
        w = Window.orderBy(*scope.order)
        before = F.lag(c, int(m[2] or 1)).over(w)
        return (before, kind) if m[1] == "LAG" else (c - before, "n")
    if name == "DIM":
        return F.lit(len(scope.arrays[args[0].value.lower()])), "n"
    if name == "SYMGET":
        return F.lit(scope.constants.get("&" + str(args[0].value).upper(), "")), "c"
    if name not in FUNCTIONS:
        raise NameError(f"the function {name} is unknown")
    fixed = CONSTANT.get(name, set())
    built, kinds = [], []
    for n, a in enumerate(args):
        if n in fixed:
            v = a.value if a.kind in ("num", "str") else -args[n].args[0].value if a.kind == "un" else scope.constants.get(str(a.value).lower(), a.value)
            built.append(int(v) if isinstance(v, float) and v == int(v) else v)
            kinds.append("k")
        else:
            c, kind = compile_(a, scope)
            built.append(c.cast("int") if kind == "b" else c)
            kinds.append(kind)
    if name in ("PUT", "INPUT"):
        built.append(scope.catalog)
    out = call(name, *built)
    if name == "INPUT":
        return out, "c" if str(built[1]).startswith("$") else "d" if formats.split_name(built[1])[0] in ("DATE", "MMDDYY", "DDMMYY", "YYMMDD", "DATETIME", "E8601DA", "B8601DA", "E8601DT") else "n"
    if name in ("TODAY", "DATE", "MDY", "INTNX", "DATEPART", "DATEJUL", "DHMS", "DATETIME"):
        return out, "d"
    if name in TEXT or (name == "COALESCE" and kinds[0] == "c"):
        return out, "c"
    if name in ("MIN", "MAX", "COALESCE") and kinds[0] == "d":
        return (F.least if name == "MIN" else F.greatest if name == "MAX" else F.coalesce)(*built), "d"
    return out, "n"
