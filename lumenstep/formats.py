"""Display formats and informats as Column expressions, and a catalog of user formats.

`put(x, "COMMA12.2")` gives text, `read(s, "DATE9.")` a value. User formats (VALUE, INVALUE, PICTURE) live in a Catalog,
become CASE chains, and for many ranges a range table for a broadcast-bounded join (`Catalog.range_table`).
"""

from __future__ import annotations

import json
import re
import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "."


def split_name(fmt: str) -> tuple[str, int | None, int]:
    """(name, width, decimals) of a format such as DOLLAR12.2, $CHAR8. or 8.2."""
    m = re.fullmatch(r"(\$?[A-Za-z_]*(?:8601[A-Z]{2}|[A-Za-z_](?=\d*\.))?)(\d*)\.?(\d*)", fmt.strip().upper())
    if not m:
        raise ValueError(f"{fmt} is no format")
    name, w, d = m.groups()
    return name, int(w) if w else None, int(d) if d else 0


def _fixed(x: Column, d: int) -> Column:
    """x rounded half away from zero with d decimals, without separators."""
    return F.replace(F.format_number(F.round(x, d), d), F.lit(","), F.lit("")) if d else F.format_string("%d", F.round(x).cast("long"))


def _plain(x: Column, d: int) -> Column:
    """w.d: rounded half away from zero in binary arithmetic, as SQL's ROUND; a negative value that rounds to zero keeps its
    sign."""
    if not d:
        return _fixed(x, d)
    x = x.cast("double")
    r = F.when(F.abs(x) < 10.0 ** (15 - d), F.signum(x) * F.floor(F.abs(x) * 10.0**d + 0.5) / 10.0**d).otherwise(x)
    return F.replace(F.format_number(r, d), F.lit(","), F.lit(""))


def _scientific(x: Column, d: int) -> Column:
    """E-notation with d decimals of the value itself: its shortest decimal text may lie on the other side of a tie."""
    x = x.cast("double")
    places = F.greatest(F.lit(0), d - F.floor(F.log10(F.abs(x)))).cast("int")
    near = F.replace(F.call_function("format_number", x, places), F.lit(","), F.lit("")).cast("double")
    return F.format_string(f"%.{d}E", F.when((F.abs(x) >= 1e-9) & (F.abs(x) < 1e15), near).otherwise(x))


def _right(s: Column, w: int | None) -> Column:
    return s if w is None else F.when(F.length(s) <= w, F.lpad(s, w, " ")).when(s.isNotNull(), F.repeat(F.lit("*"), F.lit(w)))


def best(x: Column, w: int = 12) -> Column:
    """The most precise plain text that fits in w places; E-notation if none does."""
    x = x.cast("double")
    whole = F.when(F.abs(x) < 1e15, x.cast("decimal(38,0)").cast("string"))
    out = F.when((x == F.floor(x)) & (F.length(whole) <= w), whole)
    for d in range(min(w - 2, 14), 0, -1):
        plain = F.regexp_replace(F.regexp_replace(_fixed(x, d), "0+$", ""), r"\.$", "")
        plain = F.regexp_replace(plain, r"^(-?)0\.", "$1.") if w < 3 else plain
        out = out.when((F.abs(x) < 1e15) & (F.length(plain) <= w) & ((F.abs(x) >= 10 ** -min(d, 4)) | (x == 0)), plain)
    sig = max(1, w - 7)
    return F.when(x.isNotNull(), out.otherwise(F.regexp_replace(F.format_string(f"%.{sig}E", x), r"\.?0*E\+?0*(\d|-)", "E$1")))


def _signed(x: Column, body: Column, prefix: str = "") -> Column:
    return F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), F.lit(prefix), body)


def _comma(x: Column, d: int) -> Column:
    return F.format_number(F.abs(x.cast("double")), d)  # rounds the value itself, not its shortest decimal text


def _swap(s: Column) -> Column:
    return F.translate(s, ",.", ".,")


_ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))
_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = ("", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")


def roman(x: Column) -> Column:
    n = F.floor(x).cast("int")
    out = F.lit("")
    for value, mark in _ROMAN:
        out, n = F.concat(out, F.repeat(F.lit(mark), F.floor(n / value).cast("int"))), n % value
    return F.when(x.between(1, 3999), out)


def _div(n: Column, size: int) -> Column:
    """The whole part of n / size, in 64-bit arithmetic."""
    return F.call_function("div", n, F.lit(size).cast("long"))


def words(x: Column) -> Column:
    """English words of a whole number of at most 64 bits."""
    n = F.floor(F.abs(x)).cast("long")
    at = lambda items, k: F.element_at(F.array(*[F.lit(i) for i in items]), k + 1)

    def under_hundred(k: Column) -> Column:
        tens = F.concat(at(_TENS, F.floor(k / 10).cast("int")), F.when(k % 10 > 0, F.concat(F.lit("-"), at(_ONES, k % 10))).otherwise(""))
        return F.when(k < 20, at(_ONES, F.least(k, F.lit(19)))).otherwise(tens)

    def under_thousand(k: Column) -> Column:
        h = F.floor(k / 100).cast("int")
        return F.when(k >= 100, F.concat(at(_ONES, h), F.lit(" hundred"), F.when(k % 100 > 0, F.concat(F.lit(" "), under_hundred(k % 100))).otherwise(""))).otherwise(under_hundred(k))

    parts = []
    scales = ("", " thousand", " million", " billion", " trillion", " quadrillion", " quintillion")
    for power, name in reversed(list(enumerate(scales))):
        k = (_div(n, 1000**power) % 1000).cast("int")
        parts.append(F.when(k > 0, F.concat(under_thousand(k), F.lit(name))))
    return F.concat(F.when(x < 0, "minus ").otherwise(""), F.when(n == 0, "zero").otherwise(F.concat_ws(" ", *parts)))


def fract(x: Column, most: int = 100) -> Column:
    """The nearest fraction with the smallest denominator up to most."""
    a = F.abs(x)
    whole = F.floor(a)
    part = a - whole
    best_one = F.lit(None).cast("struct<err:double,den:int>")
    steps = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda d: F.struct(F.round(F.abs(part - F.round(part * d) / d), 12).alias("err"), d.alias("den")))
    best_one = F.array_min(steps)
    num, den = F.round(part * best_one["den"]).cast("int"), best_one["den"]
    text = F.when(num == 0, whole.cast("string")).when(num == den, (whole + 1).cast("string"))
    fr = F.concat(num.cast("string"), F.lit("/"), den.cast("string"))
    return F.concat(F.when(x < 0, "-").otherwise(""), text.when(whole > 0, F.concat(whole.cast("string"), F.lit("+"), fr)).otherwise(fr))


def _time(seconds: Column, d: int = 0) -> Column:
    s = F.abs(seconds)
    tail = F.lpad(_fixed(s % 60, d), 3 + d if d else 2, "0")
    return F.concat(F.when(seconds < 0, "-").otherwise(""), F.floor(s / 3600).cast("string"), F.lit(":"), F.lpad(F.floor(s % 3600 / 60).cast("string"), 2, "0"), F.lit(":"), tail)


# Numeric formats: (value, width, decimals) -> text.
NUMERIC = {
    "": lambda x, w, d: _right(_plain(x, d), w),
    "F": lambda x, w, d: _right(_plain(x, d), w),
    "BEST": lambda x, w, d: _right(best(x, w or 12), w or 12),
    "COMMA": lambda x, w, d: _right(_signed(x, _comma(x, d)), w),
    "DOLLAR": lambda x, w, d: _right(_signed(x, _comma(x, d), "$"), w),
    "EURO": lambda x, w, d: _right(_signed(x, _comma(x, d), "€"), w),
    "COMMAX": lambda x, w, d: _right(_signed(x, _swap(_comma(x, d))), w),
    "DOLLARX": lambda x, w, d: _right(_signed(x, _swap(_comma(x, d)), "$"), w),
    "EUROX": lambda x, w, d: _right(_signed(x, _swap(_comma(x, d)), "€"), w),
    "Z": lambda x, w, d: F.concat(F.when(x < 0, "-").otherwise(""), F.lpad(_fixed(F.abs(x), d), F.when(x < 0, (w or 8) - 1).otherwise(w or 8), F.lit("0"))),
    "PERCENT": lambda x, w, d: _right(F.concat(_signed(x, _comma(x * 100, d)), F.lit("%")), w),
    "NEGPAREN": lambda x, w, d: _right(F.when(x < 0, F.concat(F.lit("("), _comma(x, d), F.lit(")"))).otherwise(_comma(x, d)), w),
    "E": lambda x, w, d: _right(_scientific(x, max(1, (w or 12) - 7)), w),
    "SCIENTIFIC": lambda x, w, d: _right(_scientific(x, d or 2), w),
    "HEX": lambda x, w, d: F.lpad(F.hex(x.cast("long")), w or 8, "0"),
    "BINARY": lambda x, w, d: F.lpad(F.bin(x.cast("long")), w or 8, "0"),
    "OCTAL": lambda x, w, d: F.lpad(F.conv(x.cast("long").cast("string"), 10, 8), w or 3, "0"),
    "ROMAN": lambda x, w, d: _right(roman(x), w),
    "WORDS": lambda x, w, d: words(x),
    "FRACT": lambda x, w, d: _right(fract(x), w),
    "TIME": lambda x, w, d: _right(_time(x, d), w),
}
_date = lambda pattern, upper=False: (lambda x, w, d: F.upper(F.date_format(x, pattern)) if upper else F.date_format(x, pattern))


def _sized(default: int, patterns: dict[int, str], upper: bool = False):
    """The pattern of the largest width that isn't over the asked one."""

    def show(x, w, d):
        w = w or default
        pattern = patterns[max(k for k in patterns if k <= max(w, min(patterns)))]
        out = F.date_format(x, pattern)
        return F.upper(out) if upper else out

    return show


# Date and time formats, over dates and timestamps.
DATES = {
    "DATE": _sized(7, {5: "ddMMM", 7: "ddMMMyy", 9: "ddMMMyyyy", 11: "dd-MMM-yyyy"}, True),
    "DDMMYY": _sized(8, {6: "ddMMyy", 8: "dd/MM/yy", 10: "dd/MM/yyyy"}),
    "MMDDYY": _sized(8, {6: "MMddyy", 8: "MM/dd/yy", 10: "MM/dd/yyyy"}),
    "YYMMDD": _sized(8, {6: "yyMMdd", 8: "yy-MM-dd", 10: "yyyy-MM-dd"}),
    "MONYY": _sized(5, {5: "MMMyy", 7: "MMMyyyy"}, True),
    "WORDDATE": _date("MMMM d, yyyy"),
    "WEEKDATE": _date("EEEE, MMMM d, yyyy"),
    "DOWNAME": _date("EEEE"),
    "MONNAME": _date("MMMM"),
    "MONTH": _date("M"),
    "YEAR": _date("yyyy"),
    "DAY": _date("d"),
    "QTR": lambda x, w, d: F.quarter(x).cast("string"),
    "QTRR": lambda x, w, d: F.element_at(F.array(*[F.lit(q) for q in ("I", "II", "III", "IV")]), F.quarter(x)),
    "YYQ": lambda x, w, d: F.concat(F.date_format(x, "yyyy"), F.lit("Q"), F.quarter(x).cast("string")),
    "JULIAN": lambda x, w, d: F.date_format(x, "yyyyDDD" if (w or 5) >= 7 else "yyDDD"),
    "DATETIME": _sized(16, {7: "ddMMMyy", 16: "ddMMMyy:HH:mm:ss", 18: "ddMMMyyyy:HH:mm:ss"}, True),
    "B8601DA": _date("yyyyMMdd"),
    "B8601DT": _date("yyyyMMdd'T'HHmmss"),
    "B8601TM": _date("HHmmss"),
    "E8601DA": _date("yyyy-MM-dd"),
    "E8601DT": _date("yyyy-MM-dd'T'HH:mm:ss"),
    "E8601TM": _date("HH:mm:ss"),
}
# Character formats.
CHARACTER = {
    "$": lambda x, w, d: F.rpad(F.substring(x, 1, w), w, " ") if w else x,
    "$QUOTE": lambda x, w, d: F.concat(F.lit('"'), F.rtrim(x), F.lit('"')),
    "$HEX": lambda x, w, d: F.hex(x) if not w else F.substring(F.hex(x), 1, w),
    "$UPCASE": lambda x, w, d: F.upper(F.substring(x, 1, w) if w else x),
}
CHARACTER["$CHAR"] = CHARACTER["$F"] = CHARACTER["$"]


def put(x: Column, fmt: str, catalog: Catalog | None = None) -> Column:
    """The text of x under a format: user formats first, then the built-in ones, then BEST."""
    name, w, d = split_name(fmt)
    if catalog is not None and (own := catalog.find(name)) is not None:
        return own.show(x, w)
    if name.startswith("$"):
        return CHARACTER.get(name, CHARACTER["$"])(F.coalesce(x.cast("string"), F.lit("")), w, d)
    if name in DATES:
        return F.coalesce(DATES[name](x, w, d), F.lit(MISSING))
    if name not in NUMERIC:
        warnings.warn(f"the format {name} is unknown; BEST is used", stacklevel=2)
    show = NUMERIC.get(name, NUMERIC["BEST"])
    return F.coalesce(show(x.cast("double"), w, d), _right(F.lit(MISSING), w))


def _parsed(s: Column, *patterns: str) -> Column:
    return F.coalesce(*[F.to_date(F.try_to_timestamp(s, F.lit(p))) for p in patterns])


def read(s: Column, informat: str, catalog: Catalog | None = None) -> Column:
    """The value that an informat reads; text it can't read is missing."""
    name, w, d = split_name(informat)
    s = s.cast("string")
    if catalog is not None and (own := catalog.find(name, informat=True)) is not None:
        return own.show(s, None)
    if name in ("$CHAR",):
        return F.substring(s, 1, w) if w else s
    if name.startswith("$"):
        t = F.substring(s, 1, w) if w else s
        return F.upper(t) if name == "$UPCASE" else F.ltrim(F.rtrim(t))
    t = F.trim(F.substring(s, 1, w) if w else s)
    if name in ("COMMA", "DOLLAR", "EURO", "COMMAX", "DOLLARX", "NUMX"):
        t = F.regexp_replace(t, r"^\((.*)\)$", "-$1")
        t = F.translate(F.translate(t, "$€ .", ""), ",", ".") if name.endswith("X") else F.translate(t, "$,€ ", "")
        name = ""
    if name == "PERCENT":
        return F.translate(t, "%,", "").try_cast("double") / F.when(t.endswith("%"), 100).otherwise(1)
    if name in ("", "F", "BEST"):
        value = t.try_cast("double")
        return F.when(t.contains("."), value).otherwise(value / 10**d) if d else value
    if name == "HEX":
        return F.when(t.rlike("^[0-9A-Fa-f]+$"), F.conv(t, 16, 10).cast("double"))
    if name == "DATE":
        t = F.initcap(F.lower(F.regexp_replace(t, "[-/ ]", "")))
        t = F.regexp_replace(t, r"^(\d)(?=\D)", "0$1")
        t = F.concat(F.substring(t, 1, 2), F.initcap(F.substring(t, 3, 3)), F.substring(t, 6, 4))
        return F.when(F.length(t) == 9, _parsed(t, "ddMMMyyyy")).otherwise(_parsed(t, "ddMMMyy"))
    if name in ("MMDDYY", "DDMMYY", "YYMMDD"):
        sep = F.regexp_replace(t, "[-/. ]", "")
        order = {"MMDDYY": "MMdd{y}", "DDMMYY": "ddMM{y}", "YYMMDD": "{y}MMdd"}[name]
        return F.when(F.length(sep) == 8, _parsed(sep, order.format(y="yyyy"))).otherwise(_parsed(sep, order.format(y="yy")))
    if name in ("E8601DA", "B8601DA"):
        return _parsed(t, "yyyy-MM-dd" if name[0] == "E" else "yyyyMMdd")
    if name in ("DATETIME", "E8601DT"):
        return F.try_to_timestamp(t if name[0] == "E" else F.concat(F.initcap(F.lower(F.substring(t, 1, 5))), F.substring(t, 6, 30)), F.lit("yyyy-MM-dd'T'HH:mm:ss" if name[0] == "E" else "ddMMMyyyy:HH:mm:ss"))
    if name == "TIME":
        p = F.split(t, ":")
        part = lambda k: F.coalesce(F.try_element_at(p, F.lit(k)).try_cast("double"), F.lit(0.0))
        return F.when(t.rlike(r"^\d+(:\d+){1,2}(\.\d+)?$"), part(1) * 3600 + part(2) * 60 + part(3))
    raise ValueError(f"the informat {informat} is unknown")


@dataclass
class Range:
    """low to high, with bounds that may be left out; None is the end of the order."""

    low: object
    high: object
    label: object
    open_low: bool = False
    open_high: bool = False

    def holds(self, x: Column, fuzz: float = 0.0) -> Column:
        out = F.lit(True)
        if self.low is not None and self.low == self.high and not fuzz:
            return x == self.low
        if self.low is not None:
            out = out & ((x > self.low) if self.open_low else (x >= self.low - fuzz if fuzz else x >= self.low))
        if self.high is not None:
            out = out & ((x < self.high) if self.open_high else (x <= self.high + fuzz if fuzz else x <= self.high))
        return x.isNotNull() & out


@dataclass
class UserFormat:
    """VALUE (numeric or character), INVALUE or PICTURE."""

    name: str
    ranges: list[Range]
    other: object = None
    missing: object = None
    kind: str = "VALUE"
    fuzz: float = 1e-12
    default: int | None = None
    least: int | None = None
    most: int | None = None
    options: dict = field(default_factory=dict)

    def show(self, x: Column, w: int | None) -> Column:
        char = self.name.startswith("$")
        x = F.rtrim(x) if char or self.kind == "INVALUE" else x.cast("double")
        if self.kind == "PICTURE":
            return self._picture(x)
        out = None
        for r in self.ranges:
            label = x if r.label == "_SAME_" else F.lit(r.label)
            fits = r.holds(x, 0.0 if char or self.kind == "INVALUE" else self.fuzz)
            out = F.when(fits, label) if out is None else out.when(fits, label)
        if self.missing is not None:
            fits = x.isNull() | (x.cast("string") == "")
            out = F.when(fits, F.lit(self.missing)) if out is None else out.when(fits, F.lit(self.missing))
        if self.kind == "INVALUE":
            other = F.lit(None) if self.other is None else x.try_cast("double") if self.other == "_SAME_" else F.lit(self.other)
        else:
            plain = x if char else best(x)
            other = F.when(x.isNull(), F.lit("" if char else MISSING)).otherwise(F.lit(self.other) if self.other is not None else plain)
        out = other if out is None else out.otherwise(other)
        w = min(w or self.default or 0, self.most or 1 << 30) if (w or self.default) else None
        return F.substring(out, 1, max(w, self.least or 0)) if w and self.kind == "VALUE" else out

    def _picture(self, x: Column) -> Column:
        """Digit selectors: 9 prints zeros, other digits suppress leading ones; PREFIX, MULT and FILL apply."""
        out = None
        for r in self.ranges:
            opts = {**self.options, **(r.label[1] if isinstance(r.label, tuple) else {})}
            picture = r.label[0] if isinstance(r.label, tuple) else r.label
            slots = sum(c.isdigit() for c in picture)
            if not slots:
                shown = F.lit(picture)
            else:
                decimals = len(re.sub(r"\D", "", picture.partition(".")[2])) if "." in picture else 0
                mult = opts.get("mult", 10**decimals)
                digits = F.lpad(F.floor(F.abs(x) * mult + 1e-9).cast("long").cast("string"), slots, "0")
                shown, seen, k = F.lit(""), F.lit(False), 0
                fill = opts.get("fill", " ")
                for c in picture:
                    if c.isdigit():
                        k += 1
                        d = F.substring(digits, k, 1)
                        seen = seen | (d != "0") | F.lit(c == "9")
                        shown = F.concat(shown, F.when(seen, d).otherwise(F.lit("\0")))
                    else:
                        shown = F.concat(shown, F.when(seen, F.lit(c)).otherwise(F.lit("\0")) if k < slots else F.lit(c))
                body = F.replace(shown, F.lit("\0"), F.lit(""))
                shown = F.lpad(F.concat(F.lit(opts.get("prefix", "")), body), len(picture), fill)
            fits = r.holds(x)
            out = F.when(fits, shown) if out is None else out.when(fits, shown)
        return F.coalesce(out if out is not None else F.lit(None).cast("string"), best(x), F.lit(MISSING))


class Catalog:
    """User formats by name, with a search order over parents (FMTSEARCH)."""

    def __init__(self, *search: Catalog):
        self.formats: dict[tuple[str, bool], UserFormat] = {}
        self.search = list(search)

    def value(self, name: str, ranges, other=None, missing=None, kind: str = "VALUE", **options) -> UserFormat:
        """ranges: (low, high, label) or (value, label) tuples, or Range objects; None is LOW or HIGH."""
        rows = [r if isinstance(r, Range) else Range(r[0], r[0], r[1]) if len(r) == 2 else Range(r[0], r[1], r[2], *r[3:]) for r in ranges]
        extra = {k: options.pop(k) for k in ("fuzz", "default", "least", "most") if k in options}
        own = UserFormat(name.upper(), rows, other, missing, kind, options=options, **extra)
        self.formats[name.upper(), kind == "INVALUE"] = own
        return own

    def find(self, name: str, informat: bool = False) -> UserFormat | None:
        own = self.formats.get((name.upper(), informat))
        for c in () if own else self.search:
            own = own or c.find(name, informat)
        return own

    def delete(self, name: str, informat: bool = False) -> None:
        self.formats.pop((name.upper(), informat), None)

    def contents(self) -> list[tuple]:
        """(name, kind, number of ranges): the catalog listing."""
        return [(f.name, f.kind, len(f.ranges)) for _, f in sorted(self.formats.items())]

    def control_rows(self) -> list[tuple]:
        """CNTLOUT=: (fmtname, kind, start, end, sexcl, eexcl, label, hlo)."""
        rows = []
        for f in self.formats.values():
            for r in f.ranges:
                hlo = ("L" if r.low is None else "") + ("H" if r.high is None else "")
                rows.append((f.name, f.kind, str(r.low), str(r.high), "Y" if r.open_low else "N", "Y" if r.open_high else "N", str(r.label), hlo))
            if f.other is not None:
                rows.append((f.name, f.kind, "", "", "N", "N", str(f.other), "O"))
        return rows

    def control_table(self, spark):
        return spark.createDataFrame(self.control_rows(), "fmtname string, kind string, start string, end string, sexcl string, eexcl string, label string, hlo string")

    def load_control(self, rows) -> None:
        """CNTLIN=: the rows of a control table (a bounded catalog, read on the driver)."""
        grouped: dict[tuple[str, str], list] = {}
        for r in rows:
            grouped.setdefault((r["fmtname"], r["kind"]), []).append(r)
        for (name, kind), own in grouped.items():
            value = (lambda s: s) if name.startswith("$") or kind == "INVALUE" else float
            ranges = [Range(None if "L" in r["hlo"] else value(r["start"]), None if "H" in r["hlo"] else value(r["end"]), r["label"], r["sexcl"] == "Y", r["eexcl"] == "Y") for r in own if "O" not in r["hlo"]]
            self.value(name, ranges, next((r["label"] for r in own if "O" in r["hlo"]), None), kind=kind)

    def range_table(self, spark, name: str):
        """(low, high, open_low, open_high, label) of a numeric format, for a range join."""
        rows = [(None if r.low is None else float(r.low), None if r.high is None else float(r.high), r.open_low, r.open_high, str(r.label)) for r in self.find(name).ranges]
        return spark.createDataFrame(rows, "low double, high double, open_low boolean, open_high boolean, label string")

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump({"rows": self.control_rows()}, f)

    def load(self, path: str) -> None:
        names = ("fmtname", "kind", "start", "end", "sexcl", "eexcl", "label", "hlo")
        with open(path) as f:
            self.load_control([dict(zip(names, r, strict=True)) for r in json.load(f)["rows"]])
