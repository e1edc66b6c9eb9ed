"""Character functions. Missing text is empty text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..values import col
from . import function

#: The default word delimiters of SCAN.
DELIMITERS = " .<>()+&!$*);^-/,%|"


def text(x) -> Column:
    return F.coalesce(col(x).cast("string"), F.lit(""))


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def char_class(chars: str) -> str:
    return "[" + "".join("\\" + c if c in r"\]^-[&~" else c for c in chars) + "]"


function("UPCASE")(lambda x: F.upper(col(x)))
function("LOWCASE")(lambda x: F.lower(col(x)))
function("TRIM", "TRIMN")(lambda x: F.rtrim(text(x)))
function("STRIP")(lambda x: F.trim(text(x)))
function("LEFT")(lambda x: F.ltrim(text(x)))
function("REVERSE")(lambda x: F.reverse(text(x)))
function("LENGTH")(lambda x: F.greatest(F.length(F.rtrim(text(x))), F.lit(1)))
function("LENGTHN")(lambda x: F.length(F.rtrim(text(x))))
function("CAT")(lambda *a: F.concat(*[text(x) for x in a]))
function("CATS", "CATT")(lambda *a: F.concat(*[F.trim(text(x)) for x in a]))
function("REPEAT")(lambda x, n: F.repeat(text(x), lit(n).cast("int")))
function("RANK")(lambda x: F.ascii(F.substring(text(x), 1, 1)))
function("BYTE", "CHAR")(lambda n: F.decode(F.unhex(F.lpad(F.hex(col(n).cast("long")), 8, "0")), "UTF-32"))


@function("SUBSTR", "SUBSTRN")
def substr(x, pos, length=None) -> Column:
    """1-based; a place outside the text gives empty text."""
    s, p = text(x), lit(pos)
    out = F.substring(s, p, lit(length) if length is not None else F.length(s))
    return F.when(p.between(1, F.length(s)), out).otherwise("")


@function("INDEX")
def index(x, needle) -> Column:
    return F.when(F.length(lit(needle)) > 0, F.instr(text(x), lit(needle))).otherwise(0)


@function("FIND")
def find(x, needle, start=1, mods: str = "") -> Column:
    s, n = text(x), lit(needle)
    if "i" in mods.lower():
        s, n = F.lower(s), F.lower(n)
    return F.when(F.length(n) > 0, F.locate(needle if "i" not in mods.lower() else needle.lower(), s, start) if isinstance(needle, str) else F.expr("0")).otherwise(0)


@function("FINDC")
def findc(x, chars: str) -> Column:
    return F.regexp_instr(text(x), F.lit(char_class(chars)))


@function("VERIFY")
def verify(x, chars: str) -> Column:
    return F.regexp_instr(text(x), F.lit("[^" + char_class(chars)[1:]))


@function("COUNT")
def count(x, needle: str, mods: str = "") -> Column:
    """Occurrences that don't overlap."""
    return F.regexp_count(text(x), F.lit(("(?i)" if "i" in mods.lower() else "") + re.escape(needle)))


@function("COUNTC")
def countc(x, chars: str) -> Column:
    return F.length(text(x)) - F.length(F.translate(text(x), chars, ""))


@function("_PREFIX")
def prefix(x, other) -> Column:
    """x cut to the length of other without trailing blanks (one side of the prefix comparisons =: and the like)."""
    return F.substring(text(x), 1, F.greatest(F.lit(1), F.length(F.rtrim(text(other)))))


@function("COMPRESS")
def compress(x, chars: str = " ") -> Column:
    return F.translate(text(x), chars, "")


@function("TRANSLATE")
def translate(x, to: str, frm: str) -> Column:
    return F.translate(text(x), frm, to)


@function("TRANWRD")
def tranwrd(x, frm, to) -> Column:
    return F.replace(text(x), lit(frm), lit(to))


@function("COMPBL")
def compbl(x) -> Column:
    return F.trim(F.regexp_replace(text(x), r"\s+", " "))


@function("PROPCASE")
def propcase(x, delims: str = " ") -> Column:
    if delims == " ":
        return F.initcap(text(x))
    one = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))
    # split keeps each delimiter with the word before it
    return F.array_join(F.transform(F.split(text(x), f"(?<={char_class(delims)})"), one), "")


@function("SCAN")
def scan(x, n, delims: str = DELIMITERS) -> Column:
    """The n-th word, counted from the end if n is negative; empty if there is none."""
    words = F.filter(F.split(text(x), char_class(delims)), lambda w: w != "")
    k = lit(n).cast("int")
    return F.coalesce(F.when(k != 0, F.try_element_at(words, F.when(k != 0, k).otherwise(1))), F.lit(""))


@function("CATX")
def catx(sep: str, *args) -> Column:
    return F.concat_ws(sep, *[F.when(F.trim(text(a)) != "", F.trim(text(a))) for a in args])


@function("CATQ")
def catq(delim: str, *args) -> Column:
    """Items that hold the delimiter or a quote are quoted."""
    quoted = lambda s: F.when(s.contains(delim) | s.contains('"'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)
    return F.concat_ws(delim, *[quoted(F.trim(text(a))) for a in args])


@function("WHICHC", "WHICHN")
def which(needle, *args) -> Column:
    return F.coalesce(F.array_position(F.array(*[col(a) for a in args]), lit(needle)), F.lit(0))


@function("SOUNDEX")
def soundex(x) -> Column:
    """Four-character code in which the first letter never merges with the next; empty text gives 0000."""
    s = F.regexp_replace(F.upper(text(x)), "[^A-Z]", "")
    rest = F.translate(F.substring(s, 2, 1 << 30), "HW", "")
    codes = F.translate(rest, "AEIOUYBFPVCGJKQSXZDTLMNR", "000000111122222222334556")
    merged = F.translate(F.regexp_replace(codes, r"(.)\1+", "$1"), "0", "")
    return F.when(s == "", "0000").otherwise(F.rpad(F.concat(F.substring(s, 1, 1), F.substring(merged, 1, 3)), 4, "0"))
