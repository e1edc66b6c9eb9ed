"""The SQL dialect over Spark SQL: a text rewrite of what Spark doesn't have, then Catalyst does the rest.

Rewritten: CALCULATED alias, CONTAINS, SOUNDS LIKE (=*), IS [NOT] MISSING, comparisons with the missing literal `.`,
EQ/NE/GT/LT/GE/LE and ^=, `**`, and set operators without ALL. Spark SQL's own functions and windows are available.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

_STRINGS = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"")
_WORDS = {"eq": "=", "ne": "<>", "gt": ">", "lt": "<", "ge": ">=", "le": "<="}


def rewrite(sql: str) -> str:
    """The statement in Spark SQL. String literals are left alone."""
    kept: list[str] = []

    def hide(m: re.Match) -> str:
        text = m.group(0)
        kept.append("'" + text[1:-1].replace('""', '"').replace("\\", "\\\\").replace("''", "\\'") + "'" if text[0] == "'" else "'" + text[1:-1].replace('""', '"').replace("'", "\\'") + "'")
        return f" \x01{len(kept) - 1}\x01 "

    s = _STRINGS.sub(hide, sql)
    s = re.sub(r"(?i)\b(\w+(?:\.\w+)?)\s+is\s+(not\s+)?missing\b", lambda m: f"({m[1]} is {m[2] or ''}null)", s)
    s = re.sub(r"(\w+(?:\.\w+)?)\s*(?:\^=|<>|(?i:\bne\b))\s*\.(?![\w.])", r"(\1 is not null)", s)
    s = re.sub(r"(\w+(?:\.\w+)?)\s*(?:=|(?i:\beq\b))\s*\.(?![\w.])", r"(\1 is null)", s)
    s = re.sub(r"\^=|~=", "<>", s)
    s = re.sub(r"(?i)\b(eq|ne|gt|lt|ge|le)\b(?=\s)", lambda m: _WORDS[m[1].lower()], s)
    operand = r"(\w+(?:\.\w+)?(?:\([^()]*\))?|\x01\d+\x01)"
    s = re.sub(rf"(?i){operand}\s+(not\s+)?contains\s+{operand}", lambda m: f"({m[2] or ''}(length({m[3]}) > 0 and contains({m[1]}, {m[3]})))", s)
    s = re.sub(rf"(?i){operand}\s+(not\s+)?(?:sounds\s+like|=\*)\s*{operand}", lambda m: f"({m[2] or ''}step_soundex({m[1]}) = step_soundex({m[3]}))", s)
    s = re.sub(rf"{operand}\s*\*\*\s*{operand}", r"pow(\1, \2)", s)
    s = _calculated(s)
    for name, show in _SPELLED.items():
        s = _calls(s, name, show)
    return re.sub(r" ?\x01(\d+)\x01 ?", lambda m: " " + kept[int(m[1])] + " ", s)


def _calls(s: str, name: str, show) -> str:
    """Calls of a function replaced by show(its arguments); None leaves one alone."""
    for m in reversed(list(re.finditer(rf"(?i)(?<![\w.]){name}\s*\(", s))):
        depth, end = 1, m.end()
        while end < len(s) and depth:
            depth += (s[end] == "(") - (s[end] == ")")
            end += 1
        new = show([x.strip() for x in _select_items(s[m.end() : end - 1])])
        if new is not None:
            s = s[: m.start()] + new + s[end:]
    return s


def _rounded(args: list[str]) -> str | None:
    """ROUND to a fractional unit, such as round(x, 0.01): the nearest multiple of the unit."""
    if len(args) != 2 or not re.fullmatch(r"0?\.\d+", args[1]):
        return None
    return f"(round(({args[0]}) / {args[1]}D, 0) / {round(1 / float(args[1]), 9)!r}D)"


#: Calls that Spark spells in another way; one argument each but for ROUND.
_SPELLED = {
    "round": _rounded,
    "var": lambda a: f"var_samp({a[0]})" if len(a) == 1 else None,
    "range": lambda a: f"(max({a[0]}) - min({a[0]}))" if len(a) == 1 else None,
    "nmiss": lambda a: f"count_if(({a[0]}) is null)" if len(a) == 1 else None,
    "css": lambda a: f"(regr_sxx({a[0]}, {a[0]}))" if len(a) == 1 else None,
    "uss": lambda a: f"sum(({a[0]}) * ({a[0]}))" if len(a) == 1 else None,
}


def _select_items(text: str) -> list[str]:
    out, depth, now = [], 0, ""
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(now)
            now = ""
        else:
            now += c
    return [*out, now]


def _calculated(s: str) -> str:
    """CALCULATED alias becomes the alias's expression, wherever it stands."""
    if not re.search(r"(?i)\bcalculated\s+\w+", s):
        return s
    head = re.search(r"(?is)\bselect\s+(?:distinct\s+)?(.*?)\bfrom\b", s)
    named = {}
    for item in _select_items(head[1]) if head else []:
        m = re.fullmatch(r"(?is)\s*(.*?)\s+as\s+(\w+)\s*", item)
        if m:
            named[m[2].lower()] = m[1]
    for _ in range(20):
        m = re.search(r"(?i)\bcalculated\s+(\w+)", s)
        if not m:
            return s
        if m[1].lower() not in named:
            raise ValueError(f"CALCULATED {m[1]} names no alias")
        s = s[: m.start()] + f"({named[m[1].lower()]})" + s[m.end() :]
    raise ValueError("CALCULATED aliases refer to each other")


def register(spark: SparkSession) -> None:
    """The dialect's own functions, as SQL expressions (no Python on the executors)."""
    spark.sql(
        r"""CREATE OR REPLACE TEMPORARY FUNCTION step_soundex(x STRING) RETURNS STRING RETURN
        CASE WHEN regexp_replace(upper(coalesce(x, '')), '[^A-Z]', '') = '' THEN '0000' ELSE
        rpad(concat(substring(regexp_replace(upper(x), '[^A-Z]', ''), 1, 1), substring(translate(regexp_replace(translate(translate(
        substring(regexp_replace(upper(x), '[^A-Z]', ''), 2), 'HW', ''), 'AEIOUYBFPVCGJKQSXZDTLMNR', '000000111122222222334556'),
        '(.)\\1+', '$1'), '0', ''), 1, 3)), 4, '0') END"""
    )


def run_sql(spark: SparkSession, tables: dict[str, DataFrame], sql: str) -> DataFrame:
    """A query of the dialect over named DataFrames; views get private names, so calls don't disturb each other."""
    register(spark)
    text = rewrite(sql)
    for name, df in tables.items():
        view = f"v_{uuid.uuid4().hex[:12]}_{name}"
        df.createOrReplaceTempView(view)
        text = re.sub(rf"(?i)(\b(?:from|join)\s+|,\s*){name}\b(?!\s*\.)", lambda m, v=view, n=name: m[1] + v + ("" if re.match(r"(?i)\s*(?:as\s+)?(?!where\b|on\b|join\b|left\b|right\b|full\b|inner\b|cross\b|group\b|order\b|having\b|union\b|except\b|intersect\b|limit\b|\)|,|$|;)\w+", m.string[m.end() :]) else f" {n}"), text)
    return spark.sql(text)
