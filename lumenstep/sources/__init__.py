"""Text sources and sinks: IMPORT and EXPORT, and record reading with INPUT styles."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import formats

DELIMITERS = {"CSV": ",", "TAB": "\t", "DLM": " "}


def import_file(spark: SparkSession, path: str, dbms: str = "CSV", getnames: bool = True, delimiter: str | None = None, schema: str | None = None) -> DataFrame:
    """IMPORT: names from the first line, or VAR1, VAR2, ...; types are inferred unless a schema is given."""
    reader = spark.read.option("sep", delimiter or DELIMITERS[dbms.upper()]).option("header", getnames)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return df if getnames or schema else df.toDF(*[f"VAR{k + 1}" for k in range(len(df.columns))])


def export_file(df: DataFrame, path: str, dbms: str = "CSV", delimiter: str | None = None, single: bool = False) -> None:
    """EXPORT with a header line; one file only on request, as it takes one task."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).option("sep", delimiter or DELIMITERS[dbms.upper()]).csv(path)


@dataclass
class Field:
    """One variable of an INPUT statement: list (no columns), column (start to end), or formatted (at start)."""

    name: str
    informat: str = "12."
    start: int | None = None
    end: int | None = None
    modified: bool = False

    @property
    def char(self) -> bool:
        return self.informat.startswith("$")


def parse_input(text: str) -> list[Field]:
    """Fields of an INPUT statement: `name $ age`, `name $ 1-8`, `@10 d date9.`, `x : comma8.`, `+3`."""
    tokens = re.findall(r"@\d+|\+\d+|\d+\s*-\s*\d+|\$?[A-Za-z_]\w*\d*\.\d*|\$?\d+\.\d*|[A-Za-z_]\w*|\$|:|&", text)
    out: list[Field] = []
    at: int | None = None
    for tok in tokens:
        if tok.startswith("@"):
            at = int(tok[1:])
        elif tok.startswith("+"):
            at = (at or 1) + int(tok[1:])
        elif re.fullmatch(r"\d+\s*-\s*\d+", tok):
            a, b = map(int, re.split(r"\s*-\s*", tok))
            out[-1].start, out[-1].end, at = a, b, b + 1
        elif tok == "$":
            out[-1].informat = "$"
        elif tok in (":", "&"):
            out[-1].modified = True
        elif "." in tok:
            f = out[-1]
            f.informat = tok
            if not f.modified:
                f.start = at or 1
                width = formats.split_name(tok)[1] or 8
                f.end = f.start + width - 1
                at = f.end + 1
        else:
            out.append(Field(tok))
            if at is not None and at != 1:
                out[-1].start = None
    return out


def _value(text: Column, f: Field) -> Column:
    return formats.read(text, f.informat if f.informat != "$" else "$CHAR200.")


def read_records(lines: DataFrame, fields: Sequence[Field] | str, dlm: str = " ", dsd: bool = False, mode: str = "MISSOVER", column: str = "value") -> DataFrame:
    """INPUT over lines of text: list, column and formatted styles; DLM, DSD, MISSOVER, TRUNCOVER and STOPOVER."""
    fields = parse_input(fields) if isinstance(fields, str) else list(fields)
    line = F.col(column)
    cls = "[" + re.escape(dlm) + "]"
    if dsd:
        sep = "," if dlm == " " else dlm
        parts = F.transform(F.split(line, re.escape(sep) + r'(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda p: F.replace(F.regexp_replace(F.trim(p), r'^"(.*)"$', "$1"), F.lit('""'), F.lit('"')))
    else:
        parts = F.filter(F.split(line, cls + "+"), lambda p: p != "")
    out, k = {}, 0
    for f in fields:
        if f.start is not None:
            text = F.substring(line, f.start, f.end - f.start + 1)
            if mode == "MISSOVER":
                text = F.when(F.length(line) >= (f.end if not f.char else f.start), text)
        else:
            k += 1
            text = F.try_element_at(parts, F.lit(k))
        if mode == "STOPOVER":
            text = F.coalesce(text, F.raise_error(F.concat(F.lit(f"the record has no value for {f.name}: "), line)))
        out[f.name] = _value(text, f)
    return lines.select(*[c for c in lines.columns if c != column], *[v.alias(n) for n, v in out.items()])


def infile(spark: SparkSession, path: str, firstobs: int = 1, obs: int | None = None) -> DataFrame:
    """Lines of a text file; FIRSTOBS= and OBS= cut by the line's place in one file."""
    if firstobs == 1 and obs is None:
        return spark.read.text(path)
    out = spark.read.text(path, wholetext=False).withColumn("__n", F.monotonically_increasing_id())
    return out.orderBy("__n").offset(firstobs - 1).limit(obs - firstobs + 1 if obs else 1 << 30).drop("__n")


def datalines(spark: SparkSession, text: str) -> DataFrame:
    """Inline records."""
    lines = text.strip("\n").split("\n")
    return spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "_line long, value string")


def held_records(lines: DataFrame, fields: Sequence[Field] | str, dlm: str = " ", column: str = "value") -> DataFrame:
    """INPUT ... @@: several observations on a line."""
    fields = parse_input(fields) if isinstance(fields, str) else list(fields)
    parts = F.filter(F.split(F.col(column), "[" + re.escape(dlm) + "]+"), lambda p: p != "")
    n = len(fields)
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / n).cast("int")), lambda g: F.slice(parts, g * n + 1, n))
    long = lines.select(*[c for c in lines.columns if c != column], F.posexplode(groups).alias("_at", "_g"))
    return long.select(*[c for c in lines.columns if c != column], "_at", *[_value(F.try_element_at("_g", F.lit(k + 1)), f).alias(f.name) for k, f in enumerate(fields)])


def stacked_records(lines: DataFrame, per: Sequence[Sequence[Field] | str], order: str = "_line", dlm: str = " ") -> DataFrame:
    """INPUT a / b: an observation over several consecutive lines, joined by their number."""
    n = len(per)
    numbered = lines.withColumn("_obs", F.floor(F.col(order) / n)).withColumn("_part", F.col(order) % n)
    out = None
    for k, fields in enumerate(per):
        one = read_records(numbered.where(F.col("_part") == k).select("_obs", "value"), fields, dlm)
        out = one if out is None else out.join(one, "_obs", "left")
    return out


def put_lines(df: DataFrame, items: Sequence, name: str = "value") -> DataFrame:
    """FILE / PUT: text lines from literals, (column, format) pairs and @n or +n moves."""
    line: Column = F.lit("")
    for item in items:
        if isinstance(item, tuple):
            line = F.concat(line, F.trim(formats.put(F.col(item[0]), item[1])), F.lit(" "))
        elif isinstance(item, str) and re.fullmatch(r"@\d+", item):
            line = F.rpad(line, int(item[1:]) - 1, " ")
        elif isinstance(item, str) and re.fullmatch(r"\+\d+", item):
            line = F.concat(line, F.lit(" " * int(item[1:])))
        elif isinstance(item, str) and item in df.columns:
            kind = dict(df.dtypes)[item]
            line = F.concat(line, F.coalesce(F.trim(F.col(item)) if kind == "string" else formats.best(F.col(item)) if kind not in ("date", "timestamp", "timestamp_ntz") else F.col(item).cast("string"), F.lit(".")), F.lit(" "))
        else:
            line = F.concat(line, F.lit(item))
    return df.select(F.rtrim(line).alias(name))
