"""A session: table libraries, the last table, options, titles, macro symbols, dictionary tables and captured results."""

from __future__ import annotations

import re
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .formats import Catalog


class Library:
    """Named tables in one place: Parquet or CSV files under a path (any Hadoop file system), or temp views (WORK)."""

    def __init__(self, spark: SparkSession, path: str | None = None, engine: str = "parquet", read_only: bool = False):
        self.spark, self.path, self.engine = spark, path.rstrip("/") if path else None, engine
        self.read_only = read_only or bool(path and path.startswith(("s3://", "s3a://")))
        if self.path and self.path.startswith("s3://"):
            self.path = "s3a://" + self.path[5:]
        self.tables: dict[str, DataFrame] = {}

    def _file(self, name: str) -> str:
        return f"{self.path}/{name.lower()}.{self.engine}"

    def _fs(self):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def list(self) -> list[str]:
        if self.path is None:
            return sorted(self.tables)
        fs, at = self._fs()
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(n.removesuffix(f".{self.engine}") for n in names if n.endswith(f".{self.engine}"))

    def exists(self, name: str) -> bool:
        return name.lower() in self.list()

    def read(self, name: str) -> DataFrame:
        if self.path is None:
            if name.lower() not in self.tables:
                raise KeyError(f"the table {name} does not exist")
            return self.tables[name.lower()]
        if self.engine == "csv":
            return self.spark.read.csv(self._file(name), header=True, inferSchema=True)
        return self.spark.read.parquet(self._file(name))

    def write(self, name: str, df: DataFrame) -> None:
        """WORK tables stay lazy; files are written beside the old table and then take its place."""
        if self.read_only:
            raise PermissionError("this library can only be read")
        if self.path is None:
            self.tables[name.lower()] = df
            return
        fs, _ = self._fs()
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        new = self._file(name) + ".new"
        writer = df.write.mode("overwrite")
        writer.csv(new, header=True) if self.engine == "csv" else writer.parquet(new)
        fs.delete(path(self._file(name)), True)
        fs.rename(path(new), path(self._file(name)))

    def delete(self, name: str) -> None:
        if self.read_only:
            raise PermissionError("this library can only be read")
        if self.path is None:
            del self.tables[name.lower()]
        else:
            fs, _ = self._fs()
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self._file(name)), True)

    def rename(self, old: str, new: str) -> None:
        if self.read_only:
            raise PermissionError("this library can only be read")
        if self.path is None:
            self.tables[new.lower()] = self.tables.pop(old.lower())
        else:
            fs, _ = self._fs()
            path = self.spark._jvm.org.apache.hadoop.fs.Path
            if not fs.rename(path(self._file(old)), path(self._file(new))):
                raise OSError(f"{old} can't be renamed")

    def copy(self, name: str, to: Library) -> None:
        to.write(name, self.read(name))

    def exchange(self, a: str, b: str) -> None:
        self.rename(a, "__swap")
        self.rename(b, a)
        self.rename("__swap", b)

    def save(self, keep: list[str]) -> None:
        """Deletes all tables but those named."""
        for n in self.list():
            if n not in [k.lower() for k in keep]:
                self.delete(n)


class Session:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.libraries: dict[str, Library] = {"work": Library(spark)}
        self.last: str | None = None
        self.options: dict[str, object] = {"LS": 80, "PS": 60, "OBS": None, "FIRSTOBS": 1, "MISSING": ".", "YEARCUTOFF": 1926, "FMTSEARCH": ["WORK"]}
        self.titles: dict[int, str] = {}
        self.footnotes: dict[int, str] = {}
        self.symbols: dict[str, str] = {}
        self.catalog = Catalog()
        self.captured: dict[str, DataFrame] = {}
        self.selected: set[str] | None = None
        self.excluded: set[str] = set()
        self.queued: list[str] = []
        self.log: list[str] = []

    # tables --------------------------------------------------------------------------------------------------------------
    def libname(self, ref: str, path: str, engine: str = "parquet") -> Library:
        self.libraries[ref.lower()] = Library(self.spark, path, engine)
        return self.libraries[ref.lower()]

    def clear(self, ref: str) -> None:
        self.libraries.pop(ref.lower())

    def _find(self, name: str) -> tuple[Library, str]:
        ref, _, table = name.rpartition(".")
        ref = (ref or "work").lower()
        if ref not in self.libraries:
            raise KeyError(f"the library {ref} is not assigned")
        return self.libraries[ref], table.lower()

    def table(self, name: str | None = None) -> DataFrame:
        """A table by [library.]name; without a name the last one written."""
        if name is None or name.upper() == "_LAST_":
            if self.last is None:
                raise KeyError("no table has been written")
            name = self.last
        ref, _, member = name.rpartition(".")
        if ref.lower() in ("dictionary", "sashelp"):
            return self.dictionary(member)
        lib, table = self._find(name)
        return lib.read(table)

    def save(self, name: str, df: DataFrame) -> DataFrame:
        lib, table = self._find(name)
        lib.write(table, df)
        self.last = name if "." in name else f"work.{name}"
        return lib.read(table)

    def dictionary(self, member: str) -> DataFrame:
        """DICTIONARY.TABLES, COLUMNS and MACROS; row counts come from the tables when they are asked for."""
        member = {"vtable": "tables", "vmember": "members", "vcolumn": "columns", "vmacro": "macros"}.get(member.lower(), member.lower())
        every = [(ref, n, lib) for ref, lib in sorted(self.libraries.items()) for n in lib.list()]
        if member == "macros":
            return self.spark.createDataFrame([("GLOBAL", k, v) for k, v in sorted(self.symbols.items())], "scope string, name string, value string")
        if member in ("tables", "members"):
            counts = [lib.read(n).agg(F.lit(ref.upper()).alias("libname"), F.lit(n.upper()).alias("memname"), F.lit("DATA").alias("memtype"), F.count("*").alias("nobs"), F.lit(len(lib.read(n).columns)).cast("long").alias("nvar")) for ref, n, lib in every]
            out = self.spark.createDataFrame([], "libname string, memname string, memtype string, nobs long, nvar long")
            for c in counts:
                out = out.unionByName(c)
            return out
        rows = []
        for ref, n, lib in every:
            for k, f in enumerate(lib.read(n).schema.fields):
                kind = "char" if f.dataType.typeName() == "string" else "num"
                rows.append((ref.upper(), n.upper(), f.name, kind, f.metadata.get("length", 8 if kind == "num" else None), k + 1, f.metadata.get("label"), f.metadata.get("format"), f.metadata.get("informat")))
        return self.spark.createDataFrame(rows, "libname string, memname string, name string, type string, length int, varnum int, label string, format string, informat string")

    # results -------------------------------------------------------------------------------------------------------------
    def capture(self, name: str, df: DataFrame) -> None:
        """ODS OUTPUT: a result table by name; more slices are appended, columns filled diagonally."""
        key = name.lower()
        if (self.selected is not None and key not in self.selected) or key in self.excluded:
            return
        old = self.captured.get(key)
        self.captured[key] = df if old is None else old.unionByName(df, allowMissingColumns=True)

    def title(self, n: int, text: str | None, foot: bool = False) -> None:
        """Sets a level and clears those above it."""
        lines = self.footnotes if foot else self.titles
        for k in [k for k in lines if k >= n]:
            del lines[k]
        if text is not None:
            lines[n] = text

    # macro variables from data ---------------------------------------------------------------------------------------------
    def symput(self, df: DataFrame, name: str, column: str) -> None:
        """CALL SYMPUT: the last row's value, as text."""
        numbered = df.select(F.col(column).cast("string").alias("v"), F.monotonically_increasing_id().alias("k"))
        row = numbered.select(F.max_by("v", "k")).first()
        self.symbols[name.upper()] = "" if row is None or row[0] is None else row[0]

    def into(self, df: DataFrame, names: list[str], separator: str | None = None, most: int = 65_536) -> None:
        """SELECT INTO: the first row's values, or all of a column joined (a bounded number, checked)."""
        rows = df.limit(most + 1 if separator is not None else 1).collect()
        if len(rows) > most:
            raise ValueError(f"SELECT INTO joins at most {most} values")
        for k, n in enumerate(names):
            texts = ["" if r[k] is None else str(r[k]) for r in rows]
            self.symbols[n.upper()] = separator.join(texts) if separator is not None else (texts[0] if texts else "")

    def execute(self, df: DataFrame, column: str, most: int = 10_000) -> None:
        """CALL EXECUTE: queue code text, one item a row, behind a checked number."""
        rows = df.select(column).limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError("too many queued statements")
        self.queued += [r[0] for r in rows if r[0]]


def temporary() -> str:
    """A folder for tests; never used on a cluster."""
    return tempfile.mkdtemp(prefix="lumenstep-")


def valid_name(name: str) -> bool:
    return bool(re.fullmatch(r"[A-Za-z_]\w{0,31}", name))


def local(path: str) -> Path:
    return Path(path)
