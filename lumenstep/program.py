"""The text language: macro expansion, then DATA steps, procedures and global statements over a session.

A DATA step becomes one chain of DataFrame expressions in statement order: conditions are guards, sum statements are
running totals, BY processing and MERGE are the operators of `operators.datastep`. What would need a row loop (GOTO,
WHILE loops over variables, hash objects that change) raises `NotImplementedError`; `datastep.recurrence` runs such
logic from Python. Row order is a hidden number column of each input.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import output, sources, sql
from .expressions import Scope, compile_, number, parse, truth
from .macro import Macros
from .operators import datastep as D
from .operators import graphics as G
from .operators import inference as I
from .operators import likelihood as L
from .operators import multivariate as M
from .operators import regression as R
from .operators import relational as Q
from .operators import sorting as S
from .operators import summary as U
from .operators.matrix import Matrix
from .operators.running import carried, cumulate
from .session import Session
from .values import with_metadata

_STRING = r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\""


def statements(text: str) -> list[str]:
    """Split at semicolons outside quotes; comments go; DATALINES keep their block as one item."""
    text = re.sub(rf"(?s)({_STRING})|/\*.*?\*/", lambda m: m[1] or " ", text)
    out, at = [], 0
    piece = re.compile(rf"(?s)(?:{_STRING}|[^;'\"])*")
    while at < len(text):
        m = piece.match(text, at)
        st = m.group().strip()
        at = m.end() + 1
        if re.fullmatch(r"(?i)datalines|cards", st):
            end = re.compile(r"(?m)^\s*;").search(text, at)
            out.append("datalines\0" + text[at : end.start()].strip("\n"))
            at = end.end()
        elif st and not st.startswith("*"):
            out.append(st)
    return out


def options_of(text: str) -> dict[str, str]:
    """NAME=value (or bracketed) and bare options of a statement."""
    out = {}
    for m in re.finditer(rf"(?s)(\w+)\s*=\s*(\((?:[^()]|\([^()]*\))*\)|{_STRING}|[^\s()]+(?:\((?:[^()]|\([^()]*\))*\))?)|(\w+)", text):
        out[(m[1] or m[3]).lower()] = m[2] if m[1] else ""
    return out


def bare(text: str) -> str:
    return text.strip().strip("'\"")


class Program:
    """run(text) executes a program; tables are in the session, printed results in `listing`, notes in `session.log`."""

    def __init__(self, spark: SparkSession, session: Session | None = None):
        self.spark, self.session = spark, session or Session(spark)
        self.macros = Macros(self.session.symbols)
        self.listing: list[str] = []
        self.results: dict[str, object] = {}
        self.errors = 0

    def run(self, text: str) -> Program:
        # symbols set by a step are seen by the text after it: expand one step at a time
        text = re.sub(r"(?is)%macro\b.*?%mend\b[^;]*;", lambda m: self.macros.expand(m[0]), text)
        cuts = [0, *(m.end() for m in re.finditer(rf"(?is){_STRING}|/\*.*?\*/|\b(run|quit)\s*;", text) if m[1]), len(text)]
        for step in (text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)):
            self._execute(self.macros.expand(step))
            while self.session.queued:
                self._execute(self.macros.expand(self.session.queued.pop(0)))
        return self

    def _execute(self, text: str) -> None:
        st = statements(text)
        k = 0
        while k < len(st):
            head = st[k].split("\0")[0]
            if m := re.match(r"(?is)proc\s+(\w+)\s*(.*)$", head):
                end = k + 1
                while end < len(st) and not re.match(r"(?i)(run|quit)$|proc\s+\w|data\b(?!\s*=)", st[end]):
                    end += 1
                self._proc(m[1].upper(), m[2], st[k + 1 : end])
                k = end
            elif re.match(r"(?i)data\b", head):
                end = k + 1
                while end < len(st) and not re.match(r"(?i)run$|proc\s+\w|data\s+[\w.]+", st[end]):
                    end += 1
                Step(self, head[4:], st[k + 1 : end]).run()
                k = end
            else:
                if not re.fullmatch(r"(?i)run|quit", head):
                    self._global(head)
                k += 1

    def _global(self, s: str) -> None:
        if m := re.match(r"(?is)libname\s+(\w+)\s+clear$", s):
            self.session.clear(m[1])
        elif m := re.match(rf"(?is)libname\s+(\w+)\s+(?:(csv|parquet|s3)\s+)?({_STRING})", s):
            self.session.libname(m[1], bare(m[3]), "csv" if (m[2] or "").lower() == "csv" else "parquet")
        elif m := re.match(rf"(?is)(title|footnote)(\d?)\s*({_STRING})?$", s):
            self.session.title(int(m[2] or 1), bare(m[3]) if m[3] else None, m[1].lower() == "footnote")
        elif m := re.match(r"(?is)options\s+(.*)$", s):
            self.session.options |= {k.upper(): int(v) if v.isdigit() else v or True for k, v in options_of(m[1]).items()}
        elif m := re.match(r"(?is)ods\s+(select|exclude)\s+(.*)$", s):
            names = {n.lower() for n in m[2].split()}
            if m[1].lower() == "select":
                self.session.selected = None if names == {"all"} else set() if names == {"none"} else names
            else:
                self.session.excluded = set() if names == {"none"} else names
        elif re.match(r"(?i)(ods|filename|x|goptions)\b", s):
            self.session.log.append(f"NOTE: {s.split()[0].upper()} has no effect")
        else:
            raise SyntaxError(f"unknown statement {s[:40]!r}")

    # inputs and outputs --------------------------------------------------------------------------------------------------
    def input(self, spec: str | None) -> DataFrame:
        """name(options): WHERE=, KEEP=, DROP=, RENAME=, OBS=, FIRSTOBS=."""
        if not spec:
            return self.session.table()
        m = re.match(r"(?s)\s*([\w.]+)\s*(?:\((.*)\))?\s*$", spec)
        df = self.session.table(m[1])
        return self.shape(df, m[2] or "")

    def shape(self, df: DataFrame, text: str) -> DataFrame:
        o = options_of(text)
        rename = dict(re.findall(r"(\w+)\s*=\s*(\w+)", o.get("rename", "")))
        if "obs" in o or "firstobs" in o:
            first = int(o.get("firstobs") or 1)
            df = df.offset(first - 1) if first > 1 else df
            df = df.limit(int(o["obs"]) - first + 1) if o.get("obs") else df
        where = self.condition(df, o["where"][1:-1]) if "where" in o else None
        words = lambda k: o[k].strip("()").split() if k in o else None
        real = {c.lower(): c for c in df.columns}
        keep, drop = ([real[w.lower()] for w in v if w.lower() in real] if v is not None else None for v in (words("keep"), words("drop")))
        return D.dataset_options(df, keep, drop or (), {real[a.lower()]: b for a, b in rename.items() if a.lower() in real}, where)

    def save(self, spec: str, df: DataFrame) -> DataFrame:
        m = re.match(r"(?s)\s*([\w.]+)\s*(?:\((.*)\))?\s*$", spec)
        return self.session.save(m[1], self.shape(df, m[2] or ""))

    def condition(self, df: DataFrame, text: str) -> Column:
        return truth(*compile_(parse(text), Scope(dict(df.dtypes), catalog=self.session.catalog)))

    def show(self, df: DataFrame, name: str = "Result") -> None:
        self.session.capture(name, df)
        self.results[name] = df
        if self.session.options.get("PRINT", True) and not self.quiet:
            self.listing.append(output.text(df, " ".join(self.session.titles.values()) or None, most=100_000))

    quiet = False

    # procedures ------------------------------------------------------------------------------------------------------------
    def _proc(self, name: str, head: str, body: list[str]) -> None:
        fn: Callable | None = getattr(self, f"proc_{name.lower()}", None)
        if fn is None:
            raise NotImplementedError(f"PROC {name} is not available as text")
        o = options_of(head)
        st: dict[str, list[str]] = {}
        for s in body:
            word, _, rest = s.partition(" ")
            st.setdefault(word.lower(), []).append(rest.strip())
        if name in ("SQL", "IML"):
            fn(o, body)
            return
        self.quiet = "noprint" in o
        df = None
        if name not in ("FORMAT", "IMPORT", "DATASETS", "OPTIONS", "APPEND", "COMPARE", "CATALOG", "PRINTTO"):
            df = self.input(o.get("data"))
            if "where" in st:
                df = df.where(self.condition(df, st["where"][-1]))
            real = {c.lower(): c for c in df.columns}
            for key in ("var", "class", "by", "id", "weight", "freq", "tables", "table", "with", "partial", "paired", "model", "sum", "column", "means", "lsmeans", "random", "repeated"):
                if key in st:
                    st[key] = [re.sub(rf"{_STRING}|[A-Za-z_]\w*", lambda m: real.get(m[0].lower(), m[0]), x) for x in st[key]]
        fn(o, st, df)
        self.quiet = False

    @staticmethod
    def _words(st: dict, key: str) -> list[str]:
        return [w for s in st.get(key, []) for w in s.split("/")[0].split()]

    @classmethod
    def _by(cls, st: dict) -> list[str]:
        return re.sub(r"(?i)descending\s+", "-", " ".join(st.get("by", []))).split()

    def _numeric(self, df: DataFrame, but: list[str]) -> list[str]:
        low = {b.lower().lstrip("-") for b in but}
        return [c for c, t in df.dtypes if t in ("int", "bigint", "double", "float", "smallint", "tinyint") and c.lower() not in low]

    def proc_sort(self, o, st, df) -> None:
        by = self._by(st)
        keyed = df.withColumn("__o", F.monotonically_increasing_id())
        out = S.nodupkey(keyed, by, ["__o"]) if "nodupkey" in o else S.noduprecs(keyed, by, ["__o"]) if "noduprecs" in o or "nodup" in o else S.sort(keyed, [*by, "__o"])
        self.save(o.get("out") or o.get("data") or self.session.last, out.drop("__o"))

    def proc_print(self, o, st, df) -> None:
        var, by = self._words(st, "var") or None, [b.lstrip("-") for b in self._by(st)]
        self.show(output.print_report(df, [*self._words(st, "id"), *var] if var else None, self._words(st, "sum"), by), "Print")

    def proc_means(self, o, st, df) -> None:
        classes, by = self._words(st, "class"), [b.lstrip("-") for b in self._by(st)]
        weight = (self._words(st, "weight") or [None])[0]
        var = self._words(st, "var") or self._numeric(df, [*classes, *by, *([weight] if weight else [])])
        known = {*U.SIMPLE, *U.QUANTILES, "LCLM", "UCLM"}
        stats = [k.upper() for k in o if k.upper() in known] or ["N", "MEAN", "STD", "MIN", "MAX"]
        ways = [int(w) for w in self._words(st, "ways")] or None
        types = [t.split("*") for t in self._words(st, "types")] or None
        full = U.means(df, var, stats, classes, by, weight, ways, types, nway=bool(classes) and ways is None and types is None)
        self.show(full, "Summary")
        for text in st.get("output", []):
            oo = options_of(text)
            names, asked = {}, []
            for m in re.finditer(r"(\w+)\s*(?:\(([^)]*)\))?\s*=\s*((?:\w+\s*)*?)(?=\s*\w+\s*(?:\(|=)|/|$)", re.sub(r"(?i)\bout\s*=\s*[\w.]+(?:\([^)]*\))?", "", text)):
                s, own = m[1].upper(), m[2].split() if m[2] else var
                if s in known:
                    asked.append(s)
                    names |= {(v, s): n for v, n in zip(own, m[3].split() or own, strict=False)}
            out = U.means(df, var, asked or ["N", "MIN", "MAX", "MEAN", "STD"], classes, by, weight, ways, types, "nway" in o, names=names)
            self.save(oo["out"], out)

    def proc_summary(self, o, st, df) -> None:
        self.proc_means(o | ({} if "print" in o else {"noprint": ""}), st, df)

    def proc_freq(self, o, st, df) -> None:
        by, weight = [b.lstrip("-") for b in self._by(st)], (self._words(st, "weight") or [None])[0]
        for text in st.get("tables", st.get("table", [])):
            tables, _, opts = text.partition("/")
            oo = options_of(opts)
            for table in tables.split():
                cols = table.split("*")
                if len(cols) == 1:
                    out = U.freq_one_way(df, cols[0], by, weight, "missing" in oo)
                    self.show(out, "OneWayFreqs")
                    if "chisq" in oo:
                        self.show(U.chisq_one_way(df, cols[0], weight), "OneWayChiSq")
                else:
                    out = U.freq_two_way(df, cols[-2], cols[-1], [*by, *cols[:-2]], weight, "missing" in oo)
                    self.show(out, "CrossTabFreqs")
                    for test in ("chisq", "fisher", "relrisk", "measures", "agree", "trend"):
                        if test in oo:
                            self.show(I.table_test(df, cols[-2], cols[-1], test, weight), test.title())
                if "out" in oo:
                    self.save(oo["out"], out.select(*by, *cols, "COUNT", "PERCENT"))

    def proc_transpose(self, o, st, df) -> None:
        by, ids = [b.lstrip("-") for b in self._by(st)], (self._words(st, "id") or [None])[0]
        var = self._words(st, "var") or self._numeric(df, [*by, ids or ""])
        out = S.transpose(df.withColumn("__o", F.monotonically_increasing_id()), var, by, ids, None, ["__o"], bare(o.get("prefix", "COL")), bare(o.get("name", "_NAME_")))
        self.save(o.get("out", "data1"), out)

    def proc_rank(self, o, st, df) -> None:
        var, by = self._words(st, "var"), [b.lstrip("-") for b in self._by(st)]
        method = next((k.upper() for k in o if k.upper() in ("FRACTION", "NPLUS1", "PERCENT", "SAVAGE")), o.get("normal", "").upper() or None)
        out = S.rank(df, var, by, o.get("ties", "LOW" if o.get("groups") else "MEAN"), "descending" in o, int(o["groups"]) if o.get("groups") else None, method, self._words(st, "ranks") or None)
        self.save(o.get("out", "data1"), out)

    def proc_univariate(self, o, st, df) -> None:
        by, weight = [b.lstrip("-") for b in self._by(st)], (self._words(st, "weight") or [None])[0]
        var = self._words(st, "var") or self._numeric(df, by)
        self.show(U.univariate(df, var, by, weight), "Moments")
        if "normal" in o:
            for v in var:
                self.show(I.normality(df, v), "TestsForNormality")

    def proc_corr(self, o, st, df) -> None:
        var, with_ = self._words(st, "var") or self._numeric(df, []), self._words(st, "with") or None
        for method in [m for m in ("PEARSON", "SPEARMAN", "KENDALL", "HOEFFDING") if m.lower() in o] or ["PEARSON"]:
            self.show(I.corr(df, var, with_, method, self._words(st, "partial"), (self._words(st, "weight") or [None])[0]), f"{method.title()}Corr")

    def proc_ttest(self, o, st, df) -> None:
        h0, alpha = float(o.get("h0") or 0), float(o.get("alpha") or 0.05)
        for pair in self._words(st, "paired"):
            self.show(I.ttest_paired(df, *pair.split("*"), h0, alpha), "TTest")
        for v in self._words(st, "var"):
            self.show(I.ttest_two(df, v, self._words(st, "class")[0], h0) if "class" in st else I.ttest_one(df, v, h0, alpha, o.get("sides", "2").upper()), "TTest")

    def proc_npar1way(self, o, st, df) -> None:
        for v in self._words(st, "var"):
            for kind in [k.upper() for k in o if k.upper() in ("WILCOXON", "MEDIAN", "SAVAGE", "NORMAL", "VW")] or ["WILCOXON"]:
                self.show(I.npar1way(df, v, self._words(st, "class")[0], kind), kind.title())
            if "exact" in st:
                self.show(I.exact_wilcoxon(df, v, self._words(st, "class")[0]), "Exact")

    @staticmethod
    def _model(text: str) -> tuple[str, list[str], dict[str, str]]:
        left, right = re.match(r"(?s)((?:\([^)]*\)|[^=(])*)=(.*)$", text).groups()
        terms, _, opts = right.partition("/")
        y = re.sub(r"\(.*?\)", "", left).split()[-1]
        return y, terms.split(), options_of(opts) | ({"event": bare(m[1])} if (m := re.search(r"(?i)event\s*=\s*('[^']*'|\"[^\"]*\")", left)) else {})

    def proc_reg(self, o, st, df) -> None:
        weight, freq = ((self._words(st, k) or [None])[0] for k in ("weight", "freq"))
        for text in st["model"]:
            y, x, oo = self._model(text)
            fit = R.regress(df, y, x, "noint" not in oo, weight, freq)
            if oo.get("selection"):
                fit, steps = R.select(fit, oo["selection"], float(oo["slentry"]) if "slentry" in oo else None, float(oo["slstay"]) if "slstay" in oo else None)
                self.results["SelectionSummary"] = steps
            self.show(I.frame(df, fit.anova()), "ANOVA")
            self.show(R.estimates(df, fit), "ParameterEstimates")
            self.results["Fit"] = fit
        for text in st.get("output", []):
            oo = options_of(text)
            names = {"p": "P", "predicted": "P", "r": "R", "residual": "R", "h": "H", "cookd": "COOKD", "student": "STUDENT", "rstudent": "RSTUDENT", "press": "PRESS", "dffits": "DFFITS", "covratio": "COVRATIO", "stdp": "STDP", "stdr": "STDR", "stdi": "STDI", "lcl": "LCL", "ucl": "UCL", "lclm": "LCLM", "uclm": "UCLM"}
            full = R.output(df, fit)
            self.save(oo["out"], full.select(*df.columns, *[F.col(names[k]).alias(v) for k, v in oo.items() if k in names]))

    def proc_glm(self, o, st, df) -> None:
        classes = self._words(st, "class")
        y, effects, oo = self._model(st["model"][-1])
        effects = [e for t in effects for e in ([t] if "|" not in t else self._crossed(t.split("|")))]
        model = R.general_linear(df, y, effects, classes, (self._words(st, "weight") or [None])[0])
        for name, rows in (("Type1", R.type_one(model)), ("Type3", R.type_three(model))):
            self.show(self.spark.createDataFrame([(r["EFFECT"], int(r["DF"]), float(r["SS"]), float(r["F"]), float(r["P"])) for r in rows], "EFFECT string, DF int, SS double, F double, P double"), name)
        for e in self._words(st, "lsmeans"):
            self.results[f"LSMeans {e}"] = model.lsmeans(e)
        for e in self._words(st, "means"):
            self.show(df.groupBy(*e.split("*")).agg(F.count(y).alias("N"), F.avg(y).alias("MEAN"), F.stddev_samp(y).alias("STD")), "Means")
        self.results["Model"] = model

    proc_anova = proc_glm

    @staticmethod
    def _crossed(parts: list[str]) -> list[str]:
        out: list[str] = []
        for p in parts:
            out += [p, *[f"{e}*{p}" for e in out]]
        return sorted(out, key=lambda e: e.count("*"))

    def _parameters(self, rows: list[dict], name: str) -> None:
        keys = [k for k in rows[0] if k not in ("VARIABLE", "EFFECT")]
        self.show(self.spark.createDataFrame([(r.get("VARIABLE", r.get("EFFECT")), *(float(r[k]) for k in keys)) for r in rows], "VARIABLE string, " + ", ".join(f"{k} double" for k in keys)), name)

    def proc_logistic(self, o, st, df) -> None:
        classes = [re.sub(r"\(.*", "", w) for w in self._words(st, "class")]
        y, x, oo = self._model(st["model"][-1])
        freq = (self._words(st, "freq") or [None])[0]
        levels = df.select(y).where(F.col(y).isNotNull()).distinct().limit(3).collect()
        if len(levels) > 2:
            fit = L.logistic_ordinal(df, y, x, classes, freq)
        else:
            event = next((r[0] for r in levels if str(r[0]).removesuffix(".0") == oo.get("event")), max(r[0] for r in levels) if "descending" in o else None)
            fit = L.logistic(df, y, x, classes, event, oo.get("link", "LOGIT"), freq)
        self._parameters(fit["parameters"], "ParameterEstimates")
        self.results["Fit"] = fit
        for text in st.get("output", []):
            oo = options_of(text)
            self.save(oo["out"], L.logistic_output(df, fit, oo.get("p") or oo.get("predicted") or "P_1", oo.get("xbeta", "XBETA")))

    def proc_genmod(self, o, st, df) -> None:
        y, x, oo = self._model(st["model"][-1])
        fit = L.genmod(df, y, x, oo.get("dist", "NORMAL"), oo.get("link"), self._words(st, "class"), (self._words(st, "freq") or [None])[0], oo.get("scale"))
        self._parameters(fit["parameters"], "ParameterEstimates")
        self.results["Fit"] = fit

    def proc_mixed(self, o, st, df) -> None:
        y, x, _ = self._model(st["model"][-1])
        spec = options_of((st.get("random") or st.get("repeated"))[-1].replace("/", " "))
        structure = spec.get("type", "VC").upper()
        time = next((w for w in self._words(st, "repeated") if w.lower() in {c.lower() for c in df.columns}), None)
        fit = L.mixed(df, y, x, spec.get("subject") or spec["sub"], [c for c in self._words(st, "class") if c in x], structure, o.get("method", "REML"), time)
        self._parameters(fit["fixed"], "SolutionF")
        self.results["Fit"] = fit

    def proc_glimmix(self, o, st, df) -> None:
        y, x, oo = self._model(st["model"][-1])
        spec = options_of(st["random"][-1].replace("/", " "))
        self.results["Fit"] = L.glimmix(df, y, x, spec.get("subject") or spec["sub"], oo.get("dist", "NORMAL"), [c for c in self._words(st, "class") if c in x], o.get("method", "RSPL"))

    def proc_princomp(self, o, st, df) -> None:
        stats, out = M.princomp(df, self._words(st, "var") or self._numeric(df, []), "cov" in o, int(o["n"]) if o.get("n") else None, bare(o.get("prefix", "Prin")))
        self.results["Eigenvalues"] = stats
        if "out" in o:
            self.save(o["out"], out)

    def proc_factor(self, o, st, df) -> None:
        stats, out = M.factor(df, self._words(st, "var") or self._numeric(df, []), int(o["nfactors"]) if o.get("nfactors") else None, o.get("rotate", "NONE"))
        self.results["Factors"] = stats
        if "out" in o:
            self.save(o["out"], out)

    def proc_fastclus(self, o, st, df) -> None:
        centers, out = M.fastclus(df, self._words(st, "var") or self._numeric(df, []), int(o.get("maxclusters") or o.get("maxc")), int(o.get("maxiter") or 30))
        self.results["Centers"] = centers
        if "out" in o:
            self.save(o["out"], out)

    def proc_cluster(self, o, st, df) -> None:
        ids = (self._words(st, "id") or [None])[0]
        own = df if ids else df.withColumn("_ID_", F.monotonically_increasing_id())
        rows = M.cluster(own, self._words(st, "var") or self._numeric(df, []), ids or "_ID_", o.get("method", "AVERAGE"))
        self.show(self.spark.createDataFrame(rows, "STEP int, A string, B string, _HEIGHT_ double, _FREQ_ int"), "ClusterHistory")

    def proc_discrim(self, o, st, df) -> None:
        cls = self._words(st, "class")[0]
        prior = re.sub(r"[;\s]", "", " ".join(st.get("priors", ["EQUAL"]))).upper()
        stats, out = M.discrim(df, self._words(st, "var") or self._numeric(df, [cls]), cls, "PROP" if prior.startswith("PROP") else "EQUAL")
        self.results["Discrim"] = stats
        self.show(M.error_rates(out, cls), "ErrorRates")
        if "out" in o:
            self.save(o["out"], out)

    def proc_distance(self, o, st, df) -> None:
        var = re.findall(r"\w+(?=\s|\)|$)", re.sub(r"(?i)\w+\s*\(", "", " ".join(st.get("var", []))))
        own = df.withColumn("_ID_", F.monotonically_increasing_id())
        ids = (self._words(st, "id") or ["_ID_"])[0]
        self.save(o.get("out", "data1"), M.distance(own, ids, var or self._numeric(df, []), o.get("method", "EUCLID")))

    def proc_contents(self, o, st, df) -> None:
        out = U.contents(df)
        self.show(out, "Variables")
        if "out" in o:
            self.save(o["out"], out)

    def proc_append(self, o, st, df) -> None:
        base = o["base"]
        data = self.input(o.get("data"))
        lib, name = self.session._find(base)
        self.save(base, Q.append(lib.read(name), data, "force" in o) if lib.exists(name) else data)

    def proc_datasets(self, o, st, df) -> None:
        lib = self.session.libraries[o.get("library", o.get("lib", "work")).lower()]
        for n in self._words(st, "delete"):
            lib.delete(n)
        for a, b in re.findall(r"(\w+)\s*=\s*(\w+)", " ".join(st.get("change", []))):
            lib.rename(a, b)
        for a, b in re.findall(r"(\w+)\s*=\s*(\w+)", " ".join(st.get("exchange", []))):
            lib.exchange(a, b)
        if "save" in st:
            lib.save(self._words(st, "save"))
        for text in st.get("copy", []):
            oo = options_of(text)
            source = self.session.libraries[oo.get("in", o.get("lib", "work")).lower()]
            for n in self._words(st, "select") or source.list():
                source.copy(n, self.session.libraries[oo["out"].lower()])
        if "modify" in st:
            name = st["modify"][0].split()[0]
            out = lib.read(name)
            for a, b in re.findall(r"(\w+)\s*=\s*(\w+)", " ".join(st.get("rename", []))):
                out = out.withColumnRenamed(a, b)
            for a, b in re.findall(rf"(\w+)\s*=\s*({_STRING})", " ".join(st.get("label", []))):
                out = with_metadata(out, a, label=bare(b))
            lib.write(name, out)

    def proc_compare(self, o, st, df) -> None:
        base, other = self.input(o["base"]), self.input(o.get("compare") or o.get("comp"))
        self.results["Structure"] = U.structure(base, other)
        ids = self._words(st, "id")
        diff = U.compare(*(d if ids else d.withColumn("__o", F.monotonically_increasing_id()) for d in (base, other)), ["__o"], ids)
        out = diff.where("VAR <> '__o'")
        self.show(out, "CompareDifferences")
        if "out" in o:
            self.save(o["out"], out)

    def proc_tabulate(self, o, st, df) -> None:
        table = st["table"][0].split("/")[0]
        var = (self._words(st, "var") or [None])[0]
        words = {"N", "NMISS", "SUM", "MEAN", "MIN", "MAX", "STD", "PCTN", "PCTSUM"}
        stats = [w for w in re.findall(r"\w+", table.upper()) if w in words] or (["SUM"] if var else ["N"])
        classes = {c.lower() for c in self._words(st, "class")}
        dims = [[w.upper() if w.upper() == "ALL" else w for w in re.findall(r"\w+", d) if w.lower() in classes or w.upper() == "ALL"] for part in table.split(",") for d in part.split("*")]
        out = U.tabulate(df, [d for d in dims if d], var, list(dict.fromkeys(stats)))
        self.show(out, "Table")
        if "out" in o:
            self.save(o["out"], out)

    def proc_report(self, o, st, df) -> None:
        use, across = {}, None
        for text in st.get("define", []):
            v, _, spec = text.partition("/")
            use[v.strip().lower()] = spec.lower().split()
        cols = self._words(st, "column") or self._words(st, "columns") or df.columns
        group = [c for c in cols if "group" in use.get(c.lower(), []) or "order" in use.get(c.lower(), [])]
        across = next((c for c in cols if "across" in use.get(c.lower(), [])), None)
        stats = {c: next((w for w in use.get(c.lower(), []) if w in ("sum", "mean", "min", "max", "n", "std")), "sum") for c in cols if c not in group and c != across and c in self._numeric(df, [])}
        grouped = any("group" in use.get(c.lower(), []) for c in cols)
        breaks = [re.match(r"(?i)after\s+(\w+)", b)[1] for b in st.get("break", []) if re.match(r"(?i)after\s+\w+", b)]
        out = U.report(df, group if grouped else (), stats, [c for c in cols if c not in group] if not grouped else (), group if not grouped else (), across, None, breaks, "rbreak" in st)
        self.show(out, "Report")
        if "out" in o:
            self.save(o["out"], out)

    def proc_import(self, o, st, df) -> None:
        get = not any("no" in s.lower() for s in st.get("getnames=no", [])) and "getnames=no" not in st and o.get("getnames", "").lower() != "no"
        sep = next((bare(k.split("=", 1)[1]) for k in st if k.startswith("delimiter=")), bare(o["delimiter"]) if "delimiter" in o else None)
        self.save(o["out"], sources.import_file(self.spark, bare(o["datafile"]), o.get("dbms", "CSV"), get, sep))

    def proc_export(self, o, st, df) -> None:
        sources.export_file(df, bare(o["outfile"]), o.get("dbms", "CSV"), bare(o["delimiter"]) if "delimiter" in o else None)

    def proc_format(self, o, st, df) -> None:
        cat = self.session.catalog
        for kind in ("value", "invalue"):
            for text in st.get(kind, []):
                m = re.match(r"(?s)(\$?\w+)\s*(?:\((.*?)\))?\s*(.*)$", text)
                ranges, other = [], None
                for r in re.finditer(rf"(?s)((?:{_STRING}|[^='\"])+?)=\s*({_STRING}|[^\s'\"]+)", m[3]):
                    label = bare(r[2]) if kind == "value" or r[2][0] in "'\"" else (r[2] if r[2].startswith("_") else float(r[2]))
                    for item in re.findall(rf"{_STRING}|[^,'\"]+", r[1]):
                        item = item.strip()
                        if not item:
                            continue
                        if item.lower() == "other":
                            other = label
                            continue
                        char = m[1].startswith("$") or kind == "invalue"
                        conv = lambda t: None if t.lower() in ("low", "high") else bare(t) if char or t[0] in "'\"" else float(t)
                        p = re.fullmatch(r"(.+?)\s*(<?)\s*-\s*(<?)\s*(.+)", item) if not item.startswith(("'", '"')) else None
                        if p and not re.fullmatch(r"-?\d+(\.\d+)?", item):
                            ranges.append((conv(p[1]), conv(p[4]), label, p[2] == "<", p[3] == "<"))
                        else:
                            ranges.append((conv(item), label))
                cat.value(m[1], ranges, other, kind=kind.upper())
        if "cntlout" in o:
            self.save(o["cntlout"], cat.control_table(self.spark))
        if "cntlin" in o:
            most = 100_000
            rows = self.input(o["cntlin"]).limit(most + 1).collect()
            if len(rows) > most:
                raise ValueError(f"CNTLIN takes at most {most} rows")
            cat.load_control(rows)

    # plots: the data series, in results
    def proc_sgplot(self, o, st, df) -> None:
        for word, texts in st.items():
            for text in texts:
                head, _, opts = text.partition("/")
                oo = options_of(f"{head} {opts}")
                real = {c.lower(): c for c in df.columns}
                col = lambda k, oo=oo, real=real: real.get(oo.get(k, "").lower())
                v = real.get(head.split()[0].lower()) if head.split() else None
                made = {
                    "scatter": lambda: G.series(df, col("x"), col("y"), col("group")),
                    "series": lambda: G.series(df, col("x"), col("y"), col("group")),
                    "vbar": lambda: G.bars(df, v, col("response"), oo.get("stat", "SUM" if "response" in oo else "FREQ"), col("group")),
                    "hbar": lambda: G.bars(df, v, col("response"), oo.get("stat", "SUM" if "response" in oo else "FREQ"), col("group")),
                    "histogram": lambda: self._histogram(df, v),
                    "density": lambda: G.density(df, v, oo.get("type", "NORMAL")),
                    "vbox": lambda: G.box(df, v, col("category")),
                    "reg": lambda: G.regression_line(df, col("x"), col("y")),
                    "loess": lambda: G.loess(df, col("x"), col("y")),
                }
                if word in made:
                    self.results[f"SGPLOT {word} {len(self.results)}"] = made[word]()

    @staticmethod
    def _histogram(df: DataFrame, v: str, bins: int = 20) -> DataFrame:
        lo, hi = df.agg(F.min(v).cast("double"), F.max(v).cast("double")).first()
        return U.histogram(df, v, lo or 0.0, ((hi or 0.0) - (lo or 0.0)) / bins or 1.0, bins)

    def proc_gchart(self, o, st, df) -> None:
        for word in ("vbar", "hbar", "pie"):
            for text in st.get(word, []):
                head, _, opts = text.partition("/")
                oo = options_of(opts)
                for v in head.split():
                    self.results[f"GCHART {word} {v}"] = G.bars(df, v, oo.get("sumvar"), oo.get("type", "SUM" if "sumvar" in oo else "FREQ"), oo.get("group"))

    def proc_gplot(self, o, st, df) -> None:
        for text in st.get("plot", []):
            for ys, x, _, group in re.findall(r"(\([^)]*\)|\w+)\s*\*\s*(\w+)(\s*=\s*(\w+))?", text.split("/")[0]):
                for y in ys.strip("()").split():
                    self.results[f"GPLOT {y}*{x}"] = G.series(df, x, y, group or None)

    def proc_plot(self, o, st, df) -> None:
        for text in st.get("plot", []):
            for y, x in re.findall(r"(\w+)\s*\*\s*(\w+)", text.split("/")[0]):
                self.listing.append(G.text_plot(df, x, y))

    def proc_options(self, o, st, df) -> None:
        self.listing.append("\n".join(f"{k}={v}" for k, v in sorted(self.session.options.items())))

    def proc_printto(self, o, st, df) -> None:
        self.session.log.append("NOTE: PRINTTO has no effect")

    def proc_catalog(self, o, st, df) -> None:
        self.results["Catalog"] = self.session.catalog.contents()

    def proc_iml(self, o, body) -> None:
        tables = {f"{n}": lib.read(n) for ref, lib in self.session.libraries.items() if ref == "work" for n in lib.list()}
        m = Matrix(self.spark, tables).run("; ".join(body))
        for name in m.created:
            self.session.save(name, m.tables[name])
        self.listing += [f"{n}\n{v}" for n, v in m.printed]
        self.results["Matrices"] = m.vars

    def proc_sql(self, o, body) -> None:
        self.quiet = "noprint" in o
        for s in body:
            if m := re.match(r"(?is)create\s+(table|view)\s+([\w.]+)(?:\s*\([^)]*\))?\s+as\s+(.*)$", s):
                self.save(m[2], self.select(m[3]))
            elif m := re.match(r"(?is)drop\s+(?:table|view)\s+(.*)$", s):
                for n in m[1].replace(",", " ").split():
                    lib, t = self.session._find(n)
                    lib.delete(t)
            elif m := re.match(r"(?is)insert\s+into\s+([\w.]+)\s*(?:\(([^)]*)\))?\s*values\s*(.*)$", s):
                base = self.session.table(m[1])
                names = [n.strip() for n in m[2].split(",")] if m[2] else base.columns
                one = self.spark.sql("SELECT * FROM VALUES " + sql.rewrite(re.sub(r"\)\s*\(", "), (", re.sub(r"(?i)\)\s*values\s*\(", "), (", m[3]))))
                self.session.save(m[1], base.unionByName(one.toDF(*names).select(*[F.col(n).cast(base.schema[n].dataType).alias(n) for n in names]), allowMissingColumns=True).select(*base.columns))
            elif m := re.match(r"(?is)insert\s+into\s+([\w.]+)\s+(select.*)$", s):
                base = self.session.table(m[1])
                self.session.save(m[1], Q.insert_select(base, self.select(m[2])))
            elif m := re.match(r"(?is)update\s+([\w.]+)\s+set\s+(.*?)(?:\s+where\s+(.*))?$", s):
                base = self.session.table(m[1])
                scope = Scope(dict(base.dtypes), catalog=self.session.catalog)
                sets = {p.partition("=")[0].strip(): compile_(parse(p.partition("=")[2]), scope)[0] for p in sql._select_items(m[2])}
                self.session.save(m[1], Q.update_set(base, sets, F.expr(sql.rewrite(m[3])) if m[3] else None))
            elif m := re.match(r"(?is)delete\s+from\s+([\w.]+)(?:\s+where\s+(.*))?$", s):
                base = self.session.table(m[1])
                self.session.save(m[1], Q.delete_where(base, F.expr(sql.rewrite(m[2]))) if m[2] else base.limit(0))
            elif m := re.match(r"(?is)describe\s+table\s+([\w.]+)$", s):
                self.session.log.append(Q.describe(self.session.table(m[1]), m[1]))
            elif m := re.match(r"(?is)(select\s+.*?)\s+into\s+(:.*?)(\s+from\s+.*)$", s):
                names, _, sep = m[2].partition("separated by")
                self.session.into(self.select(m[1] + m[3]), [n.strip(" :") for n in names.split(",")], bare(sep) if sep else None)
                self.macros.globals |= self.session.symbols
            elif re.match(r"(?i)\(*\s*select\b", s):
                self.show(self.select(s), "SQL_Results")
            else:
                raise SyntaxError(f"unknown SQL statement {s[:40]!r}")
        self.quiet = False

    def select(self, text: str) -> DataFrame:
        """A query over the session's tables; unknown names are left to Spark."""
        tables, shown = {}, text
        for name in dict.fromkeys(re.findall(r"(?i)\b(?:from|join)\s+([\w.]+)|,\s*([\w.]+)(?=\s*(?:,|\bwhere\b|$))", text)):
            n = name[0] or name[1]
            try:
                df = self.session.table(n)
            except (KeyError, ValueError):
                continue
            plain = n.replace(".", "_")
            shown = re.sub(rf"(?i)\b{re.escape(n)}\b(?!\s*\.)", plain, shown) if "." in n else shown
            tables[plain] = df
        return sql.run_sql(self.spark, tables, shown)


class Step:
    """One DATA step."""

    def __init__(self, program: Program, head: str, body: list[str]):
        self.p, self.body = program, body
        self.targets = re.findall(r"(?s)([\w.]+)\s*(\((?:[^()]|\([^()]*\))*\))?", head.strip() or "data1")
        self.df: DataFrame | None = None
        self.by: list[str] = []
        self.keep: list[str] | None = None
        self.drop: list[str] = []
        self.rename: dict[str, str] = {}
        self.meta: dict[str, dict] = {}
        self.lengths: dict[str, int] = {}
        self.arrays: dict[str, list[str]] = {}
        self.constants: dict[str, object] = {}
        self.retained: dict[str, object] = {}
        self.outputs: list[tuple[str | None, DataFrame]] = []
        self.hidden = 0
        self.symbols: list[tuple[str, str, Column | None]] = []
        self.auto: set[str] = set()
        self.first: list[str] = []  # order of variables as the step names them

    def scope(self) -> Scope:
        order = [*D.order_of(self.by), F.col("__o")]
        return Scope(dict(self.df.dtypes), self.arrays, self.constants | {"&" + k: v for k, v in self.p.session.symbols.items()}, self.p.session.catalog, order)

    def value(self, text: str) -> tuple[Column, str]:
        return compile_(parse(text), self.scope())

    def test(self, text: str) -> Column:
        return truth(*self.value(text))

    # inputs --------------------------------------------------------------------------------------------------------------
    def load(self) -> None:
        specs = lambda s: [(a, b) for a, b in re.findall(r"(?s)([\w.]+)\s*(\((?:[^()]|\([^()]*\))*\))?", s) if a]
        for s in self.body:
            if m := re.match(r"(?is)by\s+(.*)$", s):
                self.by = re.sub(r"(?i)descending\s+", "-", m[1]).split()
            elif m := re.match(r"(?is)array\s+(\w+)\s*[\[{(]\s*([\d*]+)\s*[\]})]\s*(\$?\s*\d*)\s*([^(]*)", s):
                names = m[4].split()
                full = []
                for n in names:
                    r = re.fullmatch(r"(\D+?)(\d+)-(?:\1)?(\d+)", n)
                    full += [f"{r[1]}{k}" for k in range(int(r[2]), int(r[3]) + 1)] if r else [n]
                self.arrays[m[1].lower()] = full or [f"{m[1]}{k + 1}" for k in range(int(m[2]))]
        number_rows = lambda d: d.withColumn("__o", F.monotonically_increasing_id())
        where = next((m[1] for s in reversed(self.body) if (m := re.match(r"(?is)where\s+(.*)$", s))), None)
        for s in self.body:
            m = re.match(r"(?is)(set|merge|update)\b\s*(.*)$", s)
            if not m:
                continue
            verb = m[1].lower()
            text = re.sub(r"(?i)\b(end|nobs|key)\s*=\s*\w+", "", m[2])
            tables = []
            for name, opts in specs(text) or [(self.p.session.last, "")]:
                inner = opts[1:-1] if opts else ""
                flag = re.search(r"(?i)\bin\s*=\s*(\w+)", inner)
                t = self.p.input(f"{name}({re.sub(r'(?i)\bin\s*=\s*\w+', '', inner)})" if inner else name)
                if where and not (inner and "where" in inner.lower()):
                    t = t.where(self.p.condition(t, where))
                tables.append((number_rows(t), flag[1] if flag else None))
            dfs = [t for t, _ in tables]
            if verb == "merge":
                if not self.by:
                    raise SyntaxError("MERGE needs BY")
                keys = [b.lstrip("-") for b in self.by]
                tagged = [d.withColumnRenamed("__o", f"__o{k}") for k, d in enumerate(dfs)]
                self.df = D.match_merge(tagged, self.by, [[f"__o{k}"] for k in range(len(dfs))], [f for _, f in tables])
                self.auto |= {f for _, f in tables if f}
                self.df = self.df.withColumn("__o", F.coalesce(*[f"__o{k}" for k in range(len(dfs))])).drop(*[f"__o{k}" for k in range(len(dfs))])
                del keys
            elif verb == "update":
                key = [b.lstrip("-") for b in self.by] or re.findall(r"(?i)key\s*=\s*(\w+)", m[2])
                self.df = D.update(dfs[0], dfs[1], key, ["__o"]).drop("__t___o")
            else:
                parts = [d.withColumn("__s", F.lit(k)) for k, d in enumerate(dfs)]
                flagged = [p.withColumns({f: F.lit(int(k == j)) for j, (_, f) in enumerate(tables) if f}) for k, p in enumerate(parts)]
                self.auto |= {f for _, f in tables if f}
                both = D.set_concat(*flagged)
                both = both.withColumn("__o", F.col("__s").cast("long") * (1 << 58) + F.col("__o")).drop("__s")
                self.df = both if self.df is None else D.one_to_one([self.df, both], [["__o"], ["__o"]])
            e, n = re.search(r"(?i)\bend\s*=\s*(\w+)", m[2]), re.search(r"(?i)\bnobs\s*=\s*(\w+)", m[2])
            if e or n:
                self.df = D.flags(self.df, ["__o"], e[1] if e else None, n[1] if n else None)
                self.auto |= {x[1] for x in (e, n) if x}
        block = next((s.split("\0", 1)[1] for s in self.body if s.startswith("datalines\0")), None)
        infile = next((m for s in self.body if (m := re.match(rf"(?is)infile\s+({_STRING}|\w+)\s*(.*)$", s))), None)
        read = next((m[1] for s in self.body if (m := re.match(r"(?is)input\s+(.*)$", s))), None)
        if read is not None:
            o = options_of(infile[2]) if infile else {}
            lines = sources.datalines(self.p.spark, block) if block is not None else sources.infile(self.p.spark, bare(infile[1]), int(o.get("firstobs") or 1), int(o["obs"]) if o.get("obs") else None).withColumn("_line", F.monotonically_increasing_id())
            dlm = (o.get("dlm") or o.get("delimiter") or "' '")[1:-1]
            fn = sources.held_records if read.rstrip().endswith("@@") else sources.read_records
            got = fn(lines, read.replace("@@", ""), dlm) if fn is sources.held_records else fn(lines, read, dlm, "dsd" in o, "STOPOVER" if "stopover" in o else "TRUNCOVER" if "truncover" in o else "MISSOVER")
            self.df = got.withColumn("__o", F.col("_line") * 1_000_000 + (F.col("_at") if "_at" in got.columns else 0)).drop("_line", "_at")
        if self.df is None:
            self.df = self.p.spark.range(1).select(F.col("id").alias("__o"))
        if self.by:
            real = {c.lower(): c for c in self.df.columns}
            self.by = [("-" if b[0] == "-" else "") + real[b.lstrip("-").lower()] for b in self.by]
            if re.search(r"(?i)\b(first|last)\.", " ".join(self.body)):
                self.df = D.first_last(self.df, self.by, ["__o"])
                self.auto |= {f"{x}_{b.lstrip('-')}" for b in self.by for x in ("first", "last")}
        if re.search(r"(?i)(?<![\w.])_n_(?!\w)", " ".join(self.body)):
            self.df = D.row_numbers(self.df, ["__o"], "_n_")
            self.auto.add("_n_")

    # statements ------------------------------------------------------------------------------------------------------------
    def run(self) -> None:
        self.load()
        self.outs = any(re.search(r"(?i)(^|\bthen\s+|^else\s+)output\b", s) for s in self.body)
        for m in (re.match(r"(?is)retain\s+(.*)$", s) for s in self.body):
            if m:
                for n, v in re.findall(rf"([A-Za-z_]\w*)\s*({_STRING}|-?[\d.]+)?", m[1]):
                    self.retained[n.lower()] = None if not v else bare(v) if v[0] in "'\"" else float(v)
        self.block(self.body, 0, None)
        if not self.outs:
            self.outputs.append((None, self.df))
        self.finish()

    def block(self, st: list[str], k: int, guard: Column | None) -> int:
        while k < len(st):
            if re.fullmatch(r"(?i)end", st[k]):
                return k + 1
            k = self.statement(st, k, guard)
        return k

    def skip(self, st: list[str], k: int) -> int:
        if re.search(r"(?i)(^|\bthen\s+|^else\s+|^when\s*\(.*\)\s*|^otherwise\s+)(do\b|select\b)", st[k]):
            depth, k = 1, k + 1
            while depth:
                depth += bool(re.search(r"(?i)(^|\bthen\s+|^else\s+|^when\s*\(.*\)\s*|^otherwise\s+)(do\b|select\b)", st[k])) - bool(re.fullmatch(r"(?i)end", st[k]))
                k += 1
            return k
        return k + 1

    def kept(self, cond: Column) -> Column:
        """A condition as a hidden column: later assignments don't change it."""
        self.hidden += 1
        name = f"__c{self.hidden}"
        self.df = self.df.withColumn(name, F.coalesce(cond, F.lit(False)))
        return F.col(name)

    def branch(self, st: list[str], k: int, text: str, guard: Column) -> int:
        if re.fullmatch(r"(?i)do", text):
            return self.block(st, k + 1, guard)
        if re.match(r"(?i)(do|if|select)\b", text):
            self.statement([text, *st[k + 1 :]], 0, guard)
            return self.skip(st, k)
        self.simple(text, guard)
        return k + 1

    def statement(self, st: list[str], k: int, guard: Column | None) -> int:
        s = st[k]
        both = lambda c: c if guard is None else guard & c
        if m := re.match(r"(?is)if\s+(.*?)\s+then\b\s*(.*)$", s):
            cond = self.kept(both(self.test(m[1])))
            no = self.kept(both(~cond))
            after = self.branch(st, k, m[2], cond)
            while after < len(st) and (e := re.match(r"(?is)else\b\s*(.*)$", st[after])):
                if i := re.match(r"(?is)if\s+(.*?)\s+then\b\s*(.*)$", e[1]):
                    cond = self.kept(no & self.test(i[1]))
                    now, no = no, self.kept(no & ~cond)
                    after = self.branch(st, after, i[2], cond)
                    del now
                else:
                    return self.branch(st, after, e[1], no)
            return after
        if m := re.match(r"(?is)if\s+(.*)$", s):
            cond = self.test(m[1])
            self.df = self.df.where(cond if guard is None else ~guard | cond)
            return k + 1
        if m := re.match(r"(?is)select\b\s*(?:\((.*)\))?$", s):
            rest, k = self.kept(both(F.lit(True))), k + 1
            while not re.fullmatch(r"(?i)end", st[k]):
                if w := re.match(r"(?is)when\s*\(((?:[^()]|\([^()]*\))*)\)\s*(.*)$", st[k]):
                    items = sql._select_items(w[1])
                    cond = F.lit(False)
                    for i in items:
                        cond = cond | (self.test(f"({m[1]}) = ({i})") if m[1] else self.test(i))
                    hit = self.kept(rest & cond)
                    rest = self.kept(rest & ~hit)
                    k = self.branch(st, k, w[2] or "do", hit) if w[2] else k + 1
                elif w := re.match(r"(?is)otherwise\b\s*(.*)$", st[k]):
                    k = self.branch(st, k, w[1], rest) if w[1] else k + 1
                else:
                    raise SyntaxError(f"{st[k]!r} in SELECT")
            return k + 1
        if m := re.match(r"(?is)do\s+(\w+)\s*=\s*(.*)$", s):
            return self.loop(st, k, m[1], m[2], guard)
        if m := re.match(r"(?is)do\s+over\s+(\w+)$", s):
            cols = self.arrays[m[1].lower()]
            body = st[k + 1 : self.skip(st, k) - 1]
            for c in cols:
                self.block([re.sub(rf"(?i)\b{m[1]}\b", c, x) for x in body], 0, guard)
            return self.skip(st, k)
        if re.fullmatch(r"(?i)do", s):
            return self.block(st, k + 1, guard)
        if re.match(r"(?i)(do\s+(while|until)|goto|link|return|declare|hash)\b", s):
            raise NotImplementedError(f"{s.split()[0].upper()} loops over rows; use operators.datastep.recurrence")
        self.simple(s, guard)
        return k + 1

    def loop(self, st: list[str], k: int, index: str, spec: str, guard: Column | None) -> int:
        end = self.skip(st, k)
        body = st[k + 1 : end - 1]
        values: list = []
        for item in sql._select_items(spec):
            m = re.match(r"(?is)(.*?)\s+to\s+(.*?)(?:\s+by\s+(.*))?$", item.strip())
            parts = [self._constant(x) for x in ((m[1], m[2], m[3] or "1") if m else (item,))]
            if any(p is None for p in parts):
                return self._exploded(body, end, index, m, guard)
            if m:
                x, hi, by = parts
                while (x <= hi) if by > 0 else (x >= hi):
                    values.append(x)
                    x += by
                    if len(values) > 2000:
                        return self._exploded(body, end, index, m, guard)
            else:
                values.append(parts[0])
        for v in values:  # a static loop is unrolled
            self.constants[index.lower()] = int(v) if isinstance(v, float) and v == int(v) else v
            self.block(body, 0, guard)
        last = self.constants.pop(index.lower(), None)
        step = (values[-1] - values[-2]) if len(values) > 1 and not isinstance(values[-1], str) else 1
        after = last if isinstance(last, str) or last is None else last + step
        self.simple(f"{index} = {after!r}" if after is not None else f"{index} = .", guard)
        return end

    def _constant(self, text: str):
        node = parse(text)
        sign = 1
        if node.kind == "un" and node.value == "-":
            node, sign = node.args[0], -1
        if node.kind == "num":
            return sign * node.value
        if node.kind == "str":
            return node.value
        if node.kind == "call" and node.value == "DIM":
            return float(len(self.arrays[node.args[0].value.lower()]))
        if node.kind == "var" and node.value.lower() in self.constants:
            return self.constants[node.value.lower()]
        return None

    def _exploded(self, body: list[str], end: int, index: str, m, guard: Column | None) -> int:
        """A loop with computed bounds whose body outputs: one row for each index value."""
        if m is None or guard is not None or not any(re.search(r"(?i)\boutput\b", s) for s in body):
            raise NotImplementedError("a loop with computed bounds must output; use operators.datastep.recurrence otherwise")
        lo, hi, by = (number(*self.value(x)).cast("long") for x in (m[1], m[2], m[3] or "1"))
        before = self.df
        self.df = D.do_loop(self.df, index, lo, hi, by)
        self.block(body, 0, None)
        self.df = before.withColumn(index, hi + by)
        return end

    def assign(self, name: str, c: Column, kind: str, guard: Column | None) -> None:
        real = {x.lower(): x for x in self.df.columns}
        name = real.get(name.lower(), name)
        if kind == "b":
            c, kind = c.cast("int"), "n"
        if name in self.df.columns:
            t = dict(self.df.dtypes)[name]
            if t == "string" and kind != "c":
                c = F.trim(compile_text(c, kind))
            elif t != "string" and kind == "c":
                c = F.trim(c).try_cast("double")
        if name.lower() in self.lengths and (kind == "c"):
            c = F.substring(c, 1, self.lengths[name.lower()])
        if guard is not None:
            old = F.col(name) if name in self.df.columns else F.lit(None)
            c = F.when(guard, c).otherwise(old)
        self.df = self.df.withColumn(name, c)

    def simple(self, s: str, guard: Column | None) -> None:
        low = s.split("\0")[0].lower()
        word = re.match(r"\w*", low)[0]
        if word in ("set", "merge", "update", "by", "where", "input", "infile", "datalines", "array", "retain", "run", "title", "file", "stop"):
            return
        if word in ("keep", "drop"):
            names = [x for n in s.split()[1:] for x in self.scope().names(tuple(n.split("-")) if re.fullmatch(r"\w+-\w+", n) else n)]
            if word == "keep":
                self.keep = (self.keep or []) + names
            else:
                self.drop += names
        elif word == "rename":
            self.rename |= dict(re.findall(r"(\w+)\s*=\s*(\w+)", s[6:]))
        elif word == "length":
            for names, char, n in re.findall(r"((?:[A-Za-z_]\w*\s+)+)(\$?)\s*(\d+)\.?", s[6:] + " "):
                for n_ in names.split():
                    if char:
                        self.lengths[n_.lower()] = int(n)
                        if n_.lower() not in {c.lower() for c in self.df.columns}:
                            self.df = self.df.withColumn(n_, F.lit(None).cast("string"))
        elif word in ("format", "informat"):
            for names, fmt in re.findall(r"((?:[A-Za-z_]\w*\s+)+)(\$?\w*\d*\.\d*)", s[len(word) :]):
                for n in names.split():
                    self.meta.setdefault(n.lower(), {})[word] = fmt
        elif word == "label":
            for n, t in re.findall(rf"(\w+)\s*=\s*({_STRING})", s[5:]):
                self.meta.setdefault(n.lower(), {})["label"] = bare(t)
        elif word == "attrib":
            n = s.split()[1]
            for key, v in options_of(s[len("attrib ") + len(n) :]).items():
                if key in ("format", "informat", "label"):
                    self.meta.setdefault(n.lower(), {})[key] = bare(v)
        elif word == "delete":
            self.df = self.df.where(~guard) if guard is not None else self.df.limit(0)
        elif word == "output":
            now = self.df.where(guard) if guard is not None else self.df
            now = now.withColumns({i: F.lit(v) for i, v in self.constants.items() if i not in {c.lower() for c in now.columns}})
            for t in s.split()[1:] or [None]:
                self.outputs.append((t, now.withColumn("__k", F.lit(len(self.outputs)))))
        elif word == "call":
            self.call(s[4:].strip(), guard)
        elif word == "put":
            shown = self.df.where(guard) if guard is not None else self.df
            items = re.findall(rf"{_STRING}|[@+]\d+|\w+\s*=|\w+", s[3:])
            built = []
            for i in items:
                if i[0] in "'\"":
                    built.append(bare(i))
                elif i.endswith("="):
                    built += [i.replace(" ", ""), next((c for c in shown.columns if c.lower() == i.rstrip("= ").lower()), i)]
                else:
                    built.append(next((c for c in shown.columns if c.lower() == i.lower()), i))
            lines = sources.put_lines(shown.orderBy("__o"), built).limit(10_001).collect()
            if len(lines) > 10_000:
                raise ValueError("PUT writes at most 10,000 lines to the log; use sources.put_lines for files")
            self.p.session.log += [r[0] for r in lines]
        elif m := re.match(r"(?is)(\w+)\s*\+\s*(.+)$", s):
            self.running(m[1], m[2], guard)
        elif m := re.match(r"(?is)(\w+)\s*[\[{(]\s*(.+?)\s*[\]})]\s*=\s*(.*)$", s) if re.match(r"(?is)(\w+)\s*[\[{(]", s) and re.match(r"\w+", low)[0] in self.arrays else None:
            at = self._constant(m[2])
            cols = self.arrays[m[1].lower()]
            c, kind = self.value(m[3])
            if at is not None:
                self.assign(cols[int(at) - 1], c, kind, guard)
            else:
                place = number(*self.value(m[2]))
                hits = [self.kept((place == n + 1) if guard is None else guard & (place == n + 1)) for n in range(len(cols))]
                for n, col in enumerate(cols):
                    self.assign(col, c, kind, hits[n])
        elif m := re.match(r"(?is)(\w+)\s*=\s*(.*)$", s):
            c, kind = self.value(m[2])
            name = m[1]
            if name.lower() in self.retained:
                self.retain(name, c, guard)
            else:
                self.assign(name, c, kind, guard)
        elif word:
            raise NotImplementedError(f"the statement {s[:40]!r} is not available")

    def retain(self, name: str, c: Column, guard: Column | None) -> None:
        """An assignment to a retained variable: remembered for a sum that follows, or carried forward."""
        start = self.retained[name.lower()]
        follows = any(re.match(rf"(?is).*\b{name}\s*\+\s*\S", s) for s in self.body)
        if follows:
            self.reset = {**getattr(self, "reset", {}), name.lower(): (guard, c)}
            return
        own = F.when(guard, c) if guard is not None else c
        self.df = carried(self.df, own, ["__o"], name).withColumn(name, F.coalesce(name, F.lit(start)))

    def running(self, name: str, text: str, guard: Column | None) -> None:
        """Sum statement; a reset under FIRST.x makes it a total within that BY prefix."""
        add = F.coalesce(number(*self.value(text)).cast("double"), F.lit(0.0))
        if guard is not None:
            add = F.when(guard, add).otherwise(0.0)
        reset = getattr(self, "reset", {}).get(name.lower())
        plain = [s for s in self.body if re.match(rf"(?is)if\s+first\.(\w+).*then\s+(?:do\s*$|{name}\s*=)", s)]
        own_reset = next((re.match(r"(?is)if\s+first\.(\w+)", s)[1] for s in plain), None)
        start = self.retained.get(name.lower()) or 0
        if own_reset and (reset or name in self.df.columns):
            keys = [b.lstrip("-") for b in self.by]
            cut = keys[: [x.lower() for x in keys].index(own_reset.lower()) + 1]
            w = Window.partitionBy(*cut).orderBy(*D.order_of(self.by), F.col("__o")).rowsBetween(Window.unboundedPreceding, 0)
            base = F.first(reset[1]).over(Window.partitionBy(*cut).orderBy(*D.order_of(self.by), F.col("__o"))) if reset else F.lit(0.0)
            self.df = self.df.withColumn(name, F.coalesce(base.cast("double"), F.lit(0.0)) + F.sum(add).over(w))
        elif reset or name in self.df.columns and name.lower() not in self.retained:
            raise NotImplementedError(f"{name} is set in other ways before its sum; use operators.datastep.recurrence")
        else:
            self.df = cumulate(self.df, add, [*self.by, "__o"] if self.by else ["__o"], name).withColumn(name, F.col(name) + F.lit(start)) if not self.by else self._by_total(name, add, start)

    def _by_total(self, name: str, add: Column, start) -> DataFrame:
        return cumulate(self.df.withColumn("__a", add), F.col("__a"), [*self.by, "__o"], name).drop("__a").withColumn(name, F.col(name) + F.lit(start))

    def call(self, text: str, guard: Column | None) -> None:
        m = re.match(r"(?is)(\w+)\s*\((.*)\)$", text)
        name, args = m[1].lower(), [a.strip() for a in sql._select_items(m[2])]
        if name in ("symput", "symputx"):
            c, kind = self.value(args[1])
            shown = F.trim(compile_text(c, kind))
            rows = self.df.where(guard) if guard is not None else self.df
            self.symbols.append((bare(args[0]), rows.select(shown.alias("v"), "__o"), None))
        elif name == "missing":
            for a in args:
                self.assign(a, F.lit(None).cast(dict(self.df.dtypes).get(a, "double")), "c" if dict(self.df.dtypes).get(a) == "string" else "n", guard)
        elif name in ("sortn", "sortc"):
            from .functions.descriptive import sort_values

            names = [n for a in args for n in self.scope().names(a[3:] if a.lower().startswith("of ") else a)]
            self.df = self.df.withColumn("__s", sort_values(*names))
            for n, c in enumerate(names):
                self.df = self.df.withColumn(c, F.col("__s")[n])
            self.df = self.df.drop("__s")
        elif name == "cats":
            self.assign(args[0], compile_(parse(f"cats({','.join(args)})"), self.scope())[0], "c", guard)
        elif name == "execute":
            rows = self.df.where(guard) if guard is not None else self.df
            c, _ = self.value(args[0])
            self.p.session.execute(rows.select(c.alias("t"), "__o").orderBy("__o"), "t")
        elif name == "streaminit":
            self.p.session.log.append("NOTE: random streams are seeded per call")
        else:
            raise NotImplementedError(f"CALL {name.upper()} is not available as text")

    def finish(self) -> None:
        for name, rows, _ in self.symbols:
            row = rows.agg(F.max_by("v", "__o")).first()
            self.p.session.symbols[name.upper()] = self.p.macros.globals[name.upper()] = row[0] or ""
        for target, opts in self.targets:
            if target.lower() == "_null_":
                continue
            short = target.split(".")[-1].lower()
            parts = [d for t, d in self.outputs if t is None or t.split(".")[-1].lower() == short]
            out = D.set_concat(*parts) if parts else self.df.limit(0)
            order = ["__o"] + (["__k"] if "__k" in out.columns else [])
            hidden = [c for c in out.columns if c.startswith("__") or c.lower() in {a.lower() for a in self.auto}]
            out = out.orderBy(*D.order_of(self.by), *order).drop(*hidden) if self.by else out.orderBy(*order).drop(*hidden)
            real = {c.lower(): c for c in out.columns}
            keep = [real[n.lower()] for n in self.keep if n.lower() in real] if self.keep is not None else out.columns
            keep = [c for c in keep if c.lower() not in {n.lower() for n in self.drop}]
            out = out.select(*dict.fromkeys(keep))
            for n, items in self.meta.items():
                if n in {c.lower() for c in keep}:
                    out = with_metadata(out, real[n], **items)
            out = D.dataset_options(out, rename={real[a.lower()]: b for a, b in self.rename.items() if a.lower() in real})
            self.p.save(f"{target}{opts}", out)


def compile_text(c: Column, kind: str) -> Column:
    from .expressions import text_of

    return text_of(c, kind) if kind != "d" else F.coalesce(c.cast("string"), F.lit("."))
