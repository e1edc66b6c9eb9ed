"""Listings of bounded results: text, HTML, RTF, PDF and XLSX, and PRINT with groups and totals."""

from __future__ import annotations

import html
import zipfile
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import formats

MOST_ROWS = 10_000


def rows_of(df: DataFrame, formats_by: dict[str, str] | None = None, most: int = MOST_ROWS, catalog=None) -> tuple[list[str], list[list[str]]]:
    """Column names and formatted cells of at most `most` rows; more rows are an error, not a cut."""
    cols = []
    for f in df.schema.fields:
        fmt = (formats_by or {}).get(f.name) or f.metadata.get("format")
        kind = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        if fmt:
            shown = F.trim(formats.put(c, fmt, catalog))
        elif kind in ("double", "float", "decimal"):
            shown = F.coalesce(formats.best(c), F.lit("."))
        elif kind in ("string", "boolean"):
            shown = F.coalesce(c.cast("string"), F.lit(""))
        else:
            shown = F.coalesce(c.cast("string"), F.lit("."))
        cols.append(shown.alias(f.name))
    got = df.select(*cols).limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a listing takes at most {most} rows")
    return df.columns, [list(r) for r in got]


def text(df: DataFrame, title: str | None = None, obs: bool = True, labels: bool = False, width: int = 80, **options) -> str:
    """A fixed-width table; columns that don't fit the line go to further panels."""
    names, rows = rows_of(df, **options)
    heads = [df.schema[n].metadata.get("label", n) if labels else n for n in names]
    numeric = [df.schema[n].dataType.typeName() not in ("string", "boolean", "date") for n in names]
    sizes = [max([len(h), *(len(r[k]) for r in rows)]) for k, h in enumerate(heads)]
    lead = max(3, len(str(len(rows)))) if obs else 0
    panels, now, used = [], [], lead
    for k, s in enumerate(sizes):
        if now and used + s + 2 > width:
            panels.append(now)
            now, used = [], lead
        now.append(k)
        used += s + 2
    panels.append(now)
    just = lambda s, k: s.rjust(sizes[k]) if numeric[k] else s.ljust(sizes[k])
    out = [title.center(width).rstrip(), ""] if title else []
    for p in panels:
        out.append("  ".join(([" " * (lead - 3) + "Obs"] if obs else []) + [just(heads[k], k) for k in p]).rstrip())
        out += ["  ".join(([str(n + 1).rjust(lead)] if obs else []) + [just(r[k], k) for k in p]).rstrip() for n, r in enumerate(rows)]
        out.append("")
    return "\n".join(out)


def print_report(df: DataFrame, var: Sequence[str] | None = None, sums: Sequence[str] = (), by: Sequence[str] = (), where=None) -> DataFrame:
    """PRINT with SUM and BY: rows, subtotals of each BY group and a grand total, marked in _SUM_."""
    df = df.where(where) if where is not None else df
    keep = list(dict.fromkeys([*by, *(var or [c for c in df.columns if c not in by])]))
    detail = df.select(*keep, F.lit(None).cast("string").alias("_SUM_"))
    if not sums:
        return detail
    levels = [list(by[: k + 1]) for k in range(len(by))] + [[]]
    totals = df.groupingSets([[F.col(c) for c in s] for s in levels], *[F.col(c) for c in by]).agg(F.grouping_id().alias("__g"), *[F.sum(s).alias(s) for s in sums]) if by else df.agg(*[F.sum(s).alias(s) for s in sums]).withColumn("__g", F.lit(0))
    mark = F.when(F.col("__g") == (1 << len(by)) - 1, "total").otherwise("subtotal")
    totals = totals.withColumn("_SUM_", mark).drop("__g")
    return detail.unionByName(totals, allowMissingColumns=True).select(*keep, "_SUM_").orderBy(*[F.col(b).asc_nulls_last() for b in by], F.col("_SUM_").asc_nulls_first())


def to_html(df: DataFrame, path: str, title: str = "", **options) -> None:
    names, rows = rows_of(df, **options)
    cell = lambda tag, v: f"<{tag}>{html.escape(v)}</{tag}>"
    body = "\n".join("<tr>" + "".join(cell("td", v) for v in r) + "</tr>" for r in rows)
    head = "<tr>" + "".join(cell("th", n) for n in names) + "</tr>"
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>table{{border-collapse:collapse}}td,th{{border:1px solid #999;padding:2px 6px}}</style></head><body><h1>{html.escape(title)}</h1><table><thead>{head}</thead><tbody>\n{body}\n</tbody></table></body></html>\n')


def _rtf(s: str) -> str:
    return "".join("\\" + c if c in "\\{}" else c if ord(c) < 128 else f"\\u{ord(c) if ord(c) < 32768 else ord(c) - 65536}?" for c in s)


def to_rtf(df: DataFrame, path: str, title: str = "", **options) -> None:
    names, rows = rows_of(df, **options)
    edges = "".join(f"\\cellx{1800 * (k + 1)}" for k in range(len(names)))
    line = lambda r: "\\trowd" + edges + "".join(f"\\intbl {_rtf(v)}\\cell" for v in r) + "\\row"
    with open(path, "w", encoding="ascii") as f:
        f.write("{\\rtf1\\ansi\\deff0{\\fonttbl{\\f0 Courier New;}}\n\\b " + _rtf(title) + "\\b0\\par\n" + "\n".join(map(line, [names, *rows])) + "\n}\n")


def to_pdf(df: DataFrame, path: str, title: str = "", lines_per_page: int = 60, **options) -> None:
    """The text listing on PDF pages in a built-in fixed-width font."""
    lines = text(df, title, width=95, **options).split("\n")
    pages = [lines[k : k + lines_per_page] for k in range(0, max(1, len(lines)), lines_per_page)]
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Kids [" + " ".join(f"{4 + 2 * k} 0 R" for k in range(len(pages))) + f"] /Count {len(pages)} >>", "<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>"]
    for k, page in enumerate(pages):
        shown = [p.encode("cp1252", "replace").decode("latin-1").replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)") for p in page]
        stream = "BT /F1 9 Tf 11 TL 36 806 Td\n" + "\n".join(f"({s}) Tj T*" for s in shown) + "\nET"
        objects += [f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * k} 0 R >>", f"<< /Length {len(stream.encode('latin-1'))} >>\nstream\n{stream}\nendstream"]
    out, places = b"%PDF-1.4\n", []
    for n, o in enumerate(objects):
        places.append(len(out))
        out += f"{n + 1} 0 obj\n{o}\nendobj\n".encode("latin-1")
    start = len(out)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{p:010d} 00000 n \n".encode() for p in places)
    out += f"trailer << /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{start}\n%%EOF\n".encode()
    with open(path, "wb") as f:
        f.write(out)


def to_excel(df: DataFrame, path: str, sheet: str = "Sheet1", **options) -> None:
    """One sheet as a minimal XLSX package; numbers stay numbers."""
    names, rows = rows_of(df, **options)
    numeric = [df.schema[n].dataType.typeName() in ("double", "float", "integer", "long", "short", "byte") for n in names]

    def ref(k: int, n: int) -> str:
        s, k = "", k + 1
        while k:
            k, r = divmod(k - 1, 26)
            s = chr(65 + r) + s
        return f"{s}{n}"

    def cell(v: str, k: int, n: int) -> str:
        try:
            if n > 1 and numeric[k]:
                return "" if v in (".", "") else f'<c r="{ref(k, n)}"><v>{float(v)!r}</v></c>'
        except ValueError:
            pass
        return f'<c r="{ref(k, n)}" t="inlineStr"><is><t xml:space="preserve">{html.escape(v)}</t></is></c>'

    data = "".join(f'<row r="{n}">' + "".join(cell(v, k, n) for k, v in enumerate(r)) + "</row>" for n, r in enumerate([names, *rows], 1))
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{html.escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{data}</sheetData></worksheet>',
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, head + body)
