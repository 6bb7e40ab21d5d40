"""K1-K8: result sinks. Every writer is distributed (one file per partition or per page);
only K6 (the presets document, whose size is checked) is assembled in one task."""

from __future__ import annotations

import os
import zipfile
from xml.sax.saxutils import escape as _xml_escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import tsv_escape

XLSX_MAX_ROWS = 1_048_576


class NoDataError(ValueError):
    """K8: export of an empty result."""


def _guard(df: DataFrame) -> None:
    if df.isEmpty():
        raise NoDataError("No data to export")


def _display(res: DataFrame, columns: list[str] | None, names: list[str] | None) -> DataFrame:
    cols = columns if columns is not None else [c for c in res.columns if c not in ("page_id", "original_index", "is_empty")]
    names = names if names is not None else cols
    return res.select(*[F.col(f"`{c}`").cast("string").alias(n) for c, n in zip(cols, names)])


def write_csv(res: DataFrame, path: str, columns=None, names=None, mode: str = "overwrite") -> None:
    """K1: header, every field quoted, inner quotes doubled, LF line ends, null -> "".
    One file per partition, each with the header."""
    out = _display(res, columns, names)
    _guard(out)
    (
        out.write.mode(mode)
        .option("header", True)
        .option("quoteAll", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("nullValue", "")
        .option("emptyValue", "")
        .option("lineSep", "\n")
        .csv(path)
    )


def tsv_line(cols: list[Column]) -> Column:
    """K3: one row as TSV: each value stringified ('' for null) and escaped, tab-joined."""
    if not cols:
        return F.lit("")
    return F.concat_ws("\t", *[tsv_escape(F.coalesce(c.cast("string"), F.lit(""))) for c in cols])


def write_tsv(res: DataFrame, path: str, columns=None, names=None, mode: str = "overwrite") -> None:
    """K2: TSV with a header per file. Values and header names are escaped first (F12), so
    the JVM text writer needs no quoting at all."""
    out = _display(res, columns, names)
    _guard(out)
    escaped = out.select(*[tsv_escape(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(_tsv_name(c)) for c in out.columns])
    (
        escaped.write.mode(mode)
        .option("header", True)
        .option("sep", "\t")
        .option("quote", "")
        .option("escapeQuotes", False)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("nullValue", "")
        .option("emptyValue", "")
        .option("lineSep", "\n")
        .csv(path)
    )


def _tsv_name(name: str) -> str:
    return name.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r")


# -- K4: XLSX (one workbook per page, written by the task that holds the page's rows) -------
def _col_letter(i: int) -> str:
    s = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        s = chr(65 + r) + s
    return s


def _cell(ref: str, v) -> str:
    text = "" if v is None else str(v)
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{_xml_escape(text)}</t></is></c>'


def xlsx_bytes_to(path: str, header: list[str], rows) -> int:
    """Write a one-sheet workbook (sheet ``Data``) with a header row; '' for null."""
    n = 0
    sheet_rows = ["<row r=\"1\">" + "".join(_cell(f"{_col_letter(j)}1", h) for j, h in enumerate(header)) + "</row>"]
    for r in rows:
        n += 1
        if n + 1 > XLSX_MAX_ROWS:
            raise ValueError("too many rows for one XLSX sheet")
        rn = n + 1
        sheet_rows.append(f'<row r="{rn}">' + "".join(_cell(f"{_col_letter(j)}{rn}", v) for j, v in enumerate(r)) + "</row>")
    sheet = (
        '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
        '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
        + "".join(sheet_rows) + "</sheetData></worksheet>"
    )
    files = {
        "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
        '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
        '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        '<Default Extension="xml" ContentType="application/xml"/>'
        '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
        '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
        "</Types>",
        "_rels/.rels": '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
        '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
        '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/>'
        "</Relationships>",
        "xl/workbook.xml": '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
        '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
        'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
        '<sheets><sheet name="Data" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
        '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
        '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/>'
        "</Relationships>",
        "xl/worksheets/sheet1.xml": sheet,
    }
    tmp = path + ".part"
    with zipfile.ZipFile(tmp, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in files.items():
            z.writestr(name, body)
    os.replace(tmp, path)  # a retried task rewrites the same file atomically
    return n


def write_xlsx(res: DataFrame, path: str, columns=None, names=None, by: str = "page_id") -> DataFrame:
    """K4: one workbook per ``by`` value, written on the executors into ``path`` (a shared
    folder). Returns ``(key, file, rows)`` per workbook; raises on empty input."""
    cols = columns if columns is not None else [c for c in res.columns if c not in ("page_id", "original_index", "is_empty")]
    header = names if names is not None else cols
    order = ["original_index"] if "original_index" in res.columns else []
    src = res.select(F.col(by).alias("_k"), *[F.col(o) for o in order], *[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(cols)])
    _guard(src)
    os.makedirs(path, exist_ok=True) if "://" not in path else None
    ccount = len(cols)

    def write_group(pdf: pd.DataFrame) -> pd.DataFrame:
        if order:
            pdf = pdf.sort_values(order)
        key = pdf["_k"].iloc[0]
        fn = os.path.join(path, f"{by}={key}.xlsx")
        vals = pdf[[f"c{i}" for i in range(ccount)]].astype(object).where(pdf[[f"c{i}" for i in range(ccount)]].notna(), "")
        n = xlsx_bytes_to(fn, header, vals.itertuples(index=False, name=None))
        return pd.DataFrame({"key": [str(key)], "file": [fn], "rows": [n]})

    import sys

    from gleaner.sources.dom import ship_by_value

    ship_by_value(sys.modules[__name__])
    return src.groupBy("_k").applyInPandas(write_group, "key string, file string, rows long")


def sheet_values(res: DataFrame, columns=None, names=None) -> DataFrame:
    """K5: spreadsheet payload rows ``(page_id, row_number, values_json)``: row 0 is the
    header, then one JSON array of strings per row ('' for missing)."""
    cols = columns if columns is not None else [c for c in res.columns if c not in ("page_id", "original_index", "is_empty")]
    header = names if names is not None else cols
    if not cols:
        raise ValueError("No columns to export")
    _guard(res)
    body = res.select(
        "page_id", (F.col("original_index") + 1).alias("row_number") if "original_index" in res.columns else F.lit(1).alias("row_number"),
        F.to_json(F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in cols])).alias("values_json"),
    )
    import json

    head = res.select("page_id").distinct().select(
        "page_id", F.lit(0).alias("row_number"), F.lit(json.dumps(list(header), ensure_ascii=False, separators=(",", ":"))).alias("values_json")
    )
    return head.unionByName(body)


def write_presets(presets: DataFrame, path: str, version: int = 1) -> None:
    """``{"version": 1, "presets": [...]}`` as one JSON document, in ``seq`` order.
    One document, as the import reads it, so it is built in one task whatever its size."""
    order = "seq" if "seq" in presets.columns else "created_at"
    item = F.struct(
        F.col("id"), F.col("name"),
        F.struct(F.col("config.main_selector").alias("mainSelector"),
                 F.transform("config.columns", lambda c: F.struct(c["name"].alias("name"), c["selector"].alias("selector"), c["key"].alias("key"))).alias("columns")).alias("config"),
        F.col("created_at").alias("createdAt"),
    )
    doc = presets.select(F.struct(F.col(order).alias("o"), item.alias("p")).alias("x")).agg(
        F.to_json(F.struct(F.lit(version).alias("version"), F.transform(F.array_sort(F.collect_list("x")), lambda x: x["p"]).alias("presets"))).alias("value")
    )
    doc.coalesce(1).write.mode("overwrite").text(path)


def write_results(res: DataFrame, path: str, partition_by: str | None = None, mode: str = "append") -> None:
    """K7: the result store (parquet; optionally one folder per scrape id)."""
    w = res.write.mode(mode)
    if partition_by and partition_by in res.columns:
        w = w.partitionBy(partition_by)
    w.parquet(path)
