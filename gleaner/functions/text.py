"""Scalar string functions as Spark Columns (all JVM-side, no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters JavaScript's String.prototype.trim removes (ECMAScript
# WhiteSpace and LineTerminator): TAB, LF, VT, FF, CR, SPACE, NBSP, OGHAM SPACE MARK,
# U+2000..U+200A, LINE SEPARATOR, PARAGRAPH SEPARATOR, NARROW NBSP, MEDIUM MATH SPACE,
# IDEOGRAPHIC SPACE, BOM.
JS_WHITESPACE = (
    "\t\n\u000b\u000c\r\u0020\u00a0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# XPath/XML whitespace (normalize-space): space, tab, CR, LF.
XML_WS_CLASS = "[ \\t\\r\\n]+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def js_trim(c) -> Column:
    """trim like JavaScript (Unicode whitespace incl. NBSP and BOM); null stays null."""
    return F.trim(_c(c), F.lit(JS_WHITESPACE))


def js_blank(c) -> Column:
    """True when the value is null or only JavaScript whitespace."""
    return F.coalesce(js_trim(c) == F.lit(""), F.lit(True))


def normalize_space(c) -> Column:
    """XPath normalize-space: collapse XML whitespace runs, strip the ends."""
    return F.trim(F.regexp_replace(_c(c), XML_WS_CLASS, " "), F.lit(" "))


def substr_from(c, k: int) -> Column:
    """XPath substring(s, k) with a 1-based integer start (k <= 1 keeps everything)."""
    return F.substring(_c(c), max(int(k), 1), 2**31 - 1) if k >= 1 else _c(c)


def _locate(s: Column, d: Column) -> Column:
    # 1-based position of the first occurrence of d in s, 0 when absent
    return F.call_function("locate", d, s)


def substring_before(c, d) -> Column:
    """XPath substring-before: '' when the delimiter is absent."""
    return xp_substring_before(_c(c), F.lit(d) if isinstance(d, str) else d)


def substring_after(c, d) -> Column:
    """XPath substring-after: text after the first occurrence; '' when absent."""
    return xp_substring_after(_c(c), F.lit(d) if isinstance(d, str) else d)


def xp_substring_before(s: Column, d: Column) -> Column:
    """F5 over Columns: '' when ``d`` is absent, '' for an empty ``d``."""
    pos = _locate(s, d)
    return F.when(pos > 0, F.call_function("substr", s, F.lit(1), pos - 1)).otherwise(F.lit(""))


def xp_substring_after(s: Column, d: Column) -> Column:
    """F6 over Columns: text after the first occurrence of ``d``; '' when absent."""
    pos = _locate(s, d)
    return F.when(pos > 0, F.call_function("substr", s, pos + F.length(d))).otherwise(F.lit(""))


def translate(c, src: str, dst: str) -> Column:
    """XPath translate (characters of ``src`` without a partner in ``dst`` are deleted)."""
    return F.translate(_c(c), src, dst)


def tsv_escape(c) -> Column:
    """backslash first, then TAB, LF, CR as two-character escapes."""
    x = _c(c)
    x = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    x = F.replace(x, F.lit("\t"), F.lit("\\t"))
    x = F.replace(x, F.lit("\n"), F.lit("\\n"))
    return F.replace(x, F.lit("\r"), F.lit("\\r"))


def csv_quote(c) -> Column:
    """wrap in double quotes, doubling inner quotes (null -> "")."""
    return F.concat(F.lit('"'), F.replace(F.coalesce(_c(c), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def as_text(c) -> Column:
    """stringify; null -> ''."""
    return F.coalesce(_c(c).cast("string"), F.lit(""))


def truncate_cell(c, n: int = 100) -> Column:
    """cut to ``n`` characters and append '...' when longer."""
    x = _c(c)
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("..."))).otherwise(x)


def single_line(c) -> Column:
    """F16: runs of CR/LF become one space."""
    return F.regexp_replace(_c(c), "[\\r\\n]+", " ")


def slugify(c) -> Column:
    """Lower-case, runs of non-alphanumerics -> '-', no leading/trailing '-'."""
    s = F.regexp_replace(F.lower(_c(c)), "[^a-z0-9]+", "-")
    return F.regexp_replace(s, "^-+|-+$", "")


def export_name(title_or_url, ts, is_url: bool = False) -> Column:
    """export file stem: '<title> - YYYY-MM-DD', 'Data Export - YYYY-MM-DD' when blank,
    or for a URL the slug of it plus the timestamp (UTC)."""
    day = F.date_format(_c(ts), "yyyy-MM-dd")
    x = _c(title_or_url)
    if is_url:
        return F.concat(slugify(x), F.lit("-"), F.date_format(_c(ts), "yyyy-MM-dd-HHmmss"))
    return F.concat(
        F.when(js_blank(x), F.lit("Data Export")).otherwise(js_trim(x)), F.lit(" - "), day
    )


def preset_id(ts=None) -> Column:
    """epoch milliseconds as string (the id of a new preset)."""
    return F.unix_millis(_c(ts) if ts is not None else F.current_timestamp()).cast("string")


def data_attrs(attrs) -> Column:
    """the ``data-*`` attribute names of an attribute map, in the attributes' order."""
    return (F.map_keys(F.map_filter(_c(attrs), lambda k, v: k.startswith("data-"))))


def width_px(maxlen, ppc: int, pad: int, lo: int, hi: int) -> Column:
    """column width estimate ``clamp(maxlen*ppc + pad, lo, hi)``."""
    return F.least(F.greatest(_c(maxlen) * ppc + pad, F.lit(lo)), F.lit(hi))
