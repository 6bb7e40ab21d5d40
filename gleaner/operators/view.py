"""V*, L*, A*, W*: the result view (filter, search, select, sort, page, counts, widths).

``res`` is any result DataFrame ``(page_id, original_index, is_empty, <data columns>)``;
most operators also run on plain tables by naming the data columns. Per-page work is
partitioned by ``page_id`` (a page's rows are bounded by its size); global orderings use
Spark's range-partitioned sort, and top-k windows get Spark's partial window-group limit
before the shuffle, so a hot key never concentrates more than ``k`` rows per task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import js_trim, width_px

HELPER_COLS = ("page_id", "original_index", "is_empty")


def data_columns(res: DataFrame, exclude=HELPER_COLS) -> list[str]:
    """V4: the searchable/sortable columns (helper columns excluded)."""
    return [c for c in res.columns if c not in exclude]


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def drop_empty(res: DataFrame) -> DataFrame:
    """V1: hide rows whose values are all blank."""
    return res.filter(~F.col("is_empty"))


def search_pred(cols: list[str], term: str) -> Column:
    t = term.lower()
    if not cols:
        return F.lit(False)
    return F.exists(F.array(*[F.coalesce(_q(c).cast("string"), F.lit("")) for c in cols]), lambda v: F.lower(v).contains(t))


def search(res: DataFrame, term: str, cols: list[str] | None = None, hide_empty: bool = True) -> DataFrame:
    """V2: rows where any data column contains ``term`` (case-insensitive). A blank term
    keeps everything; an active search also hides empty rows (the view forces V1)."""
    if term is None or term == "":
        return res
    cols = cols if cols is not None else data_columns(res)
    out = res.filter(search_pred(cols, term))
    return out.filter(~F.col("is_empty")) if hide_empty and "is_empty" in res.columns else out


def filter_contains(res: DataFrame, terms: dict[str, str]) -> DataFrame:
    """V3: AND of per-column case-insensitive substring filters (blank terms ignored)."""
    pred = F.lit(True)
    for c, t in terms.items():
        if t:
            pred = pred & F.lower(F.coalesce(_q(c).cast("string"), F.lit(""))).contains(t.lower())
    return res.filter(pred)


def search_pages(tabs: DataFrame, term: str, title_col: str = "title", url_col: str = "url") -> DataFrame:
    """V5: pages whose title or URL contains ``term`` (case-insensitive)."""
    t = (term or "").lower()
    return tabs.filter(
        F.lower(F.coalesce(F.col(title_col), F.lit(""))).contains(t) | F.lower(F.coalesce(F.col(url_col), F.lit(""))).contains(t)
    )


def search_presets(presets: DataFrame, term: str, by=("name",)) -> DataFrame:
    """V6: presets whose ``by`` fields contain ``term`` (case-insensitive)."""
    t = (term or "").lower()
    pred = F.lit(False)
    for c in by:
        pred = pred | F.lower(F.col(c)).contains(t)
    return presets.filter(pred)


def suggest_presets(presets: DataFrame, term: str) -> DataFrame:
    """V7: name or main selector contains the trimmed lower-case term; blank -> all."""
    t = (term or "").strip().lower()
    if not t:
        return presets
    return presets.filter(
        F.lower(F.col("name")).contains(t) | F.lower(F.col("config.main_selector")).contains(t)
    )


def select_rows_by_key(res: DataFrame, keys: DataFrame) -> DataFrame:
    """V8: the chosen rows that are still in the (filtered) result: semi join on
    ``(page_id, original_index)``; Spark/AQE choose broadcast vs shuffle by measured size."""
    return res.join(keys.select("page_id", "original_index").distinct(), ["page_id", "original_index"], "left_semi")


def rows_to_export(res: DataFrame, keys: DataFrame | None, show_empty: bool) -> DataFrame:
    """V9, per page: the selection when it is non-empty and smaller than the page's total
    (empty rows included); otherwise all rows, or the non-empty ones when empties are
    hidden. Decided with per-page counts joined back, never on the driver."""
    base = res if show_empty else drop_empty(res)
    if keys is None:
        return base
    k = keys.select("page_id", "original_index").distinct()
    sel_n = k.groupBy("page_id").agg(F.count(F.lit(1)).alias("_sel"))
    tot_n = res.groupBy("page_id").agg(F.count(F.lit(1)).alias("_tot"))
    use_sel = sel_n.join(tot_n, "page_id").filter(F.col("_sel") != F.col("_tot")).select("page_id")
    chosen = res.join(use_sel, "page_id", "left_semi").join(k, ["page_id", "original_index"], "left_semi")
    rest = base.join(use_sel, "page_id", "left_anti")
    return chosen.unionByName(rest)


def hide(res: DataFrame, cols) -> DataFrame:
    """Hide columns."""
    return res.drop(*cols)


def filter_ready(updates: DataFrame, marker: str | None = None, status_col: str = "status", url_col: str = "url") -> DataFrame:
    """Page updates that finished loading (and whose URL carries ``marker``)."""
    pred = F.col(status_col) == "complete"
    if marker:
        pred = pred & F.coalesce(F.col(url_col).contains(marker), F.lit(False))
    return updates.filter(pred)


# -- sort / page ------------------------------------------------------------------------
def sort_key(c: str, natural: bool = False) -> Column:
    """L1 comparator: case-insensitive; ``natural`` zero-pads digit runs so 'a10' > 'a9'."""
    x = F.lower(F.coalesce(_q(c).cast("string"), F.lit("")))
    if natural:
        x = F.regexp_replace(x, r"(\d+)", "000000000000000000$1")
        x = F.regexp_replace(x, r"0*(\d{19})", "$1")
    return x


def sort_by(res: DataFrame, spec, natural: bool = False, tiebreak=("page_id", "original_index")) -> DataFrame:
    """L1: global sort by data columns, ties in document order (range-partitioned sort).
    Text columns (all scraped cells) compare case-insensitively; other types natively."""
    types = dict(res.dtypes)
    keys = []
    for c, asc in spec:
        k = sort_key(c, natural) if types.get(c) == "string" else _q(c)
        keys.append(k.asc() if asc else k.desc())
    keys += [F.col(t).asc() for t in tiebreak if t in res.columns]
    return res.orderBy(*keys)


def page_count(n, size: int) -> Column:
    """A5: ``max(1, ceil(n / size))``."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.greatest(F.lit(1), F.ceil(n / F.lit(size))).cast("long")


def clamp_page(index, n, size: int) -> Column:
    """L3: page index clamped into ``[0, page_count - 1]``."""
    idx = F.lit(index) if isinstance(index, int) else index
    return F.least(F.greatest(idx, F.lit(0)), page_count(n, size) - 1)


def page_global(res_sorted: DataFrame, index: int, size: int) -> DataFrame:
    """L2 over a globally sorted result: rows ``[index*size, index*size+size)``. Spark runs
    this as a bounded top-(offset+limit) per partition and one small merge."""
    return res_sorted.offset(max(index, 0) * size).limit(size)


def page_per_group(res: DataFrame, index: int, size: int, order=None, group: str = "page_id") -> DataFrame:
    """L2/L3 per page (one result table per page, as in the view): rows of page ``index``
    (clamped into range) by ``order`` (default document order). Adds ``display_index``."""
    order = order or [F.col("original_index")]
    w = Window.partitionBy(group).orderBy(*order)
    ranked = res.withColumn("_rn", F.row_number().over(w)).withColumn(
        "_n", F.count(F.lit(1)).over(Window.partitionBy(group))
    )
    idx = clamp_page(index, F.col("_n"), size)
    lo = idx * size
    return ranked.filter((F.col("_rn") > lo) & (F.col("_rn") <= lo + size)).select(
        *res.columns, F.col("_rn").cast("int").alias("display_index")
    )


@dataclass
class ViewSpec:
    show_empty: bool = False
    column_filters: dict = field(default_factory=dict)
    term: str = ""
    sort: list = field(default_factory=list)
    page_index: int = 0
    page_size: int = 20
    hidden: list = field(default_factory=list)


def view(res: DataFrame, spec: ViewSpec) -> DataFrame:
    """L4: empty filter -> column filters -> global search -> sort -> page (per page_id)."""
    out = res if spec.show_empty else drop_empty(res)
    out = filter_contains(out, spec.column_filters)
    out = search(out, spec.term)
    order = [(sort_key(c).asc() if a else sort_key(c).desc()) for c, a in spec.sort] + [F.col("original_index")]
    out = page_per_group(out, spec.page_index, spec.page_size, order)
    return hide(out, spec.hidden)


# -- windows -------------------------------------------------------------------------------
def with_display_index(res: DataFrame, show_empty: bool = False) -> DataFrame:
    """1-based position among the rows left after V1, in document order per page."""
    base = res if show_empty else drop_empty(res)
    w = Window.partitionBy("page_id").orderBy("original_index")
    return base.withColumn("display_index", F.row_number().over(w).cast("int"))


def top_k_per_group(df: DataFrame, group, order, k: int) -> DataFrame:
    """Newest/first ``k`` rows per group; the ``rn <= k`` filter becomes a partial
    window-group limit before the shuffle (bounded rows per group per task)."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def recent_selectors(uses: DataFrame, k: int = 5, user: str = "user_id", sel: str = "selector", ts: str = "ts") -> DataFrame:
    """Per user, trimmed non-blank selectors, most recent use first, distinct, ``k``
    kept. Pre-aggregates ``(user, selector)`` (map-side) before the top-k window."""
    s = js_trim(F.col(sel))
    latest = (
        uses.select(F.col(user).alias("user_id"), s.alias("selector"), F.col(ts).alias("ts"))
        .filter(F.col("selector") != "")
        .groupBy("user_id", "selector")
        .agg(F.max("ts").alias("last_used"))
    )
    w = Window.partitionBy("user_id").orderBy(F.col("last_used").desc(), F.col("selector"))
    return latest.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumn(
        "rank", F.col("rank").cast("int")
    )


def remove_recent(uses: DataFrame, selector: str, sel: str = "selector") -> DataFrame:
    """Forget one recent selector (after trimming)."""
    return uses.filter(js_trim(F.col(sel)) != selector.strip())


def first_n(res: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of each page in document order."""
    return res.filter(F.col("original_index") < n)


# -- aggregates -------------------------------------------------------------------------
def row_counts(res: DataFrame) -> DataFrame:
    """A1/A2: rows per page with empty / non-empty counts (partial aggregation)."""
    return res.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("is_empty")).alias("empty_rows"),
        F.count_if(~F.col("is_empty")).alias("non_empty_rows"),
    )


def view_counts(res: DataFrame, term: str, keys: DataFrame | None = None) -> DataFrame:
    """A3: per page, rows shown after V1+V2 and rows selected among them."""
    cols = data_columns(res)
    shown = ~F.col("is_empty") & (search_pred(cols, term) if term else F.lit(True))
    base = res
    if keys is not None:
        k = keys.select("page_id", "original_index").distinct().withColumn("_sel", F.lit(True))
        base = res.join(k, ["page_id", "original_index"], "left")
    else:
        base = res.withColumn("_sel", F.lit(False))
    return base.groupBy("page_id").agg(
        F.count_if(shown).alias("filtered_rows"),
        F.count_if(shown & F.coalesce(F.col("_sel"), F.lit(False))).alias("selected_rows"),
    )


def column_widths(
    res: DataFrame, columns: list[str] | None = None, sample: int = 50, char_px: int = 7, pad: int = 20,
    lo: int = 80, hi: int = 300, show_empty: bool = False,
) -> DataFrame:
    """A6 + F22 per page: max value length over the first ``sample`` shown rows, with the
    header length as floor, turned into a pixel width. Long form ``(page_id, column,
    max_len, width)``. Panel: (50, 7, 20, 80, 300); full view: (100, 8, 24, 100, 400)."""
    cols = columns if columns is not None else data_columns(res)
    shown = with_display_index(res, show_empty).filter(F.col("display_index") <= sample)
    agg = shown.groupBy("page_id").agg(
        *[F.max(F.length(F.coalesce(_q(c).cast("string"), F.lit("")))).alias(f"_m{i}") for i, c in enumerate(cols)]
    )
    stacked = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.greatest(F.col(f"_m{i}"), F.lit(len(c))).alias("max_len")) for i, c in enumerate(cols)])
    )
    out = agg.select("page_id", stacked.alias("w"))
    return out.select(
        "page_id", F.col("w.column").alias("column"), F.col("w.max_len").cast("int").alias("max_len"),
        width_px(F.col("w.max_len"), char_px, pad, lo, hi).cast("int").alias("width"),
    )


def scrape_metrics(res: DataFrame) -> DataFrame:
    """Items scraped and column count (one row)."""
    n_cols = len(data_columns(res))
    return res.agg(F.count(F.lit(1)).alias("items_scraped")).withColumn("column_count", F.lit(n_cols))


def export_metrics(res: DataFrame, name: str = "export"):
    """Attach row/column counters that fill in while the DataFrame is written.
    Returns ``(observed_df, observation)``; read ``observation.get`` after the write."""
    from pyspark.sql import Observation

    obs = Observation(name)
    n_cols = len(data_columns(res))
    return res.observe(obs, F.count(F.lit(1)).alias("rows"), F.lit(n_cols).alias("columns")), obs
