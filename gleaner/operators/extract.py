"""R1-R6 row selection and P1-P12 column extraction over a parsed ``dom`` DataFrame.

Row selection is ``posexplode(filter(<selector node set>, is_html))`` inside one stage; the
position is ``original_index`` (document order, before any later filtering). Extraction
columns are Catalyst expressions evaluated on the exploded row; nothing leaves the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import js_trim
from gleaner.functions.xpath import (
    ATTRS,
    NODES,
    Env,
    UnsupportedXPath,
    XPathSyntaxError,
    attr_of,
    compile_nodes,
    compile_set,
    compile_value,
    strval,
)

NODE_COL = "__node"


@dataclass(frozen=True)
class ColumnDef:
    name: str
    selector: str
    key: str | None = None

    @property
    def out_key(self) -> str:
        """The storage key is ``key`` when non-empty, else ``name``."""
        return self.key or self.name


@dataclass(frozen=True)
class ScrapeConfig:
    main_selector: str
    columns: tuple[ColumnDef, ...] = field(default_factory=tuple)

    @staticmethod
    def of(main_selector: str, columns) -> "ScrapeConfig":
        cols = tuple(c if isinstance(c, ColumnDef) else ColumnDef(*c) if isinstance(c, (tuple, list)) else ColumnDef(**c) for c in columns)
        return ScrapeConfig(main_selector, cols)

    def to_dict(self) -> dict:
        return {
            "main_selector": self.main_selector,
            "columns": [{"name": c.name, "selector": c.selector, "key": c.key} for c in self.columns],
        }


DEFAULT_COLUMNS = (ColumnDef("Text", "."),)


def normalize_config(cfg: ScrapeConfig | None, seed_selector: str = "") -> ScrapeConfig:
    """No stored config -> one ``Text`` column over ``.``; an empty column list falls
    back to the same default; ``seed_selector`` is used when there is no main selector."""
    if cfg is None:
        return ScrapeConfig(seed_selector, DEFAULT_COLUMNS)
    cols = cfg.columns if cfg.columns else DEFAULT_COLUMNS
    return ScrapeConfig(cfg.main_selector or seed_selector, tuple(cols))


def dom_env(node: Column | None = None) -> Env:
    return Env(F.col("nodes"), F.col("text"), node if node is not None else F.lit(0))


def matched_nodes(selector: str, html_only: bool = True) -> Column:
    """ARRAY<INT> of matched nodes in document order (HTML elements only by default).

    Raises XPathSyntaxError for malformed selectors, as the reference's evaluate does."""
    env = dom_env()
    arr = compile_nodes(selector, env)
    if html_only:
        arr = F.filter(arr, lambda i: F.get(env.nodes, i)["is_html"])
    return arr


def select_rows(dom: DataFrame, selector: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per selected HTML element: ``(page_id, original_index, __node, ...)``."""
    return dom.select("page_id", *keep, F.posexplode(matched_nodes(selector)).alias("original_index", NODE_COL))


def select_values(dom: DataFrame, selector: str, within: str | None = None) -> DataFrame:
    """Values matched by ``selector`` (elements as text, attribute and text-node
    values), optionally evaluated from each node matched by ``within``. A malformed
    selector gives no rows (the reference returns an empty list). Values are made per page, so
    only they are exploded."""
    none = F.array().cast("array<string>")

    def values(i: Column) -> Column:
        env = dom_env(i)
        try:
            v, _ = compile_value(selector, env)
        except XPathSyntaxError:
            return none
        if v.kind == ATTRS:
            return v.col if not v.single else F.filter(F.array(v.col), lambda x: x.isNotNull())
        if v.kind != NODES:
            return none
        n = lambda k: F.get(env.nodes, k)
        kept = F.filter(v.col if not v.single else F.array(v.col), lambda k: n(k)["is_html"] | (n(k)["tag"] == F.lit("#text")))
        return F.transform(kept, lambda k: strval(env, k))

    contexts = matched_nodes(within) if within else F.array(F.lit(0))
    per = dom.select("page_id", F.posexplode(F.transform(contexts, values)).alias("context_index", "values"))
    return per.select("page_id", "context_index", F.posexplode("values").alias("value_index", "value"))


def count_matches(dom: DataFrame, selector: str) -> DataFrame:
    """Matches per page, nodes of every kind and attributes counted; 0 when the selector is malformed."""
    try:
        cnt = F.size(compile_set(selector, dom_env())[0])
    except XPathSyntaxError:
        cnt = F.lit(0)
    return dom.select("page_id", cnt.cast("long").alias("match_count"))


def validate_selector(dom: DataFrame, selector: str) -> DataFrame:
    """One row ``(selector, match_count, error)`` over all pages, counting HTML elements.

    Syntax errors give ``(0, 'Invalid XPath')``, valid selectors outside the subset ``(0, 'Unsupported
    XPath: ...')``, without running a job; a valid selector
    (of attributes too, which are no elements) has no error and is counted with a partial
    aggregate (map-side sums, one tiny final merge)."""
    spark = dom.sparkSession
    try:
        nodes = compile_set(selector, dom_env())[1]
    except XPathSyntaxError:
        return spark.createDataFrame(
            [(selector, 0, "Invalid XPath")], "selector string, match_count long, error string"
        )
    except UnsupportedXPath as e:
        return spark.createDataFrame([(selector, 0, f"Unsupported XPath: {e}")], "selector string, match_count long, error string")
    cnt = F.size(matched_nodes(selector)) if nodes else F.lit(0)
    counts = dom.select(cnt.cast("long").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("match_count"))
    return counts.select(
        F.lit(selector).alias("selector"), F.col("match_count").cast("long"), F.lit(None).cast("string").alias("error")
    )


def row_selector(selector: str, index: int) -> str:
    """The address of row ``index`` (0-based) is ``(selector)[index+1]``."""
    return f"({selector})[{int(index) + 1}]"


def fetch_row(dom: DataFrame, selector: str, index: int) -> DataFrame:
    """The node at ``original_index`` of ``selector`` on each page, with its text."""
    env = dom_env(F.col(NODE_COL))
    rows = dom.select("page_id", "nodes", "text", F.get(matched_nodes(selector), int(index)).alias(NODE_COL)).filter(F.col(NODE_COL).isNotNull())
    return rows.select(
        "page_id", F.lit(int(index)).alias("original_index"), F.col(NODE_COL).alias("pre"),
        F.get(env.nodes, env.node)["tag"].alias("tag"), js_trim(strval(env, env.node)).alias("text"),
    )


def column_value(selector: str, env: Env) -> Column:
    """P2-P5, P9 for one column selector evaluated at ``env.node``: always a STRING, never null.

    * ``.``: trimmed textContent;
    * ``@name`` (no parenthesis anywhere): attribute value, not trimmed, '' when missing;
    * anything else: string value of the expression, trimmed; when that is '' the first
      matched value (HTML element text, attribute or text node) trimmed; malformed -> ''.
    """
    if selector == ".":
        return F.coalesce(js_trim(strval(env, env.node)), F.lit(""))
    if selector.startswith("@") and "(" not in selector:
        return F.coalesce(attr_of(env, env.node, selector[1:].lower()), F.lit(""))
    try:
        v, comp = compile_value(selector, env)
    except XPathSyntaxError:
        return F.lit("")
    whole = comp.to_str(v, env)
    primary = js_trim(whole)
    if v.kind != NODES:
        return F.coalesce(primary, F.lit(""))
    arr = v.col if not v.single else F.array(v.col)
    n = lambda i: F.get(env.nodes, i)
    first = F.get(F.filter(arr, lambda i: n(i)["is_html"] | (n(i)["tag"] == F.lit("#text"))), 0)
    fallback = js_trim(strval(env, first))
    return F.coalesce(F.when(whole != F.lit(""), primary).otherwise(fallback), F.lit(""))


def resolve_keys(columns) -> list[tuple[str, ColumnDef]]:
    """Ordered distinct keys; a repeated key keeps its first position, the last column
    with that key supplies the value (JavaScript object assignment)."""
    order: list[str] = []
    last: dict[str, ColumnDef] = {}
    for c in columns:
        k = c.out_key
        if k not in last:
            order.append(k)
        last[k] = c
    return [(k, last[k]) for k in order]


def is_empty_col(values: list[Column]) -> Column:
    """Every value blank after trim (true when there are no columns)."""
    if not values:
        return F.lit(True)
    return F.forall(F.array(*values), lambda v: js_trim(v) == F.lit(""))


def extract(
    dom: DataFrame,
    config: ScrapeConfig,
    on_error: str = "empty",
    form: str = "wide",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Rows x columns -> ``(page_id, original_index, is_empty, <key columns>)``.

    ``form='long'`` returns ``data MAP<STRING,STRING>`` instead of one column per key.
    ``on_error='empty'`` (reference behaviour) turns a malformed main selector into zero
    rows; ``'raise'`` re-raises. Unsupported-but-valid XPath always raises.
    """
    try:
        arr = matched_nodes(config.main_selector)
    except XPathSyntaxError:
        if on_error == "raise":
            raise
        arr = F.array().cast("array<int>")
    keyed = resolve_keys(config.columns)

    def values(i: Column) -> Column:
        env = dom_env(i)
        return F.array(*[column_value(c.selector, env) for _, c in keyed]) if keyed else F.array().cast("array<string>")

    # a page's rows are arrays of their values before they become rows: the page itself is not repeated
    rows = dom.select("page_id", *keep, F.posexplode(F.transform(arr, values)).alias("original_index", "_values"))
    head = [F.col("page_id"), *[F.col(k) for k in keep], F.col("original_index").cast("int").alias("original_index")]
    empty = F.forall("_values", lambda v: js_trim(v) == F.lit(""))
    if form == "long":
        keys = F.array(*[F.lit(k) for k, _ in keyed]) if keyed else F.array().cast("array<string>")
        return rows.select(*head, empty.alias("is_empty"), F.map_from_arrays(keys, "_values").alias("data"))
    return rows.select(*head, empty.alias("is_empty"), *[F.get("_values", k).alias(name) for k, (name, _) in enumerate(keyed)])


def rows_array(config: ScrapeConfig, tag: str) -> Column:
    """One page's result rows as ``ARRAY<STRUCT<preset_id, original_index, is_empty, data>>``
    (long form), so several configs can be evaluated in one pass over ``dom`` (Q14)."""
    try:
        arr = matched_nodes(config.main_selector)
    except XPathSyntaxError:
        arr = F.array().cast("array<int>")
    keyed = resolve_keys(config.columns)

    def row(i, idx):
        env = dom_env(i)
        vals = [column_value(c.selector, env) for _, c in keyed]
        keys = F.array(*[F.lit(k) for k, _ in keyed]) if keyed else F.array().cast("array<string>")
        return F.struct(
            F.lit(tag).alias("preset_id"),
            idx.alias("original_index"),
            is_empty_col(vals).alias("is_empty"),
            F.map_from_arrays(keys, F.array(*vals) if vals else F.array().cast("array<string>")).alias("data"),
        )

    return F.transform(arr, row)


def project_display(res: DataFrame, column_order: list[str], config: ScrapeConfig) -> DataFrame:
    """Display columns by position: display name i reads key of column i (or the
    display name itself when the config has no column i). Duplicate display names are
    kept by suffixing ``#i`` only in the DataFrame column name."""
    out, seen = [], {}
    for i, name in enumerate(column_order):
        key = (config.columns[i].key if i < len(config.columns) else None) or name
        label = name if name not in seen else f"{name}#{i}"
        seen[name] = True
        src = F.col(f"`{key}`") if key in res.columns else F.lit("")
        out.append(src.alias(label))
    return res.select("page_id", "original_index", "is_empty", *out)


# -- P12: config edits (driver-side values; apply to a presets DataFrame in presetstore) --
def add_column(cfg: ScrapeConfig, name: str) -> ScrapeConfig:
    if not name or not name.strip():
        return cfg
    return ScrapeConfig(cfg.main_selector, cfg.columns + (ColumnDef(name.strip(), "."),))


def remove_column(cfg: ScrapeConfig, index: int) -> ScrapeConfig:
    return ScrapeConfig(cfg.main_selector, tuple(c for i, c in enumerate(cfg.columns) if i != index))


def rename_column(cfg: ScrapeConfig, index: int, name: str) -> ScrapeConfig:
    cols = [ColumnDef(name, c.selector, c.key) if i == index else c for i, c in enumerate(cfg.columns)]
    return ScrapeConfig(cfg.main_selector, tuple(cols))


def set_selector(cfg: ScrapeConfig, index: int, selector: str) -> ScrapeConfig:
    cols = [ColumnDef(c.name, selector, c.key) if i == index else c for i, c in enumerate(cfg.columns)]
    return ScrapeConfig(cfg.main_selector, tuple(cols))
