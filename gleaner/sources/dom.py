"""Page scan, DOM materialisation and the node-table view.

``parse_dom`` turns ``pages(page_id, url, html)`` into one row per page:

    dom(page_id BIGINT, url STRING, text BINARY,
        nodes ARRAY<STRUCT<pre, parent, depth, tag, attrs, last, t0, t1, s0, s1,
                           sib, sib_n, child, is_html>>)

Node ``i`` sits at array position ``i`` (pre-order), so the descendants of ``n`` are the
contiguous positions ``n.pre+1 .. n.last`` and its textContent is the bytes ``n.t0 .. n.t1`` of
``text`` (UTF-8), cut out in time of their own length. ``n.s0 .. n.s1`` are the bytes of the source,
kept in ``source`` where asked for. Every selector then compiles to Catalyst
expressions over one row: row selection and extraction need no shuffle.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.sources.htmltree import parse_html

NODE_TYPE = T.StructType(
    [
        T.StructField("pre", T.IntegerType(), False),
        T.StructField("parent", T.IntegerType(), False),
        T.StructField("depth", T.IntegerType(), False),
        T.StructField("tag", T.StringType(), False),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType()), True),
        T.StructField("last", T.IntegerType(), False),
        T.StructField("t0", T.IntegerType(), False),
        T.StructField("t1", T.IntegerType(), False),
        T.StructField("s0", T.IntegerType(), False),
        T.StructField("s1", T.IntegerType(), False),
        T.StructField("sib", T.IntegerType(), False),
        T.StructField("sib_n", T.IntegerType(), False),
        T.StructField("child", T.IntegerType(), False),
        T.StructField("is_html", T.BooleanType(), False),
    ]
)

_INT_FIELDS = ("parent", "depth", "last", "t0", "t1", "s0", "s1", "sib", "sib_n", "child")

_ARROW_NODE = pa.struct(
    [
        pa.field("pre", pa.int32(), False),
        pa.field("parent", pa.int32(), False),
        pa.field("depth", pa.int32(), False),
        pa.field("tag", pa.string(), False),
        pa.field("attrs", pa.map_(pa.string(), pa.string()), True),
        pa.field("last", pa.int32(), False),
        pa.field("t0", pa.int32(), False),
        pa.field("t1", pa.int32(), False),
        pa.field("s0", pa.int32(), False),
        pa.field("s1", pa.int32(), False),
        pa.field("sib", pa.int32(), False),
        pa.field("sib_n", pa.int32(), False),
        pa.field("child", pa.int32(), False),
        pa.field("is_html", pa.bool_(), False),
    ]
)


# A row group of stored pages, as the writer counts it before encoding: some 70,000 to 120,000 nodes.
ROW_GROUP_BYTES = 4 << 20


def text_slice(text, node):
    """The text of a node: its bytes of the page's, whatever stands before them."""
    return text.substr(node["t0"] + 1, node["t1"] - node["t0"]).cast("string")


def dom_schema(extra: T.StructType | None = None) -> T.StructType:
    fields = [T.StructField("page_id", T.LongType(), True)]
    if extra:
        fields += list(extra.fields)
    fields += [
        T.StructField("text", T.BinaryType(), True),
        T.StructField("nodes", T.ArrayType(NODE_TYPE, False), True),
    ]
    return T.StructType(fields)


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Pages from a table (``parquet`` etc.) or from raw ``.html`` files (``html``)."""
    if fmt == "html":
        raw = spark.read.text(path, wholetext=True).select(
            F.col("_metadata.file_path").alias("url"), F.col("value").alias("html")
        )
        return raw.select(F.xxhash64("url").alias("page_id"), "url", "html")
    return spark.read.format(fmt).load(path)


def _arrow_batch(ids, extras, parsed, extra_names, extra_types) -> pa.RecordBatch:
    cols = {f: [] for f in _INT_FIELDS}
    pre, tags, ishtml = [], [], []
    akeys, avals, aoffs, avalid = [], [], [0], []
    offsets = [0]
    texts = []
    for p in parsed:
        n = len(p["tag"])
        pre.extend(range(n))
        tags.extend(p["tag"])
        ishtml.extend(p["is_html"])
        for f in _INT_FIELDS:
            cols[f].extend(p[f])
        for a in p["attrs"]:
            if a is None:
                avalid.append(False)
            else:
                avalid.append(True)
                akeys.extend(a.keys())
                avals.extend(a.values())
            aoffs.append(len(akeys))
        offsets.append(offsets[-1] + n)
        texts.append(p["text"])
    attrs = pa.MapArray.from_arrays(
        pa.array(aoffs, pa.int32()),
        pa.array(akeys, pa.string()),
        pa.array(avals, pa.string()),
        mask=pa.array([not v for v in avalid], pa.bool_()),
    )
    fields = [
        pa.array(pre, pa.int32()),
        pa.array(cols["parent"], pa.int32()),
        pa.array(cols["depth"], pa.int32()),
        pa.array(tags, pa.string()),
        attrs,
        pa.array(cols["last"], pa.int32()),
        pa.array(cols["t0"], pa.int32()),
        pa.array(cols["t1"], pa.int32()),
        pa.array(cols["s0"], pa.int32()),
        pa.array(cols["s1"], pa.int32()),
        pa.array(cols["sib"], pa.int32()),
        pa.array(cols["sib_n"], pa.int32()),
        pa.array(cols["child"], pa.int32()),
        pa.array(ishtml, pa.bool_()),
    ]
    nodes_flat = pa.StructArray.from_arrays(fields, fields=list(_ARROW_NODE))
    nodes = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), nodes_flat)
    arrays = [pa.array(ids, pa.int64())]
    names = ["page_id"]
    for nm, ty in zip(extra_names, extra_types):
        arrays.append(pa.array(extras[nm], ty))
        names.append(nm)
    arrays += [pa.array(texts, pa.binary()), nodes]
    names += ["text", "nodes"]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _make_parser(html_col: str, extra_names: list[str], chunk: int):
    def parse_batches(batches):
        extra_types = None
        for batch in batches:
            if extra_types is None:
                extra_types = [batch.schema.field(nm).type for nm in extra_names]
            for s in range(0, batch.num_rows, chunk):
                part = batch.slice(s, chunk)  # a batch is as long as the session says; only a chunk's strings are made
                parsed = [parse_html(h) for h in part.column(html_col).to_pylist()]
                extras = {nm: part.column(nm).to_pylist() for nm in extra_names}
                yield _arrow_batch(part.column("page_id").to_pylist(), extras, parsed, extra_names, extra_types)

    return parse_batches


def ship_by_value(*modules) -> None:
    """Send the per-task helpers with the task (pickled by value), so executors do not need
    this package installed or on their path."""
    from pyspark import cloudpickle

    import gleaner.sources.dom as _dom
    import gleaner.sources.htmltree as _tree

    for m in (_tree, _dom, *modules):
        cloudpickle.register_pickle_by_value(m)


def parse_dom(
    pages: DataFrame,
    html_col: str = "html",
    keep: tuple[str, ...] = ("url",),
    min_partitions: int | None = None,
    chunk: int = 64,
    source: bool = False,
) -> DataFrame:
    """Parse each page's HTML into the node array (one Arrow Python stage, no join).

    Filters and projections on ``pages`` must be applied *before* this call: Catalyst does
    not push them through the Python stage. Only ``page_id``, ``keep`` columns and the html
    column are read from the scan. ``source`` keeps the pages' bytes, for elements' html.

    Partitioning: pages are parsed by the tasks that read them, without a shuffle.
    ``min_partitions`` spreads them by a hash of ``page_id`` first, for a table in fewer splits than
    there are cores.
    """
    keep = tuple(k for k in keep if k in pages.columns)
    src = pages.select("page_id", *keep, html_col)
    if min_partitions and not src.isStreaming:
        src = src.repartition(min_partitions, "page_id")
    if source:
        src = src.withColumn("source", F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8"))
        keep = (*keep, "source")
    extra = T.StructType([src.schema[k] for k in keep]) if keep else None
    ship_by_value()
    return src.mapInArrow(_make_parser(html_col, list(keep), chunk), dom_schema(extra))


def write_dom(dom: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parsed pages as Parquet, once; :func:`read_dom` feeds every selector, extraction and inference from them.

    Readers take up to 4,096 rows of a row group at once, and a row is a whole page: so row groups are closed by their
    bytes, looked at after every page, and a reader holds the nodes of few pages however many the table has.
    """
    bounds = {"parquet.block.size": ROW_GROUP_BYTES, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}  # the writer's group checks follow the page's
    dom.write.mode(mode).options(**bounds).parquet(path)


def read_dom(spark: SparkSession, path: str) -> DataFrame:
    """Parsed pages as :func:`write_dom` stored them. Only the columns that a query uses are read."""
    return spark.read.parquet(path)


def parts_of(dom: DataFrame, nodes_per_part: int = 50_000) -> int:
    """Into how many partitions pages go where their elements become rows: as many as their nodes ask for, so that a
    task's rows do not grow with the table. Counts the nodes of all pages, from one column of a stored table."""
    return max(1, -(-(dom.agg(F.sum(F.size("nodes.pre"))).first()[0] or 0) // nodes_per_part))


def html_parts(pages: DataFrame, html_col: str = "html", bytes_per_part: int = 16 << 20) -> int:
    """Into how many partitions pages go to be parsed: as many as their bytes ask for. What a task hands to its Python
    worker at once is counted in rows by the session and never more than the task has, so its bytes do not grow with the table."""
    return max(1, -(-(pages.agg(F.sum(F.octet_length(html_col))).first()[0] or 0) // bytes_per_part))


def explode_nodes(dom: DataFrame) -> DataFrame:
    """S3: one row per node ``(page_id, pre, parent, depth, tag, attrs, ..., text)``."""
    n = F.col("n")
    own = F.transform("nodes", lambda x: F.struct(*[x[f.name].alias(f.name) for f in NODE_TYPE.fields], text_slice(F.col("text"), x).alias("text_content")))
    return dom.select("page_id", F.explode(own).alias("n")).select(
        "page_id",
        *[n[f.name].alias(f.name) for f in NODE_TYPE.fields],
        F.col("n.text_content").alias("text_content"),
    )
