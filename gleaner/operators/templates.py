"""Column templates as a rule table joined to elements.

A rule belongs to a tag ('*': tags without rules), may ask for a fact about the element, and gives one column (name and
selector) or one of the lists that the element itself determines. A new tag or column is a
row of the table; nothing is compiled per rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import js_trim
from gleaner.sources.dom import parts_of
from gleaner.operators.infer import _COL_T, _desc, _f, _nodes, _table_columns, _tag_is, _text, data_columns_of

_RULES_T = "array<struct<place:int,fact:string,list:string,name:string,selector:string>>"
RULES_DDL = "tag string, place int, fact string, list string, name string, selector string"
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")

# The columns of each tag, in order, as "name = selector". "[fact]" before a column: only where the fact holds
# (@a: the attribute is there, @a=v: it has that value, ..t: the parent is a t, //t: a t is inside).
# "{list}" stands for columns that the element determines: its data-* attributes, a row's cells, a table's header cells and
# col elements, the first heading inside.
TEMPLATES = """
tr: {cells}
a: Anchor text = . | URL = @href | Rel = @rel | Target = @target | {data}
img: Alt Text = @alt | Source = @src | Title = @title | {data}
button: Text = . | Value = @value | ARIA Label = @aria-label | Disabled = @disabled | {data}
input: Value = @value | Placeholder = @placeholder | Name = @name | Type = @type | {data} | [@type=checkbox] Checked = @checked | [@type=radio] Checked = @checked
textarea: Value = . | Placeholder = @placeholder | Name = @name | {data}
select: Selected Option = option[@selected] | Name = @name | {data}
dt: Term = . | Definition = ./following-sibling::dd | {data}
li: List Item = . | {data}
h1 h2 h3 h4 h5 h6: Heading = . | ARIA Label = @aria-label | {data}
article section main aside: Text = . | ARIA Label = @aria-label | {heading} | {data}
figure: Image Source = .//img/@src | Image Alt = .//img/@alt | Image Title = .//img/@title | Caption = figcaption | Code = pre|code | Blockquote = blockquote | Paragraph = p | Figure Text = . | {data}
blockquote: Quote = . | Citation = @cite | Footer = footer | Cite Element = cite | {data}
pre code: Code = . | Language = @data-language | Class = @class | {data} | [..figure] Caption = figcaption
colgroup col: Span = @span | Class = @class | Style = @style | {data}
table: [//caption] Caption = caption | {ths} | Col Count = count(col) | {cols} | {data}
ul ol: List Item = li | {data}
dl: Term = dt | Definition = dd | {data}
form: Action = @action | Method = @method | Input Names = .//input/@name | Input Types = .//input/@type | {data}
nav: Text = . | ARIA Label = @aria-label | Links = a/@href | {data}
header footer: Text = . | ARIA Label = @aria-label | {data}
video audio: Source = source/@src | Poster = @poster | Controls = @controls | Captions = track/@src | {data}
details: Summary = summary | Details = . | {data}
summary: Summary = . | {data}
*: [@aria-label] ARIA Label = @aria-label | Text = . | {data}
"""


def read_rules(text: str) -> list[tuple]:
    """Rows of ``RULES_DDL`` from lines as in ``TEMPLATES``."""
    rows = []
    for line in text.strip().splitlines():
        tags, _, columns = line.partition(":")
        for tag in tags.split():
            for place, column in enumerate(columns.split(" | ")):
                column = column.strip()
                fact = None
                if column.startswith("["):
                    fact, _, column = column[1:].partition("] ")
                if column.startswith("{"):
                    rows.append((tag, place, fact, column.strip("{}"), None, None))
                else:
                    name, _, selector = column.partition(" = ")
                    rows.append((tag, place, fact, None, name, selector))
    return rows


def template_rules(spark: SparkSession, text: str = TEMPLATES) -> DataFrame:
    return spark.createDataFrame(read_rules(text), RULES_DDL)


def _facts(n: Column) -> Column:
    """What rules may ask about an element: its attributes, its type, its parent, the tags inside."""
    attrs = F.coalesce(n["attrs"], F.create_map().cast("map<string,string>"))
    return F.concat(
        F.transform(F.map_keys(attrs), lambda k: F.concat(F.lit("@"), k)),
        F.transform(F.map_entries(attrs), lambda e: F.concat(F.lit("@"), e["key"], F.lit("="), e["value"])),
        F.array(F.concat(F.lit(".."), _f(n["parent"], "tag"))),
        F.when(n["tag"] == "table", F.array_distinct(F.transform(_desc(n["pre"]), lambda m: F.concat(F.lit("//"), _f(m, "tag"))))).otherwise(F.array().cast("array<string>")),
    )


def _named(values: Column, name, selector) -> Column:
    return F.transform(values, lambda x, i: F.struct(name(x, i).alias("name"), selector(x, i).alias("selector"), F.lit(None).cast("string").alias("key"))).cast(_COL_T)


def _number(i: Column) -> Column:
    return (i + 1).cast("string")


def _lists(n: Column) -> Column:
    """The lists of columns that an element determines; those of other tags are empty."""
    i, tag = n["pre"], n["tag"]
    none = F.array().cast(_COL_T)
    heading = F.slice(F.filter(_desc(i), _tag_is(*HEADINGS)), 1, 1)
    ths, cols = F.filter(_desc(i), _tag_is("th")), F.filter(_desc(i), _tag_is("col"))
    th_names = lambda t, k: F.coalesce(F.nullif(js_trim(_text(t)), F.lit("")), F.concat(F.lit("Column "), _number(k)))
    return F.struct(
        data_columns_of(i).alias("data"),
        F.when(tag == "tr", _table_columns(i)).otherwise(none).alias("cells"),
        F.when(tag.isin("article", "section", "main", "aside"), _named(heading, lambda h, _: F.lit("Headline"), lambda h, _: _f(h, "tag"))).otherwise(none).alias("heading"),
        F.when(tag == "table", _named(ths, th_names, lambda _, k: F.concat(F.lit(".//tr/td["), _number(k), F.lit("]")))).otherwise(none).alias("ths"),
        F.when(tag == "table", _named(cols, lambda _, k: F.concat(F.lit("Col "), _number(k), F.lit(" Span")), lambda _, k: F.concat(F.lit(".//col["), _number(k), F.lit("]/@span")))).otherwise(none).alias("cols"),
    )


def element_templates(dom: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """The template of every HTML element: page_id, pre, tag, columns (array of name, selector, key).

    Elements become rows with their facts and lists. The rules of a tag are one row of a table that every task gets (as
    many rows as there are tags with rules), so an element's columns are put together, in the rules' order, where its page
    is read. Then pages that share an id meet, in partitions that grow in number with the elements.
    """
    rules = template_rules(dom.sparkSession) if rules is None else rules
    elements = F.filter(_nodes(), lambda n: n["is_html"] & (n["depth"] >= 1))
    rows = F.transform(elements, lambda n: F.struct(n["pre"].alias("pre"), n["tag"].alias("tag"), _facts(n).alias("facts"), _lists(n).alias("lists")))
    e = dom.select("page_id", F.explode(rows).alias("e")).select("page_id", "e.*")
    of_tag = rules.groupBy("tag").agg(F.collect_list(F.struct("place", "fact", "list", "name", "selector")).cast(_RULES_T).alias("rules"))
    own = of_tag.withColumn("rule_tag", F.col("tag")).select("tag", "rule_tag")
    e = e.join(F.broadcast(own), "tag", "left").withColumn("rule_tag", F.coalesce("rule_tag", F.lit("*")))
    j = e.join(F.broadcast(of_tag.withColumnRenamed("tag", "rule_tag")), "rule_tag", "left")

    def columns(r: Column) -> Column:
        holds = r["fact"].isNull() | F.array_contains("facts", r["fact"])
        listed = F.lit(None).cast(_COL_T)
        for name in ("data", "cells", "heading", "ths", "cols"):
            listed = F.when(r["list"] == name, F.col("lists")[name]).otherwise(listed)
        plain = F.array(F.struct(r["name"].alias("name"), r["selector"].alias("selector"), F.lit(None).cast("string").alias("key"))).cast(_COL_T)
        return F.when(holds, F.when(r["list"].isNotNull(), listed).when(r["name"].isNotNull(), plain))

    parts = F.transform(F.coalesce("rules", F.array().cast(_RULES_T)), lambda r: F.struct(r["place"].alias("place"), columns(r).alias("columns")))
    mine = j.select("page_id", "pre", "tag", parts.alias("parts")).repartition(parts_of(dom), "page_id")
    got = mine.groupBy("page_id", "pre", "tag").agg(F.array_sort(F.flatten(F.collect_list("parts"))).alias("parts"))  # as many as the tag has rules
    whole = F.flatten(F.transform(F.filter("parts", lambda p: p["columns"].isNotNull()), lambda p: p["columns"]))
    return got.select("page_id", "pre", "tag", whole.alias("columns"))
