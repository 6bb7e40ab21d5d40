"""Mixing sources to target weights by hierarchical budgeting (operator 4).

Documents hang in a tree domain > language > source. The budget of tokens flows down by
weights; a node gets at most what its documents offer over ``max_epochs`` epochs. What a
node cannot take goes to its siblings in proportion to their weights, and only what the
whole family cannot take goes back to the family's own siblings: at each level this is
water-filling among children whose capacities are known from below, in closed form over a
window of a family's few summary rows.

A leaf then reads its documents in epochs. Each epoch is a seeded order of all of them;
full epochs are taken whole and the last one up to the document that reaches the budget
(a prefix of its tokens, rounded up to the whole document). Prefix sums of a leaf, which may hold a
third of all rows, go over hash ranges: sums by range first, then inside a range.

Defined cases: a null or empty text has no words and counts as one token; a null language or
source is a leaf of its own (''); repeated rows are rows of their own, ordered by text; leaves without
a weight take ``default_weight``; weight 0 gets nothing while a sibling can take it; an
empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import cut

DOMAINS = 4  # sources are dealt to as many domains unless a column names them
MAX_EPOCHS = 2
SHARE = 0.8  # the budget, as a share of all tokens
RANGE_ROWS = 500
SEED = 20240501
LEVELS = ("domain", "language", "leaf_source")
#: Relative weights of languages by default; domains and sources weigh alike.
LANGUAGE_WEIGHTS = {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}


def n_tokens(text: Column) -> Column:
    """Words between white space, and one for the end of the document."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return (F.length(F.regexp_replace(t, r"[^x]+", "")) + 1).cast("long")


def leaves(docs: DataFrame, domain: Column | None = None) -> DataFrame:
    """The documents with their place in the tree and their tokens."""
    source = F.coalesce(F.col("source"), F.lit(""))
    return docs.select(
        F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("d"),
        F.xxhash64("text").alias("text_key"),
        (domain if domain is not None else F.concat(F.lit("domain"), F.pmod(F.xxhash64(source), F.lit(DOMAINS)))).alias("domain"),
        F.coalesce(F.col("lang"), F.lit("")).alias("language"),
        source.alias("leaf_source"),
        n_tokens(F.col("text")).alias("tokens"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"),
    )


def weight_of(level: str, weights: dict[str, float], default: float) -> Column:
    if not weights:
        return F.lit(float(default))
    table = F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))])
    return F.coalesce(F.try_element_at(table, F.col(level)), F.lit(float(default)))


def pour(nodes: DataFrame, parents: list[str], given: str, out: str) -> DataFrame:
    """Water-filling: ``given`` (the parent's budget) among children by ``w`` up to ``cap``.

    Children fill in the order of cap / w. With those before it full, a child and those
    behind it share the rest by weight; the first for which that share does not fill it
    sets the level for all behind it.
    """
    w = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = w.orderBy(F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(float("inf"))), "name")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = nodes.withColumn("full_cap", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn(
        "left_w", F.sum("w").over(w) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    level = F.when(F.col("left_w") > 1e-9, (F.col(given) - F.col("full_cap")) / F.col("left_w"))
    short = F.when((F.col("w") > 0) & (F.col("cap") > level * F.col("w")), level)
    rest = rest.withColumn("level", F.first(short, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    weighted = F.when(F.col("w") > 0, F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap")))).otherwise(0.0)
    rest = rest.withColumn("got", weighted).withColumn("spare", F.greatest(F.lit(0.0), F.col(given) - F.sum(weighted).over(w)))
    # what all weighted children cannot take goes to those of weight 0, in the order of their names
    zero = F.when(F.col("w") > 0, 0.0).otherwise(F.col("cap"))
    ahead = F.coalesce(F.sum(zero).over(w.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return rest.withColumn(out, F.when(F.col("w") > 0, F.col("got")).otherwise(F.least(F.col("cap"), F.greatest(F.lit(0.0), F.col("spare") - ahead)))).drop(
        "full_cap", "left_w", "level", "got", "spare"
    )


def budgets(
    totals: DataFrame,
    share: float = SHARE,
    max_epochs: int = MAX_EPOCHS,
    weights: dict[str, dict[str, float]] | None = None,
    default_weight: float = 1.0,
) -> DataFrame:
    """Each leaf's budget from (domain, language, leaf_source, leaf_tokens): three pourings."""
    weights = {"language": LANGUAGE_WEIGHTS, **(weights or {})}
    leaf = totals.withColumn("leaf_cap", F.col("leaf_tokens") * float(max_epochs))
    tree = leaf
    lang = leaf.groupBy("domain", "language").agg(F.sum("leaf_cap").alias("cap"), F.sum("leaf_tokens").alias("t"))
    dom = lang.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("t").alias("t"))
    dom = dom.withColumn("w", weight_of("domain", weights.get("domain", {}), default_weight)).withColumn("name", F.col("domain"))
    dom = dom.withColumn("all", F.sum("t").over(Window.partitionBy(F.lit(0))) * float(share))
    dom = pour(dom, [], "all", "domain_budget").select("domain", "domain_budget")
    lang = lang.join(dom, "domain").withColumn("w", weight_of("language", weights["language"], default_weight)).withColumn("name", F.col("language"))
    lang = pour(lang, ["domain"], "domain_budget", "language_budget").select("domain", "language", "language_budget")
    tree = tree.withColumn("cap", F.col("leaf_cap")).join(lang, ["domain", "language"])
    tree = tree.withColumn("w", weight_of("leaf_source", weights.get("leaf_source", {}), default_weight)).withColumn("name", F.col("leaf_source"))
    return pour(tree, ["domain", "language"], "language_budget", "budget").select(*LEVELS, "leaf_tokens", "leaf_docs", "budget")


def select(
    docs: DataFrame,
    share: float = SHARE,
    max_epochs: int = MAX_EPOCHS,
    weights: dict[str, dict[str, float]] | None = None,
    default_weight: float = 1.0,
    seed: int = SEED,
    domain: Column | None = None,
) -> DataFrame:
    """The chosen rows: ``d`` (the document's columns), tree levels, tokens, ``epoch`` from 0."""
    placed = leaves(docs, domain)
    totals = placed.groupBy(*LEVELS).agg(F.sum("tokens").alias("leaf_tokens"), F.count("*").alias("leaf_docs"))
    plan = cut(
        budgets(totals, share, max_epochs, weights, default_weight)
        .withColumn("full_epochs", F.least(F.floor(F.col("budget") / F.col("leaf_tokens") + 1e-9), F.lit(max_epochs)).cast("int"))
        .withColumn("rest", F.greatest(F.lit(0.0), F.col("budget") - F.col("full_epochs") * F.col("leaf_tokens")))
        .withColumn("ranges", F.greatest(F.lit(1), F.ceil(F.col("leaf_docs") / RANGE_ROWS)).cast("long"))
    )
    # the seeded order of the last, partial epoch, as a 53-bit place and its range
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("full_epochs"), F.col("key"), F.col("text_key")), 11)
    small = plan.select(*LEVELS, "full_epochs", "rest", "ranges")
    ordered = placed.join(small, list(LEVELS)).withColumn("place", place)
    ordered = ordered.withColumn("range", F.floor(F.col("place") / float(1 << 53) * F.col("ranges")).cast("long"))
    by_range = ordered.groupBy(*LEVELS, "range").agg(F.sum("tokens").alias("range_tokens"))
    ahead = Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_range.select(*LEVELS, "range", F.coalesce(F.sum("range_tokens").over(ahead), F.lit(0)).alias("before_range"))
    inside = Window.partitionBy(*LEVELS, "range").orderBy("place", "key", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    # rows whose range lies before the end of the prefix need no order; the range that holds the end does
    ranged = ordered.join(starts, [*LEVELS, "range"])
    before = F.col("before_range") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    epochs = F.when(before < F.col("rest"), F.col("full_epochs") + 1).otherwise(F.col("full_epochs"))
    taken = ranged.withColumn("times", epochs).filter(F.col("times") > 0)
    return taken.select("d", *LEVELS, "tokens", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("epoch"))


def digest(docs: DataFrame) -> DataFrame:
    """The query: every chosen (document, epoch) with its leaf and tokens."""
    i = docs.columns.index("doc_id")
    return select(docs).select(F.col(f"d.c{i}").alias("doc_id"), "domain", F.col("language"), F.col("leaf_source").alias("source"), "tokens", "epoch")


def mixed(docs: DataFrame) -> DataFrame:
    """The chosen documents, once for each epoch, with their own columns only."""
    return select(docs).select(*[F.col(f"d.c{i}").alias(c) for i, c in enumerate(docs.columns)])
