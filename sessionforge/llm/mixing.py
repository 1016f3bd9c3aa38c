"""Mixing sources to target weights: hierarchical budgets and seeded token prefixes, in DataFrame operations only.

A token budget flows down a tree (domain, language, source). At each node it is shared among the children by weight,
none above what its subtree can give (tokens times the most epochs); what a child can't use goes to its siblings by
weight first, and only what a whole subtree can't use goes to the siblings of its parent. A child of weight 0 gets
nothing. Each leaf then takes whole epochs of its documents and, of the epoch after them, in that epoch's own seeded
order, the prefix that fills its share to the token.

Words are counted once, in one scan whose small rows (no texts) are written to the shared folder; all else reads those.
The prefix needs no sort of a leaf: tokens are summed by leaf and bucket of the order, the bucket where the share ends
is found from those sums, and only that bucket's documents are ordered. A leaf has as many buckets as make one of
BUCKET_ROWS documents, so a leaf with a third of all rows is summed in every task and ordered in a small bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

LEVELS = ("domain", "lang", "source")
#: Fixed values of the default mix: weights of domains and languages; a value that isn't listed weighs DEFAULT_WEIGHT.
DOMAIN_WEIGHTS = {"web": 0.5, "books": 0.3, "code": 0.2}
LANG_WEIGHTS = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}
DEFAULT_WEIGHT = 0.05
#: The share of all tokens that is wanted, the most times a document is read, and the seed of its order.
FRACTION, EPOCHS, SEED = 0.5, 4, 17
#: Documents that a bucket of a leaf's order is meant to hold, and leaves up to which their table is broadcast.
BUCKET_ROWS, BROADCAST_LEAVES = 256, 50_000
WORD = r"[^\x20\x09-\x0D]+"


def token_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """The domain of a source: the number in its name below 7 is web, below 14 books, else code."""
    n = F.try_to_number(F.regexp_extract(source, r"(\d{1,9})$", 1), F.lit("999999999"))
    return F.when(n < 7, "web").when(n < 14, "books").otherwise("code")


def weight_of(column: Column, weights: dict[str, float]) -> Column:
    if any(not w >= 0 for w in weights.values()):
        raise ValueError("weights must be 0 or more")
    out = F.lit(DEFAULT_WEIGHT)
    for name, w in weights.items():
        out = F.when(column == name, F.lit(float(w))).otherwise(out)
    return out


def shares(nodes: DataFrame, parent: list[str], budget: Column) -> DataFrame:
    """Adds `share` to nodes (columns of parent, name, weight, capacity): budget dealt by weight, none above capacity.

    Children in order of capacity over weight are full as long as the rest's rate would overfill them; the first one
    that isn't sets the rate for all after it."""
    order = Window.partitionBy(*parent).orderBy((F.col("capacity") / F.col("weight")).asc(), "name")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    rate = (F.col("budget__") - F.coalesce(F.sum("capacity").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    nodes = nodes.withColumn("budget__", budget).withColumn("rate__", rate).withColumn("n__", F.row_number().over(order))
    nodes = nodes.withColumn("full__", F.col("capacity") <= F.col("rate__") * F.col("weight"))
    common = F.min(F.when(~F.col("full__"), F.struct("n__", "rate__"))).over(Window.partitionBy(*parent)).getField("rate__")
    nodes = nodes.withColumn("rate__", common)
    share = F.when(F.col("full__"), F.col("capacity")).otherwise(F.greatest(F.lit(0.0), F.least(F.col("capacity"), F.col("rate__") * F.col("weight"))))
    return nodes.withColumn("share", share).drop("budget__", "rate__", "n__", "full__")


def quotas(leaves: DataFrame, *, domain_weights: dict[str, float], lang_weights: dict[str, float], fraction: float, epochs: int) -> DataFrame:
    """Leaves (domain, lang, source, tokens) with `quota`, the tokens that each is to give. The fraction is of all
    tokens; leaves under a weight of 0 have no capacity and aren't returned."""
    want = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(fraction)).cast("double").alias("want__"))
    leaves = leaves.withColumn("dw__", weight_of(F.col("domain"), domain_weights)).withColumn("lw__", weight_of(F.col("lang"), lang_weights)).where("dw__ > 0 AND lw__ > 0")
    domains = leaves.groupBy("domain").agg((F.sum("tokens") * epochs).cast("double").alias("capacity"), F.first("dw__").alias("weight"))
    domains = domains.withColumnRenamed("domain", "name").withColumn("root__", F.lit(0)).join(F.broadcast(want))  # one row
    domains = shares(domains, ["root__"], F.col("want__")).select(F.col("name").alias("domain"), F.col("share").alias("have__"))
    langs = leaves.groupBy("domain", "lang").agg((F.sum("tokens") * epochs).cast("double").alias("capacity"), F.first("lw__").alias("weight")).join(domains, "domain")
    langs = shares(langs.withColumnRenamed("lang", "name"), ["domain"], F.col("have__"))
    langs = langs.select("domain", F.col("name").alias("lang"), F.col("share").alias("have__"))
    ends = leaves.drop("dw__", "lw__").withColumn("capacity", (F.col("tokens") * epochs).cast("double")).withColumn("weight", F.lit(1.0)).join(langs, ["domain", "lang"])
    ends = shares(ends.withColumnRenamed("source", "name"), ["domain", "lang"], F.col("have__")).withColumnRenamed("name", "source")
    return ends.withColumn("quota", F.least(F.floor(F.col("share") + 1e-6), F.col("tokens") * epochs)).drop("capacity", "weight", "have__", "share")


def prefix_of(text: Column, n: Column) -> Column:
    """A text up to the end of its n-th word; white space and line breaks before that stay as they are."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), n.cast("int")), "")


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", domain: Column | None = None, domain_weights: dict[str, float] | None = None, lang_weights: dict[str, float] | None = None, fraction: float = FRACTION, epochs: int = EPOCHS, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, whole_epochs, prefix_tokens and taken_tokens of the documents taken.

    taken_tokens = whole_epochs * n_tokens + prefix_tokens, of which the last is what the seeded epoch after the whole
    ones takes from this document (less than n_tokens only where the leaf's share ends). A null language or source is
    `(none)`; texts without words are never taken; rows that repeat an id are taken one by one, those without
    an id in an order by their texts; a leaf under a weight
    of 0 is never taken. `keep` names short columns to carry along as kept__<name>."""
    dom = domain if domain is not None else domain_of(F.col(source_col))
    none = F.lit("(none)")
    kept = [F.col(c).alias(f"kept__{c}") for c in keep]
    rows = saved(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(dom, none).alias("domain"), F.coalesce(F.col(lang_col), none).alias("lang"), F.coalesce(F.col(source_col), none).alias("source"), token_count(F.col(text_col)).alias("n_tokens"), F.when(F.col(id_col).isNull(), F.md5(text_col)).alias("unnamed__"), *kept).where("n_tokens > 0"))
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs__"))
    leaves = quotas(leaves, domain_weights=DOMAIN_WEIGHTS if domain_weights is None else domain_weights, lang_weights=LANG_WEIGHTS if lang_weights is None else lang_weights, fraction=fraction, epochs=epochs)
    leaves = leaves.withColumn("whole__", F.expr("quota div tokens")).withColumn("rest__", F.col("quota") - F.col("whole__") * F.col("tokens"))
    leaves = saved(leaves.where("quota > 0").select(*LEVELS, "whole__", "rest__", F.ceil(F.col("docs__") / BUCKET_ROWS).alias("buckets__")))
    small = leaves.count() <= BROADCAST_LEAVES
    listed = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole__").cast("string"), F.coalesce(F.col("doc_id").cast("string"), "unnamed__")))
    rows = rows.join(listed(leaves), list(LEVELS)).withColumn("order__", order)
    rows = rows.withColumn("b__", F.shiftright(F.conv(F.substring("order__", 1, 8), 16, 10).cast("long") * F.col("buckets__"), 32))
    sums = rows.groupBy(*LEVELS, "rest__", "b__").agg(F.sum("n_tokens").alias("tokens"))
    run = Window.partitionBy(*LEVELS).orderBy("b__").rowsBetween(Window.unboundedPreceding, -1)
    ends = sums.withColumn("base__", F.coalesce(F.sum("tokens").over(run), F.lit(0))).where("base__ <= rest__ and rest__ < base__ + tokens")
    rows = rows.join(listed(ends.select(*LEVELS, "base__", F.col("b__").alias("end__"))), list(LEVELS))
    inside = Window.partitionBy(*LEVELS).orderBy("order__", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    outer = rows.where("b__ <> end__").withColumn("prefix_tokens", F.when(F.col("b__") < F.col("end__"), F.col("n_tokens")).otherwise(F.lit(0)).cast("long"))
    edge = rows.where("b__ = end__").withColumn("at__", F.col("base__") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    edge = edge.withColumn("prefix_tokens", F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("rest__") - F.col("at__"))).cast("long")).drop("at__")
    out = outer.unionByName(edge).withColumn("taken_tokens", F.col("whole__") * F.col("n_tokens") + F.col("prefix_tokens")).where("taken_tokens > 0")
    return out.select("doc_id", *LEVELS, "n_tokens", F.col("whole__").cast("long").alias("whole_epochs"), "prefix_tokens", "taken_tokens", *[f"kept__{c}" for c in keep])
