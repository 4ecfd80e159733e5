"""Mixing sources to target weights by hierarchical budgeting.

Weights stand on the nodes of a tree (domain, language, source). A token budget flows
from the root down: at each node it is split among the children in proportion to
their weights, no child getting more than its subtree holds. What a child cannot take
goes to its siblings first; as a node's own budget is set by what its whole subtree
holds, only a shortage that no sibling can fill reaches the node's ancestors. A leaf
spends its budget on whole epochs of its documents and on a token-prefix of one more
epoch, each epoch in a seeded order of its own.

Only DataFrame functions: counts by leaf and by leaf and bucket are aggregated before
any shuffle, and no leaf passes through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheafline.llm.common import discard, materialize, numbered, without

#: Rows of all leaves for each bucket of an epoch's order, and the hex digits of a bucket's key.
BUCKET_ROWS, DIGITS = 1 << 10, (3, 6)
LEVELS = ("domain", "language", "source")


def tokens(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def weight_of(level: str, weights: dict[str, float]) -> Column:
    """A node's weight by its name at a level; 1 where none is given. weights is part of the plan: keep it small."""
    out = F.lit(1.0)
    for name, weight in weights.items():
        out = F.when(F.col(level) == name, F.lit(float(weight))).otherwise(out)
    return out


def split(nodes: DataFrame, parent: list[str], name: str, total: str) -> DataFrame:
    """nodes with `share`: how parent's whole `total` is split by `weight`, none above `holds`.

    Children that hold less than their proportion are full; ordered by holds / weight
    these come first, and the first that is not full fixes the level of the rest (the
    levels behind it only sink, so it is the largest of those not full). Shares
    are whole tokens, rounded down.
    """
    by = W.partitionBy(*parent).orderBy("ratio", name)
    before = by.rowsBetween(W.unboundedPreceding, -1)
    after = by.rowsBetween(W.currentRow, W.unboundedFollowing)
    every = W.partitionBy(*parent)
    nodes = nodes.withColumn("ratio", F.when(F.col("weight") > 0, F.col("holds") / F.col("weight")).otherwise(F.lit(float("inf"))))
    nodes = nodes.withColumn("spent", F.coalesce(F.sum("holds").over(before), F.lit(0))).withColumn("left", F.sum("weight").over(after))
    nodes = nodes.withColumn("level", F.when(F.col("left") > 0, (F.col(total) - F.col("spent")) / F.col("left")))
    full = F.col("ratio") <= F.col("level")
    nodes = nodes.withColumn("level", F.max(F.when(~full, F.col("level"))).over(every))
    exact = F.when(F.col("weight") <= 0, F.lit(0.0)).when(F.col("level").isNull() | (F.col("ratio") <= F.col("level")), F.col("holds").cast("double")).otherwise(F.col("weight") * F.col("level"))
    nodes = nodes.withColumn("share", F.floor(exact + F.lit(1e-6)))
    return nodes.drop("ratio", "spent", "left", "level", "weight", "holds")


def budgets(leaves: DataFrame, total: Column, weights: dict[str, dict[str, float]], epochs: int) -> DataFrame:
    """(domain, language, source, tokens, budget) of every leaf (domain, language, source, tokens).

    total: tokens to spend, as a column over `tokens`, the sum of all leaves' tokens.
    """
    held = leaves.withColumn("holds", F.col("tokens") * epochs)
    # A subtree whose weight is zero holds nothing, so that its parent's share is not lost in it.
    for level in LEVELS:
        held = held.withColumn(f"w_{level}", weight_of(level, weights.get(level, {})))
    held = held.withColumn("holds", F.when((F.col("w_domain") > 0) & (F.col("w_language") > 0) & (F.col("w_source") > 0), F.col("holds")).otherwise(F.lit(0)))
    root = held.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("holds"), F.lit(0)).alias("holds"))
    above = root.select(F.least(F.floor(total), F.col("holds")).alias("total"))
    domains = held.groupBy("domain", F.col("w_domain").alias("weight")).agg(F.sum("holds").alias("holds")).crossJoin(F.broadcast(above))  # one row
    domains = split(domains.withColumn("root", F.lit(0)), ["root"], "domain", "total").select("domain", F.col("share").alias("total"))
    languages = held.groupBy("domain", "language", F.col("w_language").alias("weight")).agg(F.sum("holds").alias("holds")).join(domains, "domain")
    languages = split(languages, ["domain"], "language", "total").select("domain", "language", F.col("share").alias("total"))
    sources = held.select(*LEVELS, "tokens", "holds", F.col("w_source").alias("weight")).join(languages, ["domain", "language"])
    return split(sources, ["domain", "language"], "source", "total").select(*LEVELS, "tokens", F.col("share").alias("budget"))


def mix(docs: DataFrame, total: Column, weights: dict[str, dict[str, float]], domain: Column, epochs: int = 1, seed: int = 5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """How often each row of docs is taken.

    total: tokens to spend, e.g. ``F.col("tokens") * 0.5``. weights: level -> name ->
    weight, 1 where missing. domain: the domain of a row. epochs: how often a leaf's
    documents may be taken. A null domain, language or source is shown and treated as
    the name ``(null)``. Rows without tokens are never taken. Rows repeated with one id
    are ordered by their tokens; the prefix stops before a row that would exceed the
    budget, so no leaf exceeds it. Other columns are not read; an empty table gives an
    empty result. row_col: a column that tells rows of one id apart; it decides last
    between them and is returned too.

    Returns doc_id, domain, language, source, tokens long, budget long (of the leaf),
    copies long (0: not taken).
    """
    name = lambda c: F.coalesce(c.cast("string"), F.lit("(null)"))
    row = [row_col] if row_col else []
    rows = materialize(docs.select(
        *row, F.col(id_col).alias("doc_id"), name(domain).alias("domain"), name(F.col(lang_col)).alias("language"), name(F.col(source_col)).alias("source"), tokens(F.col(text_col)).alias("tokens"),
    ))
    n = rows.count()
    # The one bucket of a leaf that is ordered keeps its size as the table grows.
    digits = next((d for d in range(*DIGITS) if n >> (4 * d) <= BUCKET_ROWS), DIGITS[1])
    leaves = materialize(rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), n)
    plan = materialize(budgets(leaves, total, weights, epochs), n).withColumnRenamed("tokens", "leaf_tokens")
    discard(leaves)
    whole = F.when(F.col("leaf_tokens") > 0, F.floor(F.col("budget") / F.col("leaf_tokens"))).otherwise(F.lit(0))
    plan = plan.withColumn("whole", whole).withColumn("rest", F.col("budget") - F.col("whole") * F.col("leaf_tokens"))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), (F.col("whole") + 1).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    rows = rows.join(plan, list(LEVELS)).withColumn("mix", key).withColumn("bucket", F.substring("mix", 1, digits))

    sizes = rows.groupBy(*LEVELS, "bucket", "rest").agg(F.sum("tokens").alias("inside"))
    upto = W.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    sizes = sizes.withColumn("end", F.sum("inside").over(upto)).withColumn("start", F.col("end") - F.col("inside")).drop("inside", "rest")
    sizes = materialize(sizes, n)
    rows = rows.join(sizes, [*LEVELS, "bucket"])
    # Only the bucket that the budget ends in needs the order of its rows.
    edge = (F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("end"))
    inside = F.sum("tokens").over(W.partitionBy(*LEVELS, "bucket").orderBy("mix", "doc_id", "tokens", *row).rowsBetween(W.unboundedPreceding, W.currentRow))
    certain = rows.where(~edge).withColumn("extra", (F.col("end") <= F.col("rest")).cast("long"))
    ordered = rows.where(edge).withColumn("extra", (F.col("start") + inside <= F.col("rest")).cast("long"))
    taken = F.when(F.col("tokens") > 0, F.col("whole") + F.col("extra")).otherwise(F.lit(0)).cast("long")
    out = certain.unionByName(ordered)
    return out.select(*row, "doc_id", *LEVELS, "tokens", F.col("budget").cast("long").alias("budget"), taken.alias("copies"))


def keep_mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that a mix of one epoch takes, all columns unchanged. Ids may be null and repeat."""
    rows = numbered(docs)
    return without(rows, mix(rows, epochs=1, row_col="__row", **options).where("copies = 0").select("__row"), "__row").drop("__row")
