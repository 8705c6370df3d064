"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions only.

Method: documents are leaves of a tree of levels (for example domain, language, source). A node's capacity is the tokens
below it times max_epochs. From the root down, a node's budget is divided among its children by their weights; a child
that cannot use its share keeps its capacity, and what it leaves goes to its siblings, by weight. As the division at a
level sees only whole capacities of children, a shortage reaches an ancestor's siblings only when all siblings are full.
All budgets are whole numbers and those of children add up to their parent's.

A leaf of budget b and t tokens takes b div t whole epochs, and of one more epoch the prefix of b mod t tokens in an order
seeded by (seed, epoch, doc_id). Prefix sums are taken over 4096 hash buckets of a leaf first, and over single documents
only in the one bucket where the prefix ends, so a leaf with a third of all rows is spread over all tasks. Tokens are
counted once: ids, levels and counts are written to the shared folder.

Edge cases: null and empty texts have 0 tokens and are taken with the prefix they lie in. Null levels are nodes of their
own (name null). Nodes without a weight have weight 1; weight 0 gets a budget only as others are full. Leaves of no
tokens take no epochs but the prefix of none. Documents of equal doc_id are ordered by token count. Sums of weights times
the total budget must stay below 2^63. Columns of docs besides doc_id, text and the levels are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.session import stored

BUCKET_DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"


def token_count(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def divide(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Nodes (parent columns, name, weight, capacity, parent_budget) with their budget."""
    keys = [F.col(c) for c in parent] or [F.lit(0)]
    order = [F.expr("capacity / cast(weight as double)").asc_nulls_last(), F.col(name).asc_nulls_first()]
    ranked = Window.partitionBy(*keys).orderBy(*order)
    before, after = ranked.rowsBetween(Window.unboundedPreceding, -1), ranked.rowsBetween(0, Window.unboundedFollowing)
    upto, whole = ranked.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    left = F.col("parent_budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))
    full = F.col("capacity") * F.sum("weight").over(after) <= F.col("weight") * left
    out = nodes.withColumn("full", full).withColumn("full", F.min("full").over(upto))
    rest = F.col("parent_budget") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(whole)
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0))
    out = out.withColumn("rest", rest).withColumn("all_weight", open_weight.over(whole)).withColumn("upto_weight", open_weight.over(upto))
    shared = F.expr(
        "case when all_weight = 0 then 0 else (upto_weight * rest) div all_weight - ((upto_weight - weight) * rest) div all_weight end"
    )
    return out.withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(shared).cast("long")).drop(
        "full", "rest", "all_weight", "upto_weight", "parent_budget"
    )


def budgets(leaves: DataFrame, levels: list[str], weights: dict[str, Column], total: Column, max_epochs: int) -> DataFrame:
    """Leaves (levels, tokens) with budget, whole epochs and the rest of one more.

    weights: for a level an expression of its columns and its ancestors'. total: the root's budget as an expression of
    the sum of tokens, `tokens`.
    """
    root = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    root = root.select(F.least(total, F.col("tokens") * max_epochs).cast("long").alias("parent_budget"))
    above, parent = root, []
    for level in levels:
        path = [*parent, level]
        nodes = leaves.groupBy(*path).agg((F.sum("tokens") * max_epochs).alias("capacity"))
        nodes = nodes.withColumn("weight", F.coalesce(weights.get(level, F.lit(1)), F.lit(1)).cast("long"))
        if parent:
            on = [nodes[c].eqNullSafe(above[f"above_{c}"]) for c in parent]
            nodes = nodes.join(above, on).drop(*[f"above_{c}" for c in parent])
        else:
            nodes = nodes.join(above, F.lit(True))
        done = divide(nodes, parent, level)
        above = done.select(*[F.col(c).alias(f"above_{c}") for c in path], F.col("budget").alias("parent_budget"))
        parent = path
    on = [leaves[c].eqNullSafe(above[f"above_{c}"]) for c in levels]
    out = leaves.join(above, on).select(*[leaves[c] for c in levels], "tokens", F.col("parent_budget").alias("budget"))
    whole = F.expr("case when tokens = 0 then 0 else budget div tokens end")
    return out.withColumn("epochs", whole).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))


def mix(
    docs: DataFrame, levels: dict[str, Column], weights: dict[str, Column], total: Column, max_epochs: int = 4, seed: int = 17, row: str | None = None
) -> DataFrame:
    """Rows of docs that the mixture takes: doc_id, the levels, tokens, epochs (how often whole), taken (tokens of one
    more epoch, null if none). row: a column of distinct numbers, which is returned too and orders rows that share a
    doc_id or have none."""
    names, own = list(levels), ["doc_id"] if row is None else ["doc_id", row]
    rows = stored(docs.select(*own, *[c.cast("string").alias(n) for n, c in levels.items()], token_count(F.col("text")).alias("tokens")))
    leaves = rows.groupBy(*names).agg(F.sum("tokens").alias("tokens"))
    plan = budgets(leaves, names, weights, total, max_epochs)
    plan = plan.select(*[F.col(n).alias(f"leaf_{n}") for n in names], F.col("tokens").alias("leaf_tokens"), "epochs", "rest")
    placed = rows.join(plan, [rows[n].eqNullSafe(F.col(f"leaf_{n}")) for n in names]).drop(*[f"leaf_{n}" for n in names])
    ident = F.col("doc_id").cast("string") if row is None else F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.col(row)))
    placed = placed.withColumn("key", order_key(seed, F.col("epochs") + 1, ident))
    placed = placed.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    sums = placed.groupBy(*names, "bucket").agg(F.sum("tokens").alias("bucket_tokens"), F.max("rest").alias("b_rest"))
    in_leaf = Window.partitionBy(*names).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("offset", F.coalesce(F.sum("bucket_tokens").over(in_leaf), F.lit(0)))
    sums = sums.select(
        *[F.col(n).alias(f"b_{n}") for n in names],
        F.col("bucket").alias("b_bucket"),
        "offset",
        F.expr("case when offset + bucket_tokens <= b_rest then 'in' when offset >= b_rest then 'out' else 'cut' end").alias("side"),
    )
    on = [placed[n].eqNullSafe(F.col(f"b_{n}")) for n in names] + [placed.bucket == F.col("b_bucket")]
    sided = placed.join(sums, on).drop(*[f"b_{n}" for n in names], "b_bucket")
    within = Window.partitionBy(*names, "bucket").orderBy("key", *own, "tokens").rowsBetween(Window.unboundedPreceding, -1)
    cut = sided.where("side = 'cut'").withColumn("start", F.col("offset") + F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    cut = cut.withColumn("taken", F.expr("case when start < rest then least(tokens, rest - start) end")).drop("start")
    even = sided.where("side <> 'cut'").withColumn("taken", F.when(F.col("side") == "in", F.col("tokens")))
    every = even.unionByName(cut).where("epochs > 0 or taken is not null")
    return every.select(*own, *names, "tokens", F.col("epochs").cast("long").alias("epochs"), "taken")


def epochs_of(mixed: DataFrame) -> DataFrame:
    """One row per document and epoch it is taken in: the columns of mixed but for epochs and taken, epoch, taken."""
    parts = F.expr(
        "concat(if(epochs > 0, transform(sequence(1L, epochs), e -> struct(e as epoch, tokens as taken)), array()),"
        " if(taken is null, array(), array(struct(epochs + 1 as epoch, taken as taken))))"
    )
    keep = [c for c in mixed.columns if c not in ("epochs", "taken")]
    return mixed.select(*keep, F.explode(parts).alias("part")).select(*keep, "part.epoch", "part.taken")
