"""Mixing sources to target weights by entropy balancing.

The mix takes each word of a document at a rate r. Rates are as near as possible to 1 in relative entropy, weighted by
words, while each source's words reach its target: minimise sum(size * (r log r - r)) under sum(size * r) = target. The
convex dual has one unknown per source, and its optimum tilts the documents exponentially, r = exp(theta_source). Newton's
step needs two sums per source, which Spark gathers with partial aggregation over all documents; the iterations then run
on one row per source. Targets stop at twice a source's size, so no rate exceeds 2.

Rates become whole copies: every document is taken floor(r) times, and of the rest an even share, spread over document
sizes by systematic rounding. What a source then misses or exceeds is made up by its smallest documents. Positions come
from sums per (source, bucket) and windows inside a bucket, so a source with a third of all rows is spread over many tasks.

Everything is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.llm.common import TOKENS, cut

NEWTON_STEPS = 40
HASH_BUCKETS = 64


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKENS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target): `share` of all words by the weights, which repeat over the sources in code point order
    (null last); a target stops at `cap` times its source, and the excess is shared anew by weight until none is above.

    Sharing anew ends where every target is min(cap * size, level * weight) for one common level. The level follows from
    prefix sums over the sources ordered by cap * size / weight. Needs share <= cap. One row per source from here on.
    """
    if share > cap or min(weights) <= 0:
        raise ValueError("share must not exceed cap, and weights must be positive")
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))).cast("int") + 1))
    s = s.withColumn("full", F.lit(cap) * F.col("source_size")).withColumn("level", F.col("full") / F.col("weight"))
    up = Window.orderBy("level", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    s = s.withColumns({
        "total": F.sum("source_size").over(every) * F.lit(share),
        "capped": F.coalesce(F.sum("full").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "open": F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)),
    })
    # the first source that a common level no longer fills sets that level
    s = s.withColumn("here", (F.col("total") - F.col("capped")) / F.col("open"))
    s = s.withColumn("common", F.min(F.when(F.col("here") <= F.col("level"), F.struct("level", "here"))).over(every)["here"])
    return s.select("source", "source_size", F.least("full", F.coalesce(F.col("common") * F.col("weight"), "full")).alias("target"))


def rates(goals: DataFrame, steps: int = NEWTON_STEPS) -> DataFrame:
    """Adds `rate` by Newton's method on the dual: d/dtheta (exp(theta) * size - theta * target) = 0.

    A step is kept to at most 1, so that the iteration also converges from far away. Sources without words have rate 0.
    """
    step = "theta - least(1D, greatest(-1D, (exp(theta) * source_size - target) / (exp(theta) * source_size)))"
    theta = F.expr(f"aggregate(sequence(1, {steps}), 0D, (theta, i) -> {step})")
    return goals.withColumn("rate", F.when((F.col("source_size") > 0) & (F.col("target") > 0), F.exp(theta)).otherwise(F.lit(0.0)))


def _running(df: DataFrame, keys: list[str], order: list, value: str, name: str) -> DataFrame:
    """`name`: the sum of `value` over the rows of the same keys up to this one, by bucket and then by `order`.

    Two levels: one row per (keys, bucket) is summed over the keys, and rows are summed inside their bucket only.
    """
    same = [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys] + [F.col("bucket") == F.col("_b_bucket")]
    sums = df.groupBy(*keys, "bucket").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"_b_{k}") for k in keys], F.col("bucket").alias("_b_bucket"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    inside = Window.partitionBy(*keys, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("_inside", F.sum(value).over(inside)).join(sums, condition, "left")
    return out.select(*df.columns, (F.col("_before") + F.col("_inside")).alias(name))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """doc_id, source, size (words), source_size, target, rate, copies (0, 1 or 2 with cap 2) and taken = copies * size.

    Null texts and empty texts have size 0; rows of a null source form the last source. Repeated rows are taken each for
    itself. Documents without words follow their source's rate rounded down. The choice depends on the rows alone, so
    reruns agree. An empty table gives an empty result; other columns are left out.
    """
    sizes = cut(docs.select("doc_id", "source", words(F.col("text")).alias("size")))
    goals = rates(targets(sizes, weights, share, cap)).select(F.col("source").alias("_source"), "source_size", "target", "rate")
    rows = sizes.join(goals, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumns({"base": F.floor(F.col("rate") + F.lit(1e-9)), "pick": F.xxhash64("doc_id", "size")})
    rows = rows.withColumns({"part": F.greatest(F.col("rate") - F.col("base"), F.lit(0.0)), "bucket": F.floor(F.log2(F.col("size") + 1) * 8).cast("long") * HASH_BUCKETS + F.pmod("pick", F.lit(HASH_BUCKETS)), "one": F.when(F.col("size") > 0, 1).otherwise(0)})
    order = ["size", "pick", "doc_id"]
    ranked = _running(rows, ["source"], order, "one", "rank")
    # of the documents in order of size every (1 / part)-th gets one copy more
    extra = F.floor(F.col("rank") * F.col("part") + 0.5) - F.floor((F.col("rank") - 1) * F.col("part") + 0.5)
    first = cut(ranked.withColumn("copies", F.col("base") + F.when(F.col("one") == 1, extra).otherwise(0)).drop("rank", "base", "part", "one", "rate"))
    # the smallest documents make up for what is missing or too much
    off = first.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("miss")).select(F.col("source").alias("_source"), F.round("miss").cast("long").alias("miss"))
    second = first.join(off, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    can = (F.col("size") > 0) & F.when(F.col("miss") > 0, F.col("copies") < F.floor(F.lit(cap))).otherwise(F.col("copies") > 0)
    second = second.withColumn("movable", F.when(can, F.col("size")).otherwise(0))
    done = _running(second, ["source"], order, "movable", "moved")
    moves = (F.col("movable") > 0) & (F.col("moved") <= F.abs("miss"))
    copies = (F.col("copies") + F.when(moves, F.signum(F.col("miss").cast("double"))).otherwise(F.lit(0))).cast("long")
    return done.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def apply(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes its document.

    Copies are joined back by document, source and size. Rows that repeat there share their copies: `n` rows that are
    taken `c` times together appear c times, the first rows first.
    """
    key = ["doc_id", "source", "_size"]
    rows = docs.withColumn("_size", words(F.col("text")))
    got = mix(docs, weights, share, cap).groupBy(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_n")).agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows")).filter("_copies > 0")
    joined = rows.join(got, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_n")))
    lone = joined.filter("_rows = 1").withColumn("_take", F.col("_copies"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("text")))
    many = joined.filter("_rows > 1").withColumn("_place", place - 1).withColumn("_take", F.floor((F.col("_copies") + F.col("_rows") - 1 - F.col("_place")) / F.col("_rows"))).drop("_place")
    return lone.unionByName(many).withColumn("_copy", F.explode(F.expr("sequence(1L, _take)"))).select(*docs.columns) if docs.columns else docs
