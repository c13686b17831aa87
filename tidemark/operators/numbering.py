"""Exact samples and gapless row numbers without a global sort or one window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import written

#: Groups whose cuts are broadcast; beyond it they are joined like any table.
MOST_BROADCAST = 200_000


def digest(ids: list[str], seed: int = 0) -> Column:
    """md5 of the seed and the identifiers as text, joined by ``|``; null counts as empty."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ids]).cast("binary"))


def exact_sample(
    df: DataFrame, keys: list[str], ids: list[str], n: int | None = None, fraction: float | None = None, seed: int = 0, order: list[str] | None = None
) -> DataFrame:
    """Exactly ``n`` rows per group (all, if there are fewer), or the ``fraction`` of it
    rounded half up: those with the smallest digests of ``ids``, ties by ``ids``.

    Counts per group and digest prefix (4096 of them, added up before they are shuffled)
    give the prefix at which a group is cut.  Rows below it are taken where they are; only
    those at it, a 4096th of a group, are ranked.  The choice hangs on identifiers alone,
    never on partitions; of rows with equal identifiers any may be chosen.  Groups may be
    null, no ``keys`` means one group, an empty table gives an empty one.  ``order`` sorts
    the result."""
    if (n is None) == (fraction is None):
        raise ValueError("give n or fraction")
    columns = df.columns
    marked = df.withColumn("digest_", digest(ids, seed)).withColumn("slot_", F.conv(F.substring("digest_", 1, 3), 16, 10).cast("int"))
    groups = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    marked = marked.withColumn("group_", groups)
    w = Window.partitionBy("group_")
    before = F.coalesce(F.sum("rows_").over(w.orderBy("slot_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = F.lit(n) if fraction is None else F.floor(F.lit(fraction) * F.sum("rows_").over(w) + 0.5)
    counts = marked.groupBy("group_", "slot_").agg(F.count(F.lit(1)).alias("rows_"))
    begun = counts.withColumns({"before_": before, "wanted_": wanted}).filter("before_ < wanted_")
    cuts = begun.groupBy(F.col("group_").alias("of_")).agg(
        F.max("slot_").alias("cut_"), F.max_by(F.col("wanted_") - F.col("before_"), "slot_").alias("take_")
    )
    cuts = written(cuts, "sample-cuts")
    few = cuts.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    placed = marked.join(F.broadcast(cuts) if few else cuts, F.col("group_") == F.col("of_"))  # structs: null equals null
    rank = F.row_number().over(w.orderBy("digest_", *ids))
    edge = placed.filter("slot_ = cut_").withColumn("rank_", rank).filter("rank_ <= take_")
    out = placed.filter("slot_ < cut_").select(*columns).unionByName(edge.select(*columns))
    return out.orderBy(*order) if order else out


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "position") -> DataFrame:
    """Adds ``name``: the row's place in its series, gapless from 0.

    Rows are dealt out by ranges of series and order, so a long series lies in many
    partitions, one after another; a row's number is its place in the partition plus the
    rows of the series in those before it.  ``order`` should tell all rows of a series
    apart: rows that it does not are numbered in any order, by one task."""
    dealt = df.repartitionByRange(*keys, *order).withColumn("part_", F.spark_partition_id())
    fixed = written(dealt, "numbered")  # ranges must not change once they are counted
    sizes = fixed.groupBy(*keys, "part_").agg(F.count(F.lit(1)).alias("rows_"))
    before = F.sum("rows_").over(Window.partitionBy(*keys).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1))
    names = {k: f"key{i}_" for i, k in enumerate(keys)}
    offsets = sizes.withColumn("before_", F.coalesce(before, F.lit(0))).withColumnsRenamed(names | {"part_": "at_"}).drop("rows_")
    same = F.col("part_") == F.col("at_")
    for k, other in names.items():
        same &= F.col(k).eqNullSafe(F.col(other))
    within = F.row_number().over(Window.partitionBy(*keys, "part_").orderBy(*order))
    out = fixed.withColumn("within_", within).join(offsets, same)
    return out.select(*df.columns, (F.col("before_") + F.col("within_") - 1).alias(name))
