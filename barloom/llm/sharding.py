"""Sharding by a hierarchical weighted hash tree.

A document descends from the root over regions and racks to a shard.  At every node each child draws
-ln(u) / weight with its own u in (0, 1) from the hash of document and child, and the least draw wins,
so a child gets rows in proportion to the weight below it.  A draw depends on nothing but the document
and the child: if weights change, only rows of the subtrees whose weights change move, and a shard
added in a region of its own takes rows only into itself.  All in DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stored


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    number: int
    weight: float = 1.0


def even_tree(regions: int, racks: int, per_rack: int) -> list[Shard]:
    return [Shard(f"g{r}", f"g{r}.k{k}", (r * racks + k) * per_rack + s)
            for r in range(regions) for k in range(racks) for s in range(per_rack)]


def grown(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """One more shard, in a region of its own, so that no old subtree changes weight."""
    n = max(s.number for s in tree) + 1
    return [*tree, Shard(f"own{n}", f"own{n}.k0", n, weight)]


def draw(key: Column, child: str, weight: float) -> Column:
    """The child's draw for a document: exponential with the child's weight, from 52 bits of MD5."""
    u = (F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{child}"))), 1, 13), 16, 10).cast("double") + 0.5) / 2.0 ** 52
    return -F.log(u) / F.lit(float(weight))


def _least(key: Column, children: Iterable[tuple[str, float, Column]]) -> Column:
    """The value of the child with the least draw; ties go to the lesser value."""
    options = [F.struct(draw(key, name, weight).alias("draw"), value.alias("value")) for name, weight, value in children]
    return (F.least(*options) if len(options) > 1 else options[0])["value"]


def _chosen(at: Column, branches: dict[str, Column]) -> Column:
    """The branch of the node that was chosen; the others' draws are not made."""
    out = None
    for name, value in branches.items():
        out = F.when(at == name, value) if out is None else out.when(at == name, value)
    return out


def descend(df: DataFrame, key: Column, tree: list[Shard], out: str) -> DataFrame:
    """``df`` with the shard number of each row in ``out``; shards of weight 0 get nothing."""
    tree = [s for s in tree if s.weight > 0]
    total = lambda some: float(sum(s.weight for s in some))
    regions = {r: [s for s in tree if s.region == r] for r in dict.fromkeys(s.region for s in tree)}
    racks = {k: [s for s in tree if s.rack == k] for k in dict.fromkeys(s.rack for s in tree)}
    inside = {r: dict.fromkeys(s.rack for s in some) for r, some in regions.items()}
    return df.withColumn("_key", key) \
        .withColumn("_region", _least(F.col("_key"), [(r, total(some), F.lit(r)) for r, some in regions.items()])) \
        .withColumn("_rack", _chosen(F.col("_region"), {
            r: _least(F.col("_key"), [(k, total(racks[k]), F.lit(k)) for k in some]) for r, some in inside.items()})) \
        .withColumn(out, _chosen(F.col("_rack"), {
            k: _least(F.col("_key"), [(f"{k}.s{s.number}", s.weight, F.lit(s.number)) for s in some])
            for k, some in racks.items()}).cast("int")) \
        .drop("_key", "_region", "_rack")


def numbered(rows: DataFrame, group: str, order: list[str], out: str) -> DataFrame:
    """A gapless number from 0 within each group, in the given order.

    Rows are dealt by ranges of (group, order), so a group may span many tasks; the ranges' counts,
    one row per range and group, are summed in order and added to the place within the range.
    """
    spark = rows.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(rows.repartitionByRange(ranges, group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_range")
    bases = counts.select(group, "_range", (F.sum("_n").over(before) - F.col("_n")).alias("_base"))
    place = F.row_number().over(Window.partitionBy("_range", group).orderBy(*order))
    return dealt.withColumn("_place", place).join(bases, [group, "_range"]) \
        .withColumn(out, (F.col("_base") + F.col("_place") - 1).cast("long")).drop("_range", "_place", "_base")


def shard_documents(docs: DataFrame, tree: list[Shard]) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, grown_shard) for every row.

    size: UTF-8 bytes of the text plus 8; a null text has none, and its checksum is that of nothing.
    ``slot`` is gapless from 0 in each shard, in the order of doc_id (rows that repeat a doc_id share
    its shard and follow each other).  Rows without a doc_id descend as one document of the name
    "null".  ``grown_shard`` is the shard after one more was added.  An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"),
                       F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = descend(descend(rows, key, tree, "shard"), key, grown(tree), "grown_shard")
    return numbered(rows, "shard", ["doc_id", "text_crc32", "size"], "slot") \
        .select("doc_id", "size", "text_crc32", "shard", "slot", "grown_shard")
