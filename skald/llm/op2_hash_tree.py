"""Sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard, and at each level the child with
the smallest draw wins.  A shard draws -ln(u) / weight with u from a hash of the
document's id and the shard; a rack or region draws what the best of its shards
draws, which is again exponential with the sum of their weights as rate.  So a
child gets documents in proportion to its weight, and where weights change or
shards are added, documents move only into or out of those shards: a subtree
that holds none of them keeps its draws, and nothing moves between others.
One more shard therefore takes documents only into itself, whatever the number
of shards (law ``key``).

Slots number each shard's documents without gaps.  Rows that repeat an id and
text are counted before they are shuffled; shards are cut into buckets by the
hash of id and text; the buckets' counts (bounded in number) give offsets, and
a window numbers each bucket, so no shard passes through one task.

Defined results: a null text has size 1 and checksum 0; a null id draws like
an empty text and always lands in one shard; rows that repeat an id share a
shard and take slots of their own; equal draws go to the first child; a text of
any length is a size and a checksum and nothing more; an empty table gives no
rows; columns other than id and text are not read, so their
names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """A region, rack or shard; a shard has a number and a weight of its own."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int = -1
    own_weight: float = 1.0

    @property
    def shards(self) -> tuple[Node, ...]:
        return tuple(s for c in self.children for s in c.shards) if self.children else (self,)

    @property
    def weight(self) -> float:
        return sum(s.own_weight for s in self.shards)


def tree(n: int, racks: int = 2, per_rack: int = 2, weights: dict[int, float] | None = None) -> Node:
    """The tree of shards 0..n-1, region by region: the next shard goes to the last rack, a new rack or a new region."""
    weights = weights or {}
    rack_of = [tuple(Node(f"s{i}", (), i, float(weights.get(i, 1.0))) for i in range(at, min(at + per_rack, n))) for at in range(0, n, per_rack)]
    all_racks = [Node(f"r{k}", shards) for k, shards in enumerate(rack_of)]
    return Node("root", tuple(Node(f"g{k // racks}", tuple(all_racks[k : k + racks])) for k in range(0, len(all_racks), racks)))


def shard_draw(id_text: Column, shard: Node) -> Column:
    """A shard's draw for a document: exponential with its weight as rate, from an MD5 prefix."""
    h = F.conv(F.substring(F.md5(F.concat(id_text, F.lit(f"/{shard.name}")).cast("binary")), 1, 12), 16, 10).cast("double")
    return -F.log((h + 0.5) / F.lit(float(1 << 48))) / F.lit(shard.own_weight)


def place(draws: dict[int, Column], node: Node) -> Column:
    """The shard of a document below a node, from the shards' draws."""
    if not node.children:
        return F.lit(node.shard)
    alive = [c for c in node.children if c.weight > 0]
    best = [F.least(*own) if len(own := [draws[s.shard] for s in c.shards if s.own_weight > 0]) > 1 else own[0] for c in alive]
    if len(alive) == 1:
        return place(draws, alive[0])
    least, out = F.least(*best), place(draws, alive[-1])
    for d, c in reversed(list(zip(best[:-1], alive[:-1]))):
        out = F.when(d <= least, place(draws, c)).otherwise(out)
    return out


def id_text(id_column: str) -> Column:
    return F.coalesce(F.col(id_column).cast("string"), F.lit(""))


def placed(rows: DataFrame, id_column: str, shards: int, weights: dict[int, float] | None = None) -> DataFrame:
    """The rows with ``shard`` and, with one more shard of weight 1, ``grown_shard``."""
    now, grown = tree(shards, weights=weights), tree(shards + 1, weights=weights)
    draws = {s.shard: F.col(f"draw_{s.shard}") for s in grown.shards}
    drawn = rows.select("*", *(shard_draw(id_text(id_column), s).alias(f"draw_{s.shard}") for s in grown.shards if s.own_weight > 0))
    return drawn.select(*rows.columns, place(draws, now).alias("shard"), place(draws, grown).alias("grown_shard"))


def shard_documents(docs: DataFrame, shards: int = 8, buckets: int = 1_024, id_column: str = "doc_id", text_column: str = "text", weights: dict[int, float] | None = None) -> DataFrame:
    """Per row: id, size, text_crc32, law, shard, slot and grown_shard (with one more shard)."""
    text = F.coalesce(text_column, F.lit(""))
    rows = docs.select(F.col(id_column).alias("id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = placed(rows, "id", shards, weights).withColumn("bucket", F.pmod(F.xxhash64("id", "text_crc32"), F.lit(buckets)).cast("int"))
    each = rows.groupBy("shard", "grown_shard", "bucket", "id", "text_crc32", "size").agg(F.count(F.lit(1)).alias("copies"))
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # At most shards x buckets rows, whatever the input.
    offsets = F.broadcast(counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    earlier = Window.partitionBy("shard", "bucket").orderBy(F.col("id").asc_nulls_first(), "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    numbered = each.withColumn("within", F.coalesce(F.sum("copies").over(earlier), F.lit(0))).join(offsets, ["shard", "bucket"])
    at = F.col("first") + F.col("within")
    slots = numbered.withColumn("slot", F.explode(F.sequence(at, at + F.col("copies") - 1)))
    return slots.select(F.col("id").alias(id_column), "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long"), "grown_shard")
