"""Shards by weighted rendezvous hashing of stable record keys.

Every shard bids for a record: the md5 of key and shard gives a number u in (0, 1), and the
shard with the least -ln(u) / weight has the record. The bid of a shard knows nothing of the
others, so a new shard takes records only into itself, a removed one gives up only its own,
and a changed weight moves records only to or from that shard; a shard's expected share is its
weight's. Bids are column expressions, so the choice needs no shuffle; only the places within
shards (`slot`) do, and they are counted without gathering a shard in one task.

Defined results: a null key is a key of its own, rows with one key share a shard, equal bids
go to the smaller shard, a null text has no bytes, an empty table gives no rows; places of rows
with one key are in any order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martloom.llm.frames import column
from martloom.llm.ranks import ranked
from martloom.session import cut

OVERHEAD = 8  # bytes a record takes beside its text


def bids(key: Column, weights: Sequence[float]) -> Column:
    """array<struct<cost, shard>>: what each shard bids, the least cost wins."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be above 0")
    name = F.coalesce(key.cast("string"), F.lit(""))
    each = F.array(*[F.lit(float(w)) for w in weights])

    def bid(weight: Column, shard: Column) -> Column:
        hexes = F.substring(F.md5(F.concat_ws(":", name, shard.cast("string")).cast("binary")), 1, 13)
        u = (F.conv(hexes, 16, 10).cast("double") + 0.5) / float(1 << 52)
        return F.struct((-F.log(u) / weight).alias("cost"), shard.cast("int").alias("shard"))

    return F.transform(each, bid)


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard of each key, from 0."""
    return F.array_min(bids(key, weights))["shard"]


def sharded(
    docs: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text", grown: float | None = None
) -> DataFrame:
    """(id, size, text_crc32, shard, slot, grown_shard) per row; `grown`: the weight of one more shard."""
    data = F.coalesce(column(docs, text), F.lit(""))
    all_bids = bids(F.col("id"), [*weights, *([] if grown is None else [grown])])
    own = docs.select(
        column(docs, key).alias("id"),
        (F.octet_length(data).cast("bigint") + OVERHEAD).alias("size"),
        F.crc32(data.cast("binary")).alias("text_crc32"),
    )
    chosen = own.withColumn("bids", all_bids).select(
        "id", "size", "text_crc32",
        F.array_min(F.slice("bids", 1, len(weights)))["shard"].alias("shard"),
        (F.lit(None).cast("int") if grown is None else F.array_min("bids")["shard"]).alias("grown_shard"),
    )
    return ranked(cut(chosen, "shards"), ["shard"], ["id"], "slot")


def write_shards(docs: DataFrame, weights: Sequence[float], path: str, key: str = "doc_id") -> None:
    """The rows of each shard in a folder `shard=n` of its own, by key; large shards have several files."""
    out = docs.withColumn("shard", shard_of(column(docs, key), weights))
    out.repartitionByRange("shard", key).sortWithinPartitions("shard", key).write.partitionBy("shard").parquet(path)
