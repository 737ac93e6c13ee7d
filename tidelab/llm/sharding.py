"""Sharding by jump consistent hashing, in column expressions only.

The jump hash draws, from a linear congruential sequence seeded with the key, the shard counts at
which the key would move; the last one below the wanted count is its shard. No ring table is kept,
and one more shard takes rows only into itself, about one in ``shards + 1``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelab.llm.common import stored, utf8

LCG_MULTIPLIER = 2862933555777941757  # fixed value of the jump hash
_LOW = 0xFFFFFFFF


def _step(key: Column) -> Column:
    """``key * LCG_MULTIPLIER + 1`` modulo 2^64 on a struct of two 32-bit halves: products of 32 and
    16 bits never leave a signed 64-bit integer, so the result is the same under ANSI checks."""
    hi, lo = key["hi"], key["lo"]
    a_hi, a_lo = LCG_MULTIPLIER >> 32, LCG_MULTIPLIER & _LOW
    a1, a0 = a_lo >> 16, a_lo & 0xFFFF
    low = lo * a0 + F.shiftleft((lo * a1).bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    carry = F.shiftright(low, 32) + F.shiftright(lo * a1, 16)
    cross = (lo * a_hi).bitwiseAND(F.lit(_LOW)) + hi * a0 + F.shiftleft((hi * a1).bitwiseAND(F.lit(0xFFFF)), 16)
    return F.struct(
        (carry + cross).bitwiseAND(F.lit(_LOW)).alias("hi"), low.bitwiseAND(F.lit(_LOW)).alias("lo")
    )


def _jump(state: Column, shards: int) -> Column:
    """One draw, unless the next jump already lies at or beyond ``shards``."""
    key = _step(state["key"])
    # next = floor((b + 1) * 2^31 / ((key >> 33) + 1)), in double precision as published
    nxt = F.floor((state["next"] + 1) * (F.lit(2147483648.0) / (F.shiftright(key["hi"], 1) + 1).cast("double"))).cast("long")
    moved = F.struct(key.alias("key"), state["next"].alias("shard"), nxt.alias("next"))
    return F.when(state["next"] < shards, moved).otherwise(state)


def jump_shard(key: Column, shards: int, unrolled: int = 48) -> Column:
    """The shard (0 to ``shards - 1``) of a long ``key``. Each draw moves on by one shard at least,
    so ``shards`` draws always end; ``unrolled`` suffice for nearly all rows, and only the
    rest runs the remaining ones."""
    start = F.struct(
        F.struct(F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(_LOW)).alias("lo")).alias("key"),
        F.lit(-1).cast("long").alias("shard"), F.lit(0).cast("long").alias("next"),
    )
    draws = lambda begin, n: F.aggregate(F.sequence(F.lit(1), F.lit(n)), begin, lambda s, _: _jump(s, shards))
    most = shards + 1
    done = draws(start, min(most, unrolled))
    if most > unrolled:
        done = F.when(done["next"] >= shards, done).otherwise(draws(done, most - unrolled))
    return done["shard"].cast("int")


def stable_key(column: Column, kind: str) -> Column:
    """Integers are keys as they are, anything else by XXH64; null is the key 0."""
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    return F.coalesce(column.cast("long") if whole else F.xxhash64(column), F.lit(0).cast("long"))


def shard_documents(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", slot_rows: int = 20_000,
) -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``.

    ``size`` is the text's UTF-8 bytes (null: none) plus one. The doc_id and the number of shards
    alone decide the shard; ``grown_shard`` is the shard with one more. ``slot`` numbers a
    shard's rows from 0 without gaps: rows are dealt to chunks of about ``slot_rows`` at random,
    numbered inside a chunk, and moved on by the sizes of the chunks before, so neither a shard
    nor a repeated id is ever sorted in one task. Repeated rows get slots of their own, a null id is
    the key 0, empty texts have size 1, an empty table gives no rows, other columns are not read."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = dict(docs.dtypes)[id_col]
    key = stable_key(F.col(id_col), kind)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(utf8(text_col).cast("binary")).alias("text_crc32"),
        jump_shard(key, shards).alias("shard"), jump_shard(key, shards + 1).alias("grown_shard"),
        F.rand(5).alias("_deal"),
    )
    rows, _ = stored(rows, "shards")
    total = rows.count()
    chunks = max(1, -(-total // (slot_rows * shards)))
    rows = rows.withColumn("_chunk", F.floor(F.col("_deal") * chunks))
    sizes = rows.groupBy("shard", "_chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("shard", "_chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = Window.partitionBy("shard", "_chunk").orderBy("doc_id", "text_crc32", "_deal")
    return (
        rows.withColumn("_at", F.row_number().over(place) - 1)
        .join(bases, ["shard", "_chunk"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
            (F.col("base") + F.col("_at")).alias("slot"), "grown_shard",
        )
    )
