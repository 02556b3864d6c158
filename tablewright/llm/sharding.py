"""Stable shards by jump consistent hashing, in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.session import stored

SHARDS = 16
#: jumps tried before the exact but longer loop; a key needs about ln(shards)
_JUMPS = 64
#: different rows of a shard that are numbered together, about
BUCKET_ROWS = 2048
#: slots of equal rows that are made from one array
_RUN = 65_536
#: multiplier of the generator that jump consistent hashing is defined with, a fixed value
MULTIPLIER = 2862933555777941757
_LOW = (1 << 32) - 1


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """``key * MULTIPLIER + 1`` modulo 2**64 on two halves of 32 bits; nothing passes 2**63."""
    m_hi, m_lo = MULTIPLIER >> 32, MULTIPLIER & _LOW
    a, b = m_lo & 0xFFFF, m_lo >> 16
    low16 = F.lit(0xFFFF)
    part = lo * F.lit(a) + F.shiftleft((lo * F.lit(b)).bitwiseAND(low16), 16) + F.lit(1)
    carry = F.shiftright(part, 32) + F.shiftright(lo * F.lit(b), 16)
    high = carry + (lo * F.lit(m_hi)).bitwiseAND(F.lit(_LOW)) + hi * F.lit(a) + F.shiftleft((hi * F.lit(b)).bitwiseAND(low16), 16)
    return high.bitwiseAND(F.lit(_LOW)), part.bitwiseAND(F.lit(_LOW))


def _jumps(key: Column, shards: int, steps: int) -> Column:
    """State after up to ``steps`` jumps: ``b`` the last shard jumped to, ``j`` the next one."""
    start = F.struct(
        F.lit(-1).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("j"),
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(_LOW)).alias("lo"),
    )

    def step(s: Column, _: Column) -> Column:
        hi, lo = _next(s["hi"], s["lo"])
        # the next shard: (b + 1) * 2**31 / (the upper 31 bits + 1)
        move = (s["j"] + F.lit(1)).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + F.lit(1)).cast("double"))
        moved = F.struct(s["j"].alias("b"), F.floor(move).cast("bigint").alias("j"), hi.alias("hi"), lo.alias("lo"))
        return F.when(s["j"] >= F.lit(shards), s).otherwise(moved)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)


def jump_shard(key: Column, shards: int = SHARDS) -> Column:
    """Shard ``0 .. shards - 1`` of a 64-bit key by jump consistent hashing.

    No table of shards: the key's own generator says at which numbers of shards it moves.
    Appending a shard moves one key in ``shards + 1``, and only into the new one.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    short = _jumps(key, shards, min(shards, _JUMPS))
    if shards <= _JUMPS:
        return short["b"].cast("int")
    return F.when(short["j"] >= F.lit(shards), short["b"]).otherwise(_jumps(key, shards, shards)["b"]).cast("int")


def stable_key(df: DataFrame, ids: str) -> Column:
    """An integer id is its own key, any other is hashed; a missing one has key 0."""
    whole = dict(df.dtypes)[ids] in ("tinyint", "smallint", "int", "bigint")
    key = F.col(ids).cast("bigint") if whole else F.xxhash64(F.col(ids).cast("string"))
    return F.when(F.col(ids).isNull(), F.lit(0).cast("bigint")).otherwise(key)


def with_shard(df: DataFrame, ids: str = "doc_id", shards: int = SHARDS, name: str = "shard") -> DataFrame:
    """``df`` plus its shard (a column of that name is replaced). No shuffle, one pass."""
    return df.withColumn(name, jump_shard(stable_key(df, ids), shards))


def shard_table(df: DataFrame, ids: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """``(ids, size, text_crc32, law, shard, slot, grown_shard)`` for every row.

    ``size`` is the text's UTF-8 bytes plus 1, ``text_crc32`` that of its bytes (null: none, so 0).
    The law is ``key``: the id and the number of shards decide. ``grown_shard`` is the shard
    with one more. ``slot`` numbers the rows of a shard from 0 without gaps, in the order of
    MD5(id:size:checksum), then id, size and checksum. Rows without an id have key 0, repeated rows get
    slots of their own. No rows give no rows.

    Numbering never takes a shard into one task: rows that look the same are counted together,
    what is left is numbered within buckets of that order of some ``BUCKET_ROWS``, and sums per
    bucket give the offsets.
    """
    rows = df.select(
        F.col(ids).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    alike = stored(rows.groupBy("id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n")))
    key = stable_key(alike, "id")
    buckets = max(1, -(-alike.count() // (BUCKET_ROWS * shards)))
    named = F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("size").cast("string"), F.col("text_crc32").cast("string"))
    alike = alike.withColumn("md5", F.md5(named.cast("binary")))
    mixed = F.floor(F.conv(F.substring("md5", 1, 8), 16, 10).cast("bigint") * F.lit(buckets) / F.lit(1 << 32)).cast("bigint")
    placed = alike.withColumns({"shard": jump_shard(key, shards), "grown_shard": jump_shard(key, shards + 1), "bucket": mixed})
    totals = placed.groupBy("shard", "bucket").agg(F.sum("n").alias("rows"))
    ahead = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("shard", "bucket", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("offset"))
    within = W.partitionBy("shard", "bucket").orderBy("md5", "id", "size", "text_crc32").rowsBetween(W.unboundedPreceding, -1)
    numbered = placed.withColumn("first", F.coalesce(F.sum("n").over(within), F.lit(0))).join(offsets, ["shard", "bucket"])
    first = F.col("offset") + F.col("first")
    # rows that look the same come back in runs, so no array grows with their number
    runs = F.explode(F.sequence(first, first + F.col("n") - 1, F.lit(_RUN))).alias("start")
    dealt = numbered.select("id", "size", "text_crc32", "shard", "grown_shard", (first + F.col("n") - 1).alias("last"), runs)
    slots = F.sequence("start", F.least(F.col("last"), F.col("start") + (_RUN - 1)))
    return dealt.select(
        F.col("id").alias(ids), "size", "text_crc32", F.lit("key").alias("law"), "shard", F.explode(slots).alias("slot"), "grown_shard"
    )


def write_shards(df: DataFrame, folder: str, ids: str = "doc_id", shards: int = SHARDS, files: int = 1) -> None:
    """Write ``df`` as Parquet below ``folder``, one subfolder per shard, ``files`` files in each at most."""
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if "map<" not in dict(df.dtypes)[c]]), F.lit(files))
    dealt = with_shard(df, ids, shards).withColumn("__file", salt)
    dealt.repartition(shards * files, "shard", "__file").drop("__file").write.partitionBy("shard").parquet(folder)
