"""Bloom filters: keys that can't be in a join are dropped before rows are moved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter for each key, and at most: 4 MB in memory. Beyond that more rows pass, which the join drops.
BITS, MOST_BITS = 16, 1 << 25


def bloom_filter(keys: DataFrame, key: Column, bits: int) -> DataFrame:
    """One row, words: a Bloom filter of so many bits (a power of two, 64 at least), two to a key, as an array of 64-bit numbers."""
    places = F.array(F.pmod(F.xxhash64(key), F.lit(bits)), F.pmod(F.xxhash64(key, F.lit(1)), F.lit(bits)))
    set_bits = keys.select(F.explode(places).alias("place")).groupBy(F.shiftright("place", 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("place", F.lit(64)).cast("int"))).alias("word"))
    every = keys.sparkSession.range(bits // 64).withColumnRenamed("id", "at").join(set_bits, "at", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("word", F.lit(0).cast("long")).alias("word")))), lambda x: x["word"]).alias("words"))


def may_contain(words: Column, key: Column, bits: int) -> Column:
    """Whether a key may be in the filter; those that are always may."""
    bit = lambda h: F.call_function("shiftright", F.get(words, F.shiftright(F.pmod(h, F.lit(bits)), 6).cast("int")), F.pmod(h, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1
    return bit(F.xxhash64(key)) & bit(F.xxhash64(key, F.lit(1)))


def that_may_meet(rows: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """rows without most of those whose columns no row of keys has. Keys are counted when this is called."""
    bits, wanted = 64, min(keys.count() * BITS, MOST_BITS)
    while bits < wanted:
        bits *= 2
    key = F.struct(*columns)
    known = F.broadcast(bloom_filter(keys, key, bits).withColumnRenamed("words", "bits of keys"))  # one row of bits / 8 bytes
    return rows.crossJoin(known).where(may_contain(F.col("bits of keys"), key, bits)).drop("bits of keys")
