"""Sharding by extendible hashing: a directory over the leading bits of a hash; only buckets above the byte limit split.

A row's hash is the first 60 bits of the MD5 of its key, its size the UTF-8 bytes of its text (null: 0). A bucket is a
bit prefix; one above the limit splits on the next bit until each shard fits. What no bit can split (one row above the
limit, or rows of one key) stays a shard of 60 bits if it is too large, marked oversize. A null key hashes as the empty
string; rows of one key stay together. A text of any length counts by its bytes; an empty table stays empty. Extra columns
are kept, those with an output's name replaced. Column functions only.

One scan writes a narrow table, the bytes of each key; sizes of all prefixes of up to `bits` bits come from it, and keys
below a prefix that is still too large then are split by the rest of their bits the same way. No bucket is gathered
anywhere. The directory is a stored table of known size, so that Spark sends it to all tasks if it is small, and else
parts a hot key's rows by its skew join; rows keep to a second scan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import apart, stored

HASH_BITS = 60
OUTPUTS = ("doc_bytes", "shard", "depth", "shard_bytes", "oversize")


def hashed(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def prefix(h: Column, depth: Column) -> Column:
    """The first depth bits as a number."""
    return F.call_function("shiftright", h, (F.lit(HASH_BITS) - depth).cast("int"))


def _shards(sizes: DataFrame, key: str, low: int, high: int, limit: int) -> DataFrame:
    """Buckets of depth low..high that fit though the one above does not; sizes has the bytes by `key`, the first `high` bits."""
    at = F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")
    every = sizes.select(key, "bytes", at).withColumn("bucket", F.call_function("shiftright", F.col(key), (F.lit(high) - F.col("depth")).cast("int")))
    sums = every.groupBy("depth", "bucket").agg(F.sum("bytes").alias("shard_bytes"))
    over = sums.where(F.col("shard_bytes") > limit).select((F.col("depth") + 1).alias("depth"), F.col("bucket").alias("_above"))
    fits = sums.where(F.col("shard_bytes") <= limit)
    split = fits.where(F.col("depth") > low).withColumn("_above", F.shiftright("bucket", 1)).join(over, ["depth", "_above"], "left_semi").drop("_above")
    return fits.where(F.col("depth") == low).unionByName(split)


def shard(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 64 << 20) -> DataFrame:
    """Adds doc_bytes, shard (the bucket's bits as a string), depth, shard_bytes and oversize."""
    keep, own = apart(df, OUTPUTS)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")
    keys = stored(df.select(hashed(F.col(key)).alias("h"), size.alias("bytes")).groupBy("h").agg(F.sum("bytes").alias("bytes")), "keys")
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    # so deep that a leaf holds about 1/64 of a shard; leaves grow in number with the shards, in rows never
    bits = min(40, max(6, math.ceil(math.log2(max(1, total / limit))) + 6))
    leaf = F.shiftright("h", HASH_BITS - bits)
    leaves = stored(keys.groupBy(leaf.alias("leaf")).agg(F.sum("bytes").alias("bytes")), "leaves")
    shift = F.lit(bits) - F.col("depth")
    first = F.call_function("shiftleft", F.col("bucket"), shift)
    # a shard's leaves lie in a row; all shards together have as many as the directory
    upper = _shards(leaves, "leaf", 0, bits, limit).withColumn("leaf", F.explode(F.sequence(first, first + F.call_function("shiftleft", F.lit(1).cast("bigint"), shift) - 1)))
    below = keys.withColumn("leaf", leaf).join(leaves.where(F.col("bytes") > limit).select("leaf"), "leaf", "left_semi").select("h", "bytes")
    deep = _shards(below, "h", bits + 1, HASH_BITS, limit)
    paths = below.select("h", F.explode(F.sequence(F.lit(bits + 1), F.lit(HASH_BITS))).alias("depth")).withColumn("bucket", prefix(F.col("h"), F.col("depth")))
    lower = paths.join(deep, ["depth", "bucket"])
    single = below.where(F.col("bytes") > limit).select("h", F.lit(HASH_BITS).alias("depth"), F.col("h").alias("bucket"), F.col("bytes").alias("shard_bytes"))
    found = ["depth", "bucket", "shard_bytes"]
    tables = []
    for at, rows in (("leaf", upper), ("h", lower.unionByName(single))):
        table = stored(rows.select(at, *found), "directory")
        tables.append(table.select(F.col(at).alias(own(f"{at}_of")), *[F.col(c).alias(own(f"{at}_{c}")) for c in found]))
    h = own("h")
    rows = df.select(*keep, size.alias("doc_bytes"), hashed(F.col(key)).alias(h))
    rows = rows.join(tables[0], F.shiftright(h, HASH_BITS - bits) == F.col(own("leaf_of")), "left").join(tables[1], F.col(h) == F.col(own("h_of")), "left")
    depth, bucket, held = (F.coalesce(own(f"leaf_{c}"), own(f"h_{c}")) for c in found)
    name = F.when(depth > 0, F.lpad(F.conv(bucket.cast("string"), 10, 2), depth, F.lit("0"))).otherwise("")
    return rows.select(*keep, "doc_bytes", name.alias("shard"), depth.alias("depth"), held.alias("shard_bytes"), (held > limit).alias("oversize"))
