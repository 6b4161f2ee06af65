"""Sharding by extendible hashing.

A row's bits are the leading bits of the SHA-256 of its key.  A shard is a bit prefix; a
prefix whose rows exceed the byte limit splits on its next bit, the others don't.  As bytes
only shrink from a prefix to a longer one, a row's shard is its shortest prefix that fits,
which needs no doubling loop: rounds of ``step`` bits at a time sum the bytes by the longest
prefix of the round, roll the sums up to the shorter ones, and hand only rows of prefixes that
still exceed the limit to the next round.

Sums are added up in the tasks before the shuffle, so that a hot key costs a row a task.
A shard of one row that alone exceeds the limit is as small as it gets; its ``n_bytes`` tells.
Rows of one key share all bits of the digest: where a key's rows exceed the limit together,
the digest's bits end and bits of each row's own position take over.

Null keys are the empty key, null sizes are 0.  Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.storage import stored

#: Bits of the key's digest; after them come bits of the row's position.
KEY_BITS = 60
ALL_BITS = 2 * KEY_BITS


def _sixty_bits(text: Column) -> Column:
    """The first 60 bits of the SHA-256 of a text as a string of 0 and 1."""
    return F.lpad(F.conv(F.substring(F.sha2(text, 256), 1, KEY_BITS // 4), 16, 2), KEY_BITS, "0")


def directory(rows: DataFrame, limit: int, step: int = 12) -> DataFrame:
    """(prefix, depth, n_bytes, n_rows) of every shard for ``rows`` of (bits, size)."""
    found, depth = None, 0
    left = rows.select("bits", "size", F.lit(1).cast("long").alias("n"))
    while True:
        upto = min(depth + step, ALL_BITS)
        sums = left.groupBy(F.substring("bits", 1, upto).alias("bits")).agg(F.sum("size").alias("size"), F.sum("n").alias("n"))
        least = depth if depth == 0 else depth + 1
        levels = sums.select(F.explode(F.sequence(F.lit(least), F.lit(upto))).alias("depth"), "bits", "size", "n")
        nodes = levels.groupBy("depth", F.expr("substring(bits, 1, depth)").alias("prefix")).agg(F.sum("size").alias("n_bytes"), F.sum("n").alias("n_rows"))
        fits = (F.col("n_bytes") <= limit) | (F.col("n_rows") == 1) | (F.col("depth") == ALL_BITS)
        nodes = stored(nodes.withColumn("fits", fits), "shard-nodes")
        # A fitting prefix is a shard if the one above it does not fit; at the top of a later round that one is known not to.
        above = nodes.where("NOT fits").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        children = nodes.where("fits").withColumn("parent", F.expr("substring(prefix, 1, depth - 1)"))
        leaves = children.where(F.col("depth") == least).drop("parent").unionByName(children.where(F.col("depth") > least).join(above, ["depth", "parent"], "left_semi").drop("parent"))
        found = leaves if found is None else found.unionByName(leaves)
        over = nodes.where((F.col("depth") == upto) & ~F.col("fits")).select(F.col("prefix").alias("top"))
        if upto == ALL_BITS or over.isEmpty():
            return found.drop("fits")
        left = left.withColumn("top", F.substring("bits", 1, upto)).join(over, "top", "left_semi").drop("top")
        depth = upto


def assign_shards(frame: DataFrame, key: str, size: Column, limit: int, sent_rows: int = 100_000) -> DataFrame:
    """``frame`` with shard (its bit prefix, empty for a single shard), shard_bytes and shard_rows.

    Rows are stored with their bits first, so that all passes see the same positions.  A directory
    of up to ``sent_rows`` shards is sent to the tasks, a larger one is joined by prefix.
    """
    taken = [c for c in frame.columns if c not in ("shard", "shard_bytes", "shard_rows")]
    keyed = frame.select(*taken, F.coalesce(F.col(key).cast("string"), F.lit("")).alias("__key"), F.coalesce(size, F.lit(0)).cast("long").alias("__size"), F.monotonically_increasing_id().cast("string").alias("__row"))
    keyed = stored(keyed.withColumn("__bits", F.concat(_sixty_bits(F.col("__key")), _sixty_bits(F.col("__row")))).drop("__key", "__row"), "shard-rows")
    found = stored(directory(keyed.select(F.col("__bits").alias("bits"), F.col("__size").alias("size")), limit), "shard-directory")
    sizes = found.groupBy("depth").count().collect()
    depths = sorted(r["depth"] for r in sizes)
    if sum(r["count"] for r in sizes) <= sent_rows:
        placed = keyed
        for d in depths:
            level = found.where(F.col("depth") == d).select(F.col("prefix").alias(f"__p{d}"), F.col("n_bytes").alias(f"__b{d}"), F.col("n_rows").alias(f"__n{d}"))
            placed = placed.join(F.broadcast(level), F.substring("__bits", 1, d) == F.col(f"__p{d}"), "left")
        first = lambda c, kind: F.coalesce(*[F.col(f"__{c}{d}") for d in depths], F.lit(None).cast(kind))
        return placed.select(*taken, first("p", "string").alias("shard"), first("b", "long").alias("shard_bytes"), first("n", "long").alias("shard_rows"))
    # A row has one shard; it is looked up by its prefix of each depth that occurs, at most ALL_BITS of them.
    probed = keyed.select("__bits", F.explode(F.array(*[F.substring("__bits", 1, d) for d in depths])).alias("prefix"))
    placed = probed.join(found.select("prefix", "n_bytes", "n_rows"), "prefix").select("__bits", F.col("prefix").alias("shard"), F.col("n_bytes").alias("shard_bytes"), F.col("n_rows").alias("shard_rows"))
    return keyed.join(placed, "__bits").drop("__bits", "__size")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, below ``path``, named by a letter and the bits, so that leading zeros read back; a shard is within the limit and so one task's work."""
    named = sharded.withColumn("shard", F.concat(F.lit("s"), "shard"))
    named.repartition("shard").write.partitionBy("shard").parquet(path)
