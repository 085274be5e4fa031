"""Reproducible shuffle and sharding by a Feistel permutation over global row numbers (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a numbering bucket, and the most buckets: their counts are broadcast, 16 bytes each.
BUCKET_ROWS = 20_000
MOST_BUCKETS = 1 << 20
#: Equal rows that are written out at once.
CHUNK = 4096
ROUNDS = 6
WALK = 256


def numbered(df: DataFrame, rows: int, out: str = "row_no", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The rows of df with gapless numbers from 0 in the order (bucket, hash, columns), bucket being a hash of all columns.

    Equal rows are counted first and written out at the end in chunks of CHUNK, each with its share of the numbers, so
    that no window and no task holds a group of copies whole. Groups are numbered inside their bucket; a bucket's offset
    comes from a running sum over the buckets' counts, which are one small table. Nulls hash like values.
    """
    cols = df.columns
    buckets = min(MOST_BUCKETS, max(1, -(-rows // bucket_rows)))
    groups = df.groupBy(*cols).agg(F.count("*").alias("_n")).withColumn("_hash", F.xxhash64(*cols))
    groups = groups.withColumn("_bucket", F.pmod(F.shiftrightunsigned("_hash", 20), F.lit(buckets)))
    counts = groups.groupBy("_bucket").agg(F.sum("_n").alias("_all"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_bucket", F.coalesce(F.sum("_all").over(before(Window.orderBy("_bucket"))), F.lit(0)).alias("_start"))
    inside = before(Window.partitionBy("_bucket").orderBy("_hash", *cols))
    placed = groups.withColumn("_first", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(F.broadcast(starts), "_bucket")
    first = F.col("_start") + F.col("_first")
    # single rows go straight on; the chunks of copies are dealt out over all tasks
    lone = placed.where("_n = 1").select(*cols, first.alias(out))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {CHUNK}")))
    chunks = placed.where("_n > 1").select(*cols, "_n", first.alias("_at"), chunk.alias("_chunk")).repartition(*[F.col(c) for c in cols], "_chunk")
    last = F.least(F.col("_n"), (F.col("_chunk") + 1) * CHUNK) - 1
    copies = chunks.select(*cols, F.explode(F.sequence(F.col("_at") + F.col("_chunk") * CHUNK, F.col("_at") + last)).alias(out))
    return lone.unionByName(copies)


def permute(df: DataFrame, row_no: str, n: int, seed: int = 0, out: str = "position") -> DataFrame:
    """A keyed permutation of 0..n-1: Feistel on the least rectangle a*b >= n, walked along its cycle until back below n.

    The rectangle exceeds n by less than sqrt(n)+1 points, so a walk is needed by one row in sqrt(n); a walk visits
    each outside point at most once, so WALK steps are a proof for n <= WALK**2 and beyond it a failure has odds
    below n * n**(-WALK/2). Were it to happen, the job stops with an error rather than lose a row.
    """
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))
    first = df.withColumn("_p", _rounds(F.col(row_no), a, b, seed))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.col("_p"), lambda p, _: F.when(p < n, p).otherwise(_rounds(p, a, b, seed)))
    walked = first.withColumn(out, F.when(F.col("_p") < n, F.col("_p")).otherwise(walk))
    fail = F.raise_error(F.lit("a cycle walk did not end; use another seed")).cast("long")
    return walked.withColumn(out, F.when(F.col(out) < n, F.col(out)).otherwise(fail)).drop("_p")


def _rounds(x: Column, a: int, b: int, seed: int) -> Column:
    """The Feistel rounds as a fold over their numbers; the state is (left, right), whose moduli swap each round."""
    start = F.struct(F.pmod(x, F.lit(a)).cast("long").alias("l"), F.floor(x / F.lit(a)).cast("long").alias("r"))

    def step(s, i):
        m = F.when(i % 2 == 0, F.lit(a)).otherwise(F.lit(b)).cast("long")
        mixed = F.pmod(s["l"] + F.pmod(F.xxhash64(F.lit(seed), i, s["r"]), m), m)
        return F.struct(s["r"].alias("l"), mixed.cast("long").alias("r"))

    # after an even number of rounds l is below a again and r below b
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] + s["r"] * F.lit(a))


def shard(docs: DataFrame, shards: int = 40, seed: int = 0) -> DataFrame:
    """Deals documents into shards under the law `rows`: position p of the shuffle goes to shard p mod shards, slot p div shards.

    Needs doc_id and text; other columns are ignored. Returns doc_id, size, text_crc32, law, position, shard, slot, grown_shard.
    size is the UTF-8 bytes of the text plus 16; a null text counts as empty and its crc32 is 0. Null or repeated doc_ids
    are rows like any other, and a doc_id may be of any type that can be grouped. The result depends on the rows and the
    seed alone, not on files or partitions: shard and slot of a row number can be computed without the data. An empty
    table gives no rows.
    """
    slim = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16).alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    n = docs.count()
    p = permute(numbered(slim, n), "row_no", n, seed)
    return p.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "position",
        F.pmod("position", F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"position div {int(shards)}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
