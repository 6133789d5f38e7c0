"""Size-balanced shards by sampled splitters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from subspan.llm.common import durable, table, text_or_empty


def _sample(rows: DataFrame, total: int, want: int, seed: int) -> list[tuple[str, float]]:
    """About want (key, weight) pairs, drawn with chances in proportion to size.

    A row whose size is at least total / want is always drawn, with its size as weight; any other
    stands for total / want. The number drawn is want at most on average, whatever the input.
    """
    step = max(1.0, total / want)
    chance = F.pmod(F.xxhash64("salt", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.where(chance * step < F.col("size")).select("key", F.greatest(F.col("size").cast("double"), F.lit(step)).alias("weight"))
    return sorted(map(tuple, drawn.collect()))


def _quantiles(sample: list[tuple[str, float]], parts: int) -> list[str]:
    """Keys at the inner quantiles of the sample's weight."""
    if not sample:
        return []
    cum = np.cumsum([w for _, w in sample])
    at = np.searchsorted(cum, np.arange(1, parts) * cum[-1] / parts)
    return sorted({sample[min(i, len(sample) - 1)][0] for i in at})


def _ranged(rows: DataFrame, splitters: list[str]) -> DataFrame:
    """rows with the range that each key falls in: the number of splitters not above it. Stored, as it is read several times."""
    cuts = np.array(splitters, dtype="S80")

    @F.pandas_udf("long")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for keys in batches:
            yield pd.Series(np.searchsorted(cuts, keys.to_numpy().astype("S80"), side="right").astype("int64"))

    return durable(rows.withColumn("range", find("key")))


def shard(docs: DataFrame, shards: int = 8, rows_per_range: int = 200_000, per_range: int = 32, rounds: int = 3, whole: float = 0.02) -> DataFrame:
    """(doc_id, size, text_crc32, group, shard, slot): docs cut into shards of near equal bytes.

    A group holds the rows of equal text. Groups of over the share `whole` of a shard are crowded:
    there are at most shards / whole of them, and only they may be divided. The key of a row is its
    text's hash; in a crowded group the document's hash and a salt follow, so that a text that holds
    a third of all rows, and even equal rows, are divisible, and no splitter can fall inside any
    other group. Splitters are size-weighted quantiles of a sample of a fixed number of keys a
    range; ranges that turn out to hold over twice their share are sampled again and divided, up to
    rounds times. Sizes of all ranges give each an offset, a running sum inside the range gives
    every row its place in bytes, and the shard is the part of the total in which the middle of the
    row, or of its undivided group, lies. slot numbers a shard's rows from 0 in key order. What is
    sampled changes no result, as places are exact.

    Null texts have size 1 and form a group with empty ones; equal rows are told apart by their
    order only; an empty table gives an empty result; other columns are ignored.
    """
    text = text_or_empty()
    base = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text).alias("group"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"))
    base = durable(base)
    n, total = base.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    groups = base.groupBy("group").agg(F.sum("size").alias("bytes")).where(F.col("bytes") * float(shards) > whole * total)
    crowded = durable(groups.select("group", F.lit(True).alias("crowded")))
    base = base.join(F.broadcast(crowded), "group", "left").withColumn("crowded", F.col("crowded").isNotNull())
    inner = F.concat(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lpad(F.hex("salt"), 16, "0"))
    base = durable(base.withColumn("key", F.when(F.col("crowded"), F.concat("group", inner)).otherwise(F.col("group"))))
    parts = max(8 * shards, -(-n // rows_per_range))
    splitters = _quantiles(_sample(base, total, parts * per_range, 1), parts)
    ranged = _ranged(base, splitters)
    for seed in range(2, 2 + rounds):
        sizes = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high"))
        over = sizes.where((F.col("bytes") > 2 * total / parts) & (F.col("low") < F.col("high"))).select("range", "bytes").collect()  # fewer than parts / 2
        if not over:
            break
        inside = ranged.where(F.col("range").isin([r["range"] for r in over]))
        new = set(_quantiles(_sample(inside, sum(r["bytes"] for r in over), 2 * len(over) * per_range, seed), 4 * len(over)))
        if new <= set(splitters):
            break
        splitters = sorted(new | set(splitters))
        ranged = _ranged(base, splitters)
    sizes = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    ahead = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # one row a range: bounded by parts and rounds
    offsets = sizes.select("range", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("rows_before"))
    placed = ranged.join(F.broadcast(offsets), "range")
    order = W.partitionBy("range").orderBy("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "size")
    alike = W.partitionBy("range", "group")
    placed = placed.withColumn("end", F.col("bytes_before") + F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("row", F.col("rows_before") + F.row_number().over(order) - 1)
    placed = placed.withColumn("group_end", F.max("end").over(alike)).withColumn("group_size", F.sum("size").over(alike))
    middle = F.when(F.col("crowded"), F.col("end") - F.col("size") / 2).otherwise(F.col("group_end") - F.col("group_size") / 2)
    placed = durable(placed.select("doc_id", "size", "text_crc32", "group", "row", F.least(F.lit(shards - 1), F.floor(middle * shards / float(max(1, total)))).cast("int").alias("shard")))
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "group", "shard", (F.col("row") - F.col("first")).cast("long").alias("slot"))


def op4_shard_by_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shard(table(spark, sf_dir, "documents"))
    return s.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _crc_table() -> list[int]:
    """The CRC-32 of each byte, by its definition."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


OP4_SQL = f"""
WITH b AS (SELECT doc_id, coalesce(text, '') AS text, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
                  md5(coalesce(text, '')) AS g, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
c AS (SELECT g, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT))),
         lambda c, x: xor(c >> 8, {_crc_table()}[(xor(c, x) & 255) + 1])) AS crc FROM (SELECT g, any_value(text) AS text FROM b GROUP BY g)),
t AS (SELECT sum(size) AS total FROM b),
m AS (SELECT g, sum(size) * 8.0 > 0.02 * (SELECT total FROM t) AS crowded FROM b GROUP BY g),
p AS (SELECT doc_id, size, b.g, crowded, sum(size) OVER w AS fin, row_number() OVER w AS n FROM b JOIN m ON b.g = m.g WINDOW w AS (ORDER BY b.g, d, size ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, CASE WHEN crowded THEN fin - size / 2 ELSE max(fin) OVER (PARTITION BY g) - sum(size) OVER (PARTITION BY g) / 2 END AS middle FROM p),
r AS (SELECT *, least(7, CAST(floor(middle * 8 / (SELECT total FROM t)) AS INTEGER)) AS shard FROM s)
SELECT doc_id, size, xor(crc, 4294967295) AS text_crc32, 'bytes' AS law, shard, CAST(n - min(n) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM r JOIN c ON r.g = c.g"""
