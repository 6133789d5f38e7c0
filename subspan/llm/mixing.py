"""Mix sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from subspan.llm.common import WORD, durable, table, text_or_empty


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """(source, source_size, target) from rows (source, source_size), one for each source.

    Sources in code point order, null last, get the weights in turn. The budget is the sum of all
    sizes. Shares are by weight; a source's target stops at max_epochs times its size and what is
    over is shared among the others by weight, until none is above. In order of cap / weight the
    first source that its share does not fill fixes the level for itself and all after it.
    """
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", weight.cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    s = s.withColumn("ratio", F.col("cap").cast("double") / F.col("w"))
    order = W.orderBy("ratio", F.col("source").asc_nulls_last())
    s = s.withColumn("pos", F.row_number().over(order))
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
    everything = W.orderBy("ratio").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(everything) - before).cast("double") / left)
    s = s.withColumn("first", F.min(F.when(F.col("level") <= F.col("ratio"), F.col("pos"))).over(everything))
    s = s.withColumn("level", F.max(F.when(F.col("pos") == F.col("first"), F.col("level"))).over(everything))
    target = F.when(F.col("pos") < F.col("first"), F.col("cap").cast("double")).otherwise(F.col("w") * F.col("level"))
    return s.select("source", "source_size", target.alias("target"))


def schedule(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, rows_per_bucket: int = 50_000, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, taken, start, finish, epochs.

    Documents are shuffled by md5(doc_id). start and finish are the document's place in its source's
    queue in words, over the target: its virtual times in the first pass; each further pass adds
    source_size / target. Every source is served in proportion to its target, so the words that the
    whole mix has sent by virtual time v are v times the sum of targets, and the total budget is
    reached at v = 1. epochs lists, for each pass that begins before that, epoch, finish and the
    words taken; the document in service at the cut is cut there, so a source's words sum to its
    target rounded down. The running sums are taken within (source, leading hex digits of the
    shuffle key) and joined to offsets of these buckets, so that a source of any size is spread.

    Null text has size 0, null sources form one source, equal rows are served one after the other,
    documents without words take 0, and an empty table gives an empty result. Columns other than
    doc_id, text, source and carry are ignored.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    base = docs.select("doc_id", "source", F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"), key.alias("key"), *carry)
    base = base if carry else durable(base)  # carried texts are read again rather than stored again
    largest = base.groupBy("source").count().agg(F.max("count")).first()[0] or 1
    digits = max(2, math.ceil(math.log(max(1, largest / rows_per_bucket), 16)) + 1)
    base = base.withColumn("bucket", F.substring("key", 1, digits))
    buckets = base.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    ahead = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = buckets.withColumn("ahead", ahead).alias("o").join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source"))).select("o.source", "bucket", "ahead", "source_size", "target")
    within = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    queued = base.withColumn("end", F.sum("size").over(within)).alias("d").join(offsets.alias("o"), F.col("d.source").eqNullSafe(F.col("o.source")) & (F.col("d.bucket") == F.col("o.bucket")))
    queued = queued.select("d.doc_id", "d.source", "size", "key", "source_size", "target", (F.col("ahead") + F.col("end")).alias("end"), *carry)

    def words(epoch: Column) -> Column:
        """Words of this pass that come before the cut at virtual time 1."""
        begun = epoch * F.col("source_size") + F.col("end") - F.col("size")
        return F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - begun))

    over = F.when(F.col("target") > 0, F.col("target"))
    passes = F.array(*[F.struct(F.lit(e).alias("epoch"), ((e * F.col("source_size") + F.col("end")) / over).alias("finish"), words(F.lit(e)).alias("words")) for e in range(max_epochs)])
    return queued.select(
        "doc_id", "source", "size", "source_size", "target", sum(words(F.lit(e)) for e in range(max_epochs)).cast("long").alias("taken"),
        ((F.col("end") - F.col("size")) / over).alias("start"), (F.col("end") / over).alias("finish"), F.filter(passes, lambda p: p["words"] > 0).alias("epochs"), "key", *carry,
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """The mixed corpus in service order: the rows of docs, repeated by pass, cut at the budget.

    Rows are range-partitioned and sorted by virtual finish time. A document that the budget cuts
    keeps its text up to the last word taken. The columns are those of docs; n_chars, where docs has
    it, is the length of the text as it now is. Rows of which nothing is taken are absent.
    """
    carried = tuple(c for c in docs.columns if c not in ("doc_id", "source"))
    kept = docs.select("doc_id", "source", "text", F.struct(*carried).alias("_row"))
    served = schedule(kept, weights, max_epochs, carry=("_row",))
    rows = served.select("doc_id", "source", "size", "key", "_row", F.explode("epochs").alias("p"))
    cut = F.expr(r"regexp_extract(_row.text, concat('^(?:[\\x20\\x09-\\x0D]*+[^\\x20\\x09-\\x0D]++){', p.words, '}+'), 0)")
    rows = rows.withColumn("_text", F.when(F.col("p.words") < F.col("size"), cut).otherwise(F.col("_row.text")))
    ordered = rows.repartitionByRange(F.col("p.finish"), F.col("key"), F.col("p.epoch")).sortWithinPartitions("p.finish", "key", "p.epoch")
    held = {"doc_id": F.col("doc_id"), "source": F.col("source"), "text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return ordered.select(*[held.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = schedule(table(spark, sf_dir, "documents"))
    s = s.repartitionByRange(F.col("finish"), F.col("key")).sortWithinPartitions("finish", "key")
    return s.select("doc_id", "size", "source_size", "target", "taken", "start", "finish")


OP2_SQL = r"""
WITH base AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 3 * source_size AS cap FROM s),
r AS (SELECT *, CAST(cap AS DOUBLE) / w AS ratio, row_number() OVER (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST) AS pos FROM w),
l AS (SELECT *, CAST((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
             / sum(w) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
f AS (SELECT min(pos) AS first FROM l WHERE level <= ratio),
t AS (SELECT source, source_size,
             CASE WHEN pos < (SELECT first FROM f) THEN CAST(cap AS DOUBLE) ELSE w * (SELECT level FROM l WHERE pos = (SELECT first FROM f)) END AS target
      FROM l),
q AS (SELECT b.*, source_size, target, sum(size) OVER (PARTITION BY b.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS fin
      FROM base b JOIN t ON b.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, floor(target) - (fin - size))) + greatest(0, least(size, floor(target) - (source_size + fin - size)))
          + greatest(0, least(size, floor(target) - (2 * source_size + fin - size))) AS BIGINT) AS taken,
       CAST(fin - size AS DOUBLE) / CASE WHEN target > 0 THEN target END AS start,
       CAST(fin AS DOUBLE) / CASE WHEN target > 0 THEN target END AS finish
FROM q"""
