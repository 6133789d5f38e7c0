"""SimHash near-duplicates through an inverted index of byte positions."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subspan.llm.common import durable, slices, table, text_or_empty
from subspan.plans.components import connected_components

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: str, words: int = 4) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of the text with A-Z lower-cased, repeats included."""
    found = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not found:
        return np.empty(0, np.uint64)
    line, n = b" ".join(found), max(1, len(found) - words + 1)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.concatenate(([0], ends))[:n].tolist()
    stops = (ends[len(found) - n :] - 1).tolist()
    return np.fromiter((xxhash.xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, n)


def fingerprint(text: str, words: int = 4) -> int:
    """Bit i is set if it is set in over half of the shingle hashes; 0 without words."""
    h = shingle_hashes(text, words)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[a : a + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carried string columns, fp) with fp the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", *carry)], pa.array(fp.view(np.int64))], ["doc_id", *carry, "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), *carry, text_or_empty().alias("text"))
    return rows.mapInArrow(run, ", ".join(["doc_id long", *[f"{c} string" for c in carry], "fp long"]))


def posting_sets(bytes_: int = 8, equal: int = 4, size: int = 3) -> list[tuple[int, ...]]:
    """Sets of size byte positions of which every choice of equal positions contains one.

    The positions are dealt to three circles of near equal size. A set is taken if it lies within a
    circle, or has two members in one and one in the next: Turan's system for sets of three.
    """
    if size != 3 or equal != 4:
        raise ValueError("only sets of three positions for four equal bytes are known here")
    ring = [i % 3 for i in range(bytes_)]
    out = []
    for s in combinations(range(bytes_), 3):
        c = sorted(ring[i] for i in s)
        if c[0] == c[2] or c in ([0, 0, 1], [1, 1, 2], [0, 2, 2]):
            out.append(s)
    return out


def spanning_links(values: np.ndarray, most: int = 4) -> list[tuple[int, int]]:
    """Pairs that join values (distinct) exactly as all pairs at most `most` bits apart would.

    A search from one value compares it only with those not reached yet, so a tight group of m values
    takes about m comparisons and yields m - 1 pairs.
    """
    out, left = [], np.asarray(values, np.uint64)
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            v = queue.pop()
            x = left ^ v
            equal = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)  # the tally of shared positional bytes
            near = equal >= 8 - most
            near[near] = np.bitwise_count(x[near]) <= most
            if near.any():
                got = left[near]
                out += [(int(v), int(g)) for g in got]
                queue += list(got)
                left = left[~near]
    return out


def _small_groups(keys: np.ndarray, values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys (sorted), by comparing each value with those 1, 2, ... after it."""
    out_a, out_b, gap = [], [], 1
    while gap < len(keys):
        same = np.nonzero(keys[gap:] == keys[:-gap])[0]
        if not len(same):
            break
        x = values[same] ^ values[same + gap]
        hit = same[((x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= 8 - most) & (np.bitwise_count(x) <= most)]
        out_a.append(values[hit])
        out_b.append(values[hit + gap])
        gap += 1
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (values[:0], values[:0])


def links(fps: DataFrame, most: int = 4, block: int = 4096, large: int = 64) -> DataFrame:
    """(u, v): enough pairs of distinct fingerprints at most `most` bits apart to join whatever is joined.

    Two fingerprints that differ in at most 4 bits share at least 4 of their 8 bytes. A posting list
    of one byte would hold a 256th of all fingerprints, so postings are of three byte positions: 20
    sets of three, of which any four positions contain one. Lists of one entry are dropped after a
    count; for the rest, shared bytes are tallied, pairs below 4 dropped, the others verified by
    their differing bits. Lists over `large` entries are searched without making all pairs; lists over
    `block` entries are cut into blocks, and each pair of blocks is a task's work.
    """
    spark = fps.sparkSession
    sets = posting_sets()

    def key(k: int, s: tuple[int, ...]):
        mask = sum(0xFF << (8 * (7 - i)) for i in s)
        mask -= (mask >> 63) << 64
        return F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(mask).cast("long")).alias("b"))

    postings = fps.select("fp", F.explode(F.array(*[key(k, s) for k, s in enumerate(sets)])).alias("p")).select(F.col("p.k").alias("k"), F.col("p.b").alias("b"), "fp")
    counts = postings.groupBy("k", "b").agg(F.count("*").alias("n")).where("n > 1")
    rows = postings.join(counts, ["k", "b"])
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.when(F.col("n") > block, F.pmod(F.xxhash64("fp"), blocks)).otherwise(F.lit(0)).cast("int")
    pairs = F.when(F.col("n") > block, F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("x"), F.greatest(o, F.col("own")).alias("y")))).otherwise(F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"))))
    rows = rows.withColumn("own", own).withColumn("z", F.explode(pairs)).select("k", "b", F.col("z.x").alias("x"), F.col("z.y").alias("y"), "fp")
    dealt = rows.select(F.xxhash64("k", "b", "x", "y").alias("key"), "fp")
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key")

    def solve(keys: np.ndarray, values: np.ndarray) -> pd.DataFrame:
        cuts = np.nonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))[0]
        sizes = np.diff(cuts)
        a, b = [], []
        for i in np.nonzero(sizes > large)[0]:
            found = spanning_links(np.unique(values[cuts[i] : cuts[i + 1]]), most)
            a += [np.array([x for x, _ in found], np.uint64)]
            b += [np.array([y for _, y in found], np.uint64)]
        small = np.repeat(sizes <= large, sizes)
        x, y = _small_groups(keys[small], values[small], most)
        u, v = np.concatenate([*a, x]).view(np.int64), np.concatenate([*b, y]).view(np.int64)
        return pd.DataFrame({"u": np.minimum(u, v), "v": np.maximum(u, v)}).drop_duplicates()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, values = np.empty(0, np.int64), np.empty(0, np.uint64)
        for pdf in batches:
            keys = np.concatenate([keys, pdf["key"].to_numpy()])
            values = np.concatenate([values, pdf["fp"].to_numpy().view(np.uint64)])
            if len(keys) and keys[0] != keys[-1]:
                cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
                yield solve(keys[:cut], values[:cut])
                keys, values = keys[cut:], values[cut:]
        if len(keys):
            yield solve(keys, values)

    return dealt.mapInPandas(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, words: int = 4, most: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for each row; component_id is the least doc_id reachable over links."""
    return components(docs, words, most).select("doc_id", "fp", "component_id")


def components(docs: DataFrame, words: int = 4, most: int = 4, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carried string columns, fp, component, component_id) for each row.

    component is the least fingerprint reachable over links and tells components apart whatever the
    ids; component_id is the least doc_id in it, null if it has none.

    Equal fingerprints are one node of the link graph, so copies are never paired. Documents without
    words, null ones included, have fingerprint 0 and are linked like any other. Repeated rows keep
    their number; an empty table gives an empty result; other columns are ignored.
    """
    own = durable(fingerprints(docs, words, carry))
    nodes = durable(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = connected_components(links(nodes.select("fp"), most))
    classes = nodes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = classes.join(lowest, "component").select("fp", "component", "component_id")
    return own.join(by_fp, "fp").select("doc_id", *carry, "fp", "component", "component_id")


def op10_simhash_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
