"""Byte-level BPE: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest."""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subspan.llm.common import Recent, kept_while_busy, slices, table, text_or_empty


@dataclass(frozen=True)
class PerfectHash:
    """Minimal perfect hash by displacement: a key's bucket holds the seed that sends it to its slot.

    A key is hashed once; its bucket, and its slot for a seed, are arithmetic on that hash. Slots
    number the keys without gaps. A bucket of one key holds its slot itself, as -1 - slot. Foreign
    keys also land in some slot, so the key kept there is compared.
    """

    seeds: list[int]
    keys: list[bytes]
    values: list[int]

    @classmethod
    def build(cls, items: dict[bytes, int], per_bucket: int = 2) -> PerfectHash:
        n = len(items)
        buckets: list[list[bytes]] = [[] for _ in range(max(1, -(-n // per_bucket)))]
        for key in items:
            buckets[xxhash.xxh64_intdigest(key) % len(buckets)].append(key)
        seeds, slots = [0] * len(buckets), [b""] * n
        taken = bytearray(n)
        for b in sorted(range(len(buckets)), key=lambda b: -len(buckets[b])):
            if len(buckets[b]) < 2:
                break
            hashes, seed = [xxhash.xxh64_intdigest(k) for k in buckets[b]], 1
            while True:
                at = [(h * seed >> 32) % n for h in hashes]
                if len(set(at)) == len(at) and not any(taken[i] for i in at):
                    break
                seed += 1
            seeds[b] = seed
            for i, k in zip(at, buckets[b], strict=True):
                taken[i], slots[i] = 1, k
        free = (i for i in range(n) if not taken[i])
        for b, keys in enumerate(buckets):
            if len(keys) == 1:
                slot = next(free)
                seeds[b], slots[slot] = -1 - slot, keys[0]
        return cls(seeds, slots, [items[k] for k in slots])

    def get(self, key: bytes) -> int:
        """The key's value, or -1."""
        keys = self.keys
        if not keys:
            return -1
        h = xxhash.xxh64_intdigest(key)
        seed = self.seeds[h % len(self.seeds)]
        slot = -1 - seed if seed < 0 else (h * seed >> 32) % len(keys)
        return self.values[slot] if keys[slot] == key else -1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_bytes(piece: bytes, rank_of: Callable[[bytes], int]) -> list[int]:
    """The ranks of one pre-token's parts: the lowest-ranked adjacent pair, leftmost first, is merged until none has a rank (-1).

    Parts are a doubly linked list over byte positions; a heap holds rank, position and end of each
    pair, packed in one number. An entry whose pair has changed since is skipped, so a piece of n
    bytes takes O(n log n). Every single byte has a rank.
    """
    n = len(piece)
    wide = n.bit_length()
    low, far_left = (1 << wide) - 1, 2 * wide
    end = list(range(1, n + 1))  # where the part that starts here ends; 0 once it is merged away
    prev = list(range(-1, n - 1))
    own = [-1] * n  # the rank of the part that starts here, once it is more than a byte
    heap = [(r << wide | i) << wide | i + 2 for i in prev[1:] if (r := rank_of(piece[i : i + 2])) >= 0]
    heapify(heap)
    while heap:
        entry = heappop(heap)
        stop, i = entry & low, entry >> wide & low
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue
        end[i], end[j], own[i] = stop, 0, entry >> far_left
        if stop < n:
            prev[stop] = i
            far = end[stop]
            if (r := rank_of(piece[i:far])) >= 0:
                heappush(heap, (r << wide | i) << wide | far)
        h = prev[i]
        if h >= 0 and (r := rank_of(piece[h:stop])) >= 0:
            heappush(heap, (r << wide | h) << wide | stop)
    return [own[i] if own[i] >= 0 else rank_of(piece[i : i + 1]) for i in range(n) if end[i]]


class Ranks(Recent):
    """Ranks of parts, -1 where there is none, as the perfect hash gives them; a bounded cache, as merging asks for few parts again and again."""

    def __init__(self, lookup: PerfectHash, room: int = 30_000):
        super().__init__(room, longest=16)
        self.make = lookup.get


class Codec(Recent):
    """Maps a pre-token to its ids as 32-bit bytes in the machine's order, little-endian; a bounded cache over both tiers.

    A pre-token that the cache lacks is looked up whole in the perfect hash, and merged from bytes
    if it is no vocabulary entry. The perfect hash is the only copy of the vocabulary.
    """

    def __init__(self, lookup: PerfectHash, pattern: str, room: int = 200_000):
        super().__init__(room)
        self.lookup, self.ranks = lookup, Ranks(lookup)
        self.split = regex.compile(pattern).findall
        self.bytes_of = [b""] * (max(lookup.values, default=-1) + 1)
        for key, value in zip(lookup.keys, lookup.values, strict=True):
            self.bytes_of[value] = key

    def make(self, piece: str) -> bytes:
        raw = piece.encode()
        rank = self.lookup.get(raw)
        return rank.to_bytes(4, "little") if rank >= 0 else array("I", merge_bytes(raw, self.ranks.__getitem__)).tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row, and the token ids where ids is set.

    The driver reads the ranks (a fixed vocabulary of some megabytes) and broadcasts the perfect
    hash. Each match of pattern is encoded on its own; no special token is known. A Python worker
    holds the vocabulary once and at most 400,000 short pre-tokens, and drops both when no task has
    come for ten seconds. ids_sha256 is over
    little-endian unsigned 32-bit ids, decoded_sha256 over the bytes that decoding gives back.
    Null and empty texts have no tokens; rows are independent, so repeated rows give repeated
    results; other columns are ignored.
    """
    spark = docs.sparkSession
    table_ = PerfectHash.build(read_ranks(ranks_path))
    shared = spark.sparkContext.broadcast((table_.seeds, table_.keys, table_.values))
    version = (hashlib.sha256(repr(table_.keys).encode()).hexdigest(), pattern)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with kept_while_busy("codec", version, lambda: Codec(PerfectHash(*shared.value), pattern)) as codec:
            for batch in slices(batches):
                rows = [codec.encode(t) for t in batch.column("text").to_pylist()]
                out = [batch.column("doc_id"), pa.array([len(r) // 4 for r in rows], pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in rows]), pa.array([hashlib.sha256(codec.decode(r)).hexdigest() for r in rows])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    out.append(pa.array([np.frombuffer(r, dtype="<u4").astype("int64") for r in rows], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(out, names + ["ids"] * ids)

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, schema)


def public_vocabulary() -> tuple[str, str]:
    """Path of the default rank file and the pattern that goes with it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), *public_vocabulary())
