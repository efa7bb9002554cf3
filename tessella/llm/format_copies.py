"""Duplicates hidden by formatting differences.

Every record is reduced to a canonical text. Each partition builds a Bloom
filter of the hashes it has seen once and one of those it has seen again; the
filters are merged shard by shard (once AND once counts as again), and only
records that the merged filter calls possible repeats are shuffled for exact
grouping by canonical text. All others are proven singletons and are emitted
where they are.

The merged filter grows with the records, so it is used in blocks of shards that
fit a broadcast: the canonical texts are written once, in one folder per block,
without a shuffle, and each block's records meet only that block's filter. One
block and many blocks run the same steps.

Defined cases: a null payload is never a copy; a payload that is no JSON object
is compared as literal text; a null field equals only null; an empty table gives
empty results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.plans.cut import Scratch, exists
from tessella.plans.shared import Shared
from tessella.plans.spread import spread_join

#: Filter bits per record, probes per record, bits of one shard.
BITS_PER_ROW, PROBES, SHARD_BITS = 16, 4, 1 << 20
#: The merged filter is broadcast in blocks of at most this size.
BROADCAST_BYTES = 64 << 20
#: A partition sends the bits of a shard only where they take fewer bytes than its hashes would.
DENSE = SHARD_BITS // 8 // 8


def canonical_text(x: Column) -> Column:
    """Without white space, letter case and punctuation; a point or comma between two digits stays."""
    x = F.regexp_replace(F.lower(x), "ß", "ss")
    x = F.regexp_replace(x, r"(?U)[\s\u200B\uFEFF]+", " ")
    x = F.regexp_replace(x, r"(?<=\d)，(?=\d)", ",")
    x = F.regexp_replace(x, r"(?<!\d)[.,]|[.,](?!\d)|[\p{P}`´^~|&&[^.,]]", "")
    return F.regexp_replace(x, " ", "")


def canonical_payload(payload: Column, loose: list[str]) -> Column:
    """One text per JSON object, whatever its field order and spelling; ``loose`` fields by canonical_text."""
    entries = F.array_sort(F.map_entries(F.from_json(payload, "map<string,string>")))
    value = lambda e: F.when(e["key"].isin(loose), canonical_text(e["value"])).otherwise(e["value"])
    parts = F.transform(entries, lambda e: F.concat(e["key"], F.lit("\x02"), F.coalesce(value(e), F.lit("\x03"))))
    return F.coalesce(F.concat(F.lit("\x01"), F.array_join(parts, "\x01")), payload)


def _probe(h: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and PROBES bit positions of each hash, by double hashing."""
    h = h.astype(np.uint64)
    shard = (h >> np.uint64(44)) % np.uint64(shards)
    a, b = h & np.uint64(0xFFFFFFFF), ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) | np.uint64(1)
    at = (a[:, None] + np.arange(PROBES, dtype=np.uint64) * b[:, None]) % np.uint64(SHARD_BITS)
    return shard.astype(np.int64), at.astype(np.int64)


def _pack(h: np.ndarray, at: np.ndarray) -> bytes:
    """A shard's part of one partition: the hashes themselves if they are few, else bits."""
    if len(h) <= DENSE:
        return b"h" + h.astype(np.int64).tobytes()
    bits = np.zeros(SHARD_BITS, np.bool_)
    bits[at.ravel()] = True
    return b"b" + zlib.compress(np.packbits(bits).tobytes(), 1)


def _unpack(b: bytes, shards: int) -> np.ndarray:
    if b[:1] == b"b":
        return np.unpackbits(np.frombuffer(zlib.decompress(b[1:]), np.uint8)).view(np.bool_)
    bits = np.zeros(SHARD_BITS, np.bool_)
    bits[_probe(np.frombuffer(b, np.int64, offset=1), shards)[1].ravel()] = True
    return bits


def _filters(shards: int):
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [p["h"].to_numpy() for p in batches]
        if not got:
            return
        h, n = np.unique(np.concatenate(got), return_counts=True)
        shard, at = _probe(h, shards)
        order = np.argsort(shard, kind="stable")
        h, shard, at, n = h[order], shard[order], at[order], n[order]
        starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else []
        for s, e in zip(starts, [*starts[1:], len(shard)]):
            more = n[s:e] > 1
            yield pd.DataFrame({"shard": [int(shard[s])], "once": [_pack(h[s:e], at[s:e])], "again": [_pack(h[s:e][more], at[s:e][more])]})

    return build


def _merge(shards: int):
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        once, again = np.zeros(SHARD_BITS, np.bool_), np.zeros(SHARD_BITS, np.bool_)
        for o, a in zip(pdf["once"], pdf["again"]):
            o = _unpack(o, shards)
            again |= once & o
            if len(a) > 1:
                again |= _unpack(a, shards)
            once |= o
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "again": [zlib.compress(np.packbits(again).tobytes(), 1)]})

    return merge


def _hits(h: np.ndarray, shards: int, again: dict[int, bytes]) -> np.ndarray:
    shard, at = _probe(h, shards)
    out = np.zeros(len(h), np.bool_)
    for s in np.unique(shard):
        if int(s) in again:
            of = np.flatnonzero(shard == s)
            bits = np.unpackbits(np.frombuffer(zlib.decompress(again[int(s)]), np.uint8))
            out[of] = bits[at[of]].all(axis=1)
    return out


def _marked(part: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """part with ``hit``: the filter of its block, at most BROADCAST_BYTES, calls the record a possible repeat."""
    merged = Shared(part.sparkSession, {r["shard"]: bytes(r["again"]) for r in filters.collect()})

    @F.pandas_udf("boolean")
    def hit(h: pd.Series) -> pd.Series:
        return pd.Series(_hits(h.to_numpy(), shards, merged.value))

    return part.withColumn("hit", hit("h"))


def possible_repeats(df: DataFrame, rows: int, scratch: Scratch, broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """Parts df (raw_id, canon) of about so many rows into possible repeats and proven singletons, both (raw_id, canon, h), written."""
    shards = max(1, -(-rows * BITS_PER_ROW // SHARD_BITS))
    per_block = max(1, broadcast_bytes // (SHARD_BITS // 8))
    blocks = -(-shards // per_block)
    shard_of = F.pmod(F.shiftrightunsigned("h", 44), F.lit(shards))
    df = df.select("raw_id", "canon", F.xxhash64("canon").alias("h"))
    read = df.sparkSession.read.schema(df.schema).parquet
    whole = scratch.path()
    (df.withColumn("block", F.floor(shard_of / per_block).cast("int")).write.partitionBy("block") if blocks > 1 else df.write).parquet(whole)
    filters = scratch.keep(read(whole).select("h").mapInPandas(_filters(shards), "shard int, once binary, again binary").groupBy("shard").applyInPandas(_merge(shards), "shard int, again binary"))
    if blocks == 1:
        marked = scratch.keep(_marked(read(whole), filters, shards))
    else:
        marked = []
        for k in range(blocks):
            if not exists(df.sparkSession, f"{whole}/block={k}"):
                continue
            mine = filters.filter((F.col("shard") >= k * per_block) & (F.col("shard") < (k + 1) * per_block))
            marked.append(scratch.keep(_marked(read(f"{whole}/block={k}"), mine, shards)))
        marked = reduce(DataFrame.union, marked) if marked else df.limit(0).withColumn("hit", F.lit(False))
    scratch.delete(whole)
    return marked.filter("hit").drop("hit"), marked.filter("not hit").drop("hit")


def _parted(raw: DataFrame, loose: list[str] | None, broadcast_bytes: int) -> tuple[DataFrame, DataFrame]:
    """possible_repeats of the payloads, which are parsed once."""
    got = raw.filter("payload is not null").select("raw_id", canonical_payload(F.col("payload"), loose or ["question", "answer"]).alias("canon"))
    return possible_repeats(got, raw.count(), Scratch(raw.sparkSession, "copies"), broadcast_bytes)


def found(raw: DataFrame, loose: list[str] | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(raw_id_a, raw_id_b): every further copy beside the smallest raw_id of its record."""
    maybe, _ = _parted(raw, loose, broadcast_bytes)
    groups = maybe.groupBy("h", "canon").agg(F.min("raw_id").alias("raw_id_a"), F.count("*").alias("n")).filter("n > 1")
    got = spread_join(maybe, groups, ["h", "canon"], "n", F.col("raw_id"), ["raw_id_a"])
    return got.filter("raw_id <> raw_id_a").select("raw_id_a", F.col("raw_id").alias("raw_id_b"))


def collapsed(raw: DataFrame, loose: list[str] | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(raw_id, copies): one row per record, by its smallest raw_id, with its number of copies."""
    maybe, single = _parted(raw, loose, broadcast_bytes)
    groups = maybe.groupBy("h", "canon").agg(F.min("raw_id").alias("raw_id"), F.count("*").alias("copies")).select("raw_id", "copies")
    one = F.lit(1).cast("bigint").alias("copies")
    return groups.union(single.select("raw_id", one)).union(raw.filter("payload is null").select("raw_id", one))
