"""Which elements several sets hold, and overlaps of given pairs: what set joins shuffle, packed (JOI-14)."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.operators.similarity import shared_dir

#: Elements that are dealt at a time; pairs that one group compares.
STEP, PAIRS = 2_000_000, 20_000
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """Cuts lineage through Parquet in the shared folder; the shuffle files that made it go at once, not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    path, before = f"{shared_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}", spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over 64 bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _unmixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))) * np.uint64(0x319642B2D24D8EC3)
    x = (x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))) * np.uint64(0x96DE1B173F119089)
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(x.astype("<i4").tobytes(), codec="zstd", asbytes=True)


def _unpacked(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(x, decompressed_size=4 * n, codec="zstd", asbytes=True), "<i4") if n else np.zeros(0, "<i4")


def shared_elements(sets: DataFrame, kind: str, threshold: float) -> DataFrame:
    """(_id, _n, _c, _d, _s) from (_id, _s: different longs): sets by the elements that another set holds too, if these are ``threshold n`` at least.

    _n is the size of the whole set, (_c, _d) its 128-bit hash. _s begins with
    the elements that the fewest sets hold. Most elements of texts are held by
    one text alone, so what is shuffled for them counts: seven bytes and the
    packed place of the set in its batch. The group of a first byte knows which
    of its elements come again; these alone go back to their batch.
    """
    arrow = to_arrow_type(sets.schema["_id"].dataType)
    dealt = pa.schema([("_b", pa.int32()), ("_u", pa.int64()), ("_m", pa.int32()), ("_e", pa.binary()), ("_at", pa.binary()), ("_ids", pa.list_(arrow)), ("_sizes", pa.list_(pa.int32())), ("_cs", pa.list_(pa.int64())), ("_ds", pa.list_(pa.int64()))])
    dealt_sql = f"_b int, _u bigint, _m int, _e binary, _at binary, _ids array<{kind}>, _sizes array<int>, _cs array<bigint>, _ds array<bigint>"

    def part(ids: pa.Array, size: np.ndarray, e: np.ndarray) -> pa.RecordBatch:
        x = _mixed(e.view("<u8"))
        starts = np.cumsum(size) - size
        c, d = np.add.reduceat(_mixed(x + np.uint64(1)), starts), np.add.reduceat(_mixed(x ^ np.uint64(0x9E3779B97F4A7C15)), starts)
        u = int.from_bytes(hashlib.blake2b(repr(ids.to_pylist()).encode() + c.tobytes(), digest_size=8).digest(), "little", signed=True)
        row, bucket = np.repeat(np.arange(len(size)), size), (x >> np.uint64(56)).astype(np.uint8)
        order = np.argsort(bucket, kind="stable")  # sets stay in order: their places are steps, mostly small
        low, row, ends = x[order].view(np.uint8).reshape(-1, 8)[:, :7], row[order], np.searchsorted(bucket[order], np.arange(257))
        here = [(b, ends[b], ends[b + 1]) for b in range(256) if ends[b] < ends[b + 1]]
        none = [None] * len(here)
        columns = [
            [*(b for b, _, _ in here), u % 256], [u] * (len(here) + 1), [*(hi - lo for _, lo, hi in here), 0],
            [*(low[lo:hi].tobytes() for _, lo, hi in here), b""], [*(_packed(np.diff(row[lo:hi], prepend=0)) for _, lo, hi in here), b""],
            [*none, ids.to_pylist()], [*none, size.tolist()], [*none, c.view("<i8").tolist()], [*none, d.view("<i8").tolist()],
        ]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, dealt)], schema=dealt)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            x = x.filter(pc.and_(x.column(0).is_valid(), pc.fill_null(pc.greater(pc.list_value_length(x.column(1)), 0), False)))
            at = 0
            ends = np.cumsum(x.column(1).value_lengths().to_numpy())
            while at < len(x):
                done = ends[at - 1] if at else 0
                many = max(1, int(np.searchsorted(ends[at:], done + STEP, side="right")))
                y = x.slice(at, many)
                yield part(y.column(0), y.column(1).value_lengths().to_numpy().astype("int64"), y.column(1).flatten().to_numpy())
                at += many

    def again(t: pa.Table) -> pa.Table:
        heads = t.filter(pc.is_valid(t["_ids"]))
        rows = t.filter(pc.is_null(t["_ids"]))
        b, units, m = t["_b"][0].as_py(), rows["_u"].to_pylist(), rows["_m"].to_numpy()
        total = int(m.sum())
        x = np.zeros((total, 8), np.uint8)
        x[:, 7], done = b, 0
        for e, n in zip(rows["_e"], m):
            x[done : done + n, :7] = np.frombuffer(e.as_buffer(), np.uint8).reshape(n, 7)
            done += n
        _, which, times = np.unique(x.reshape(-1).view("<u8"), return_inverse=True, return_counts=True)
        often, out, done = times[which], [], 0
        for u, n, at in zip(units, m, rows["_at"]):
            held = often[done : done + n] > 1
            if held.any():
                out.append((b, u, int(held.sum()), x[done : done + n][held].tobytes(), np.stack([np.cumsum(_unpacked(at.as_py(), n))[held], often[done : done + n][held]]).astype("<i4").tobytes()))
            done += n
        found = pa.Table.from_arrays([*(pa.array([r[k] for r in out], dealt.field(k).type) for k in range(5)), *(pa.nulls(len(out), dealt.field(k).type) for k in range(5, 9))], schema=dealt)
        return pa.concat_tables([found, heads.cast(dealt)])

    def gather(t: pa.Table) -> pa.Table:
        head, rows = t.filter(pc.is_valid(t["_ids"])), t.filter(pc.is_null(t["_ids"]))
        if len(head) != 1:
            raise RuntimeError("a batch of sets was read in another order when it was read again")
        ids, size, c, d = (head[x].combine_chunks().flatten() for x in ("_ids", "_sizes", "_cs", "_ds"))
        m = rows["_m"].to_numpy()
        e = _unmixed(np.concatenate([np.frombuffer(x.as_buffer(), "<u8") for x in rows["_e"]] or [np.zeros(0, "<u8")])).view("<i8")
        places = [np.frombuffer(x.as_buffer(), "<i4").reshape(2, n) for x, n in zip(rows["_at"], m)]
        row, often = np.concatenate(places, axis=1) if places else np.zeros((2, 0), "<i4")
        order = np.lexsort((e, often, row))
        left, n = np.bincount(row, minlength=len(ids)), size.to_numpy()
        keep = (left > 0) & (left >= np.ceil(threshold * n - 1e-9))
        e = e[order][keep[row[order]]]
        ends, at = np.append(0, np.cumsum(left[keep])).astype("int32"), pa.array(np.flatnonzero(keep))
        return pa.Table.from_arrays([ids.take(at), size.take(at), c.take(at), d.take(at), pa.ListArray.from_arrays(pa.array(ends), pa.array(e))], names=["_id", "_n", "_c", "_d", "_s"])

    x = sets.select("_id", "_s").mapInArrow(deal, dealt_sql).groupBy("_b").applyInArrow(again, dealt_sql)
    return stored(x.groupBy("_u").applyInArrow(gather, f"_id {kind}, _n int, _c bigint, _d bigint, _s array<bigint>"))


def overlaps(near: DataFrame, sets: DataFrame, kind: str, threshold: float) -> DataFrame:
    """(left, right, similarity) of the pairs (left, right) with Jaccard similarity of ``threshold`` or more, from (_id, _n, _s).

    Pairs are compared where the least neighbour of their left set lies, so of
    sets that are all alike each is sent once, not once a pair; a place with
    many pairs is cut by left sets.
    """
    near = stored(near)
    ends = near.unionByName(near.select(F.col("right").alias("left"), F.col("left").alias("right")))
    least = ends.groupBy("left").agg(F.min("right").alias("_g")).select("left", F.least("left", "_g").alias("_g"))
    pairs = near.join(least, "left")
    cut = pairs.groupBy("_g").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("_parts"))
    pairs = stored(pairs.join(cut, "_g").select("_g", F.pmod(F.xxhash64("left"), "_parts").cast("int").alias("_q"), "left", "right"))
    held = pairs.select("_g", "_q", F.explode(F.array("left", "right")).alias("_id")).distinct().join(sets.select("_id", "_n", "_s"), "_id").select("_g", "_q", "_id", "_n", "_s")
    held = held.toDF(*held.columns)  # columns of its own

    def run(p: pa.Table, x: pa.Table) -> pa.Table:
        place, n = {i: k for k, i in enumerate(x["_id"].to_pylist())}, x["_n"].to_numpy()
        lists = x["_s"].combine_chunks()
        stops = np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
        e = lists.flatten().to_numpy()
        of = [np.sort(e[lo:hi]) for lo, hi in zip(stops, stops[1:])]
        a, b = ([place[i] for i in p[c].to_pylist()] for c in ("left", "right"))
        k = np.array([len(np.intersect1d(of[i], of[j], assume_unique=True)) for i, j in zip(a, b)], float)
        s = k / (n[a] + n[b] - k)
        found = pa.array(np.flatnonzero(s >= threshold))
        return pa.table([p["left"].take(found), p["right"].take(found), pa.array(s).take(found)], names=["left", "right", "similarity"])

    return pairs.groupBy("_g", "_q").cogroup(held.groupBy("_g", "_q")).applyInArrow(run, f"left {kind}, right {kind}, similarity double")
