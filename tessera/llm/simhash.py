"""SimHash near-duplicates found through pivot distance tables.

Every distinct fingerprint gets a table of Hamming distances to reference
fingerprints (pivots). Two kinds are used. Unit pivots (zero and the 64 single
bits) give keys: a pair within r bits must agree on all unit coordinates of
one of r+1 bands, so candidates meet in a bucket per band, and a bucket with
too many members is split again by bands of its remaining coordinates, again
without losing a pair. Random pivots discard pairs within a bucket: by the
triangle inequality a pair within r bits differs by r at most in every
coordinate. Survivors are verified on the fingerprints themselves.

A bucket gives a spanning forest of its links, not all pairs, so no link
between different texts is lost and copies are never expanded. Buckets that
stay large are dealt out as pairs of tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near_copies
from . import textops as tx
from .cluster import checkpoint, components, hook

U64 = np.uint64
SHINGLE, DISTANCE, SEED, PIVOTS, CROWD, TILE = 3, 3, 42, 16, 4096, 8192
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BITS = U64(1) << np.arange(64, dtype=U64)


def text_fingerprints(col: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit SimHash of each text: words with A-Z lower-cased, shingles with repeats, XXH64 (seed 42)."""
    buf, offs = tx.string_buffers(col)
    out = np.zeros(len(col), U64)
    digest = xxhash.xxh64_intdigest
    for lo, hi in tx.doc_runs(offs, 1 << 20):
        raw = _LOWER[buf[offs[lo] : offs[hi]]].tobytes()
        at = (offs[lo : hi + 1] - offs[lo]).tolist()
        hashes: list[int] = []
        sizes = []
        for i in range(hi - lo):
            words = raw[at[i] : at[i + 1]].split()
            if len(words) <= shingle:
                if words:
                    hashes.append(digest(b" ".join(words), SEED))
                sizes.append(1 if words else 0)
                continue
            own = b" ".join(words)
            end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            start = end[: -shingle] if shingle > 1 else end[:-1]
            begin = [0, *start.tolist()]
            stop = (end[shingle - 1 :] - 1).tolist()
            hashes += [digest(own[s:e], SEED) for s, e in zip(begin, stop)]
            sizes.append(len(stop))
        n = np.array(sizes)
        some = np.flatnonzero(n)
        if len(some):
            bits = np.unpackbits(np.array(hashes, U64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums = np.add.reduceat(bits, (np.cumsum(n) - n)[some], axis=0, dtype=np.int32)
            out[lo + some] = ((sums * 2 > n[some, None]) * _BITS).sum(axis=1, dtype=U64)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp long): the fingerprint of every text; null and empty texts get zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(text_fingerprints(b.column(1), shingle).view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t")).mapInArrow(tx.tidied(run), "id long, fp long")


def pivot_table(fp: np.ndarray, pivots: int) -> np.ndarray:
    """Row p: Hamming distances of all fingerprints to reference fingerprint p."""
    refs = np.random.default_rng(7).integers(0, 2**64, pivots, dtype=U64, endpoint=False)
    return np.stack([np.bitwise_count(fp ^ r).astype(np.int8) for r in refs])


def bucket_links(bucket: np.ndarray, fp: np.ndarray, distance: int, pivots: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links within buckets (rows of equal bucket number)."""
    table = pivot_table(fp, pivots)
    order = np.lexsort((table[0], bucket))
    bucket, fp, table = bucket[order], fp[order], table[:, order]
    root = np.arange(len(fp))
    i, step = np.arange(len(fp) - 1), 1
    while len(i):
        i = i[i + step < len(fp)]
        j = i + step
        near = (bucket[i] == bucket[j]) & (table[0][j] - table[0][i] <= distance)
        i = i[near]  # sorted by the first pivot: who is out of reach stays so
        a, b = i, i + step
        for row in table[1:]:
            ok = np.abs(row[a] - row[b]) <= distance
            a, b = a[ok], b[ok]
            if not len(a):
                break
        if len(a):
            ok = np.bitwise_count(fp[a] ^ fp[b]) <= distance
            hook(root, a[ok], b[ok])
        step += 1
    rest = np.flatnonzero(root != np.arange(len(fp)))
    return fp[root[rest]], fp[rest]


def links(fps: DataFrame, distance: int = DISTANCE, pivots: int = PIVOTS, crowd: int = CROWD, tile: int = TILE) -> DataFrame:
    """(a, b): a forest that joins all distinct fingerprints (column fp) within ``distance`` bits.

    distance: 0 to 7. Within a bucket over ``crowd`` members, keys get as many
    further bands; what still holds over ``tile`` members is cut into tiles.
    """
    bands = distance + 1
    width = 64 // bands
    field = lambda x, at, n: F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << n) - 1).cast("long"))
    one = F.col("fp")
    size = [width if i < bands - 1 else 64 - width * (bands - 1) for i in range(bands)]
    parts = [F.struct(F.lit(i).alias("band"), field(one, i * width, size[i]).alias("key")) if bands > 1 else F.struct(F.lit(0).alias("band"), one.alias("key")) for i in range(bands)]
    keyed = fps.select("fp", F.explode(F.array(*parts)).alias("k")).select("fp", "k.band", "k.key")
    crowded = keyed.groupBy("band", "key").agg(F.count("*").alias("_n")).filter(F.col("_n") > crowd).select("band", "key", F.lit(True).alias("_hot"))
    keyed = keyed.join(crowded, ["band", "key"], "left")
    # Further bands of a crowded bucket: among the bits outside its band, r+1 groups of which one must agree.
    finer = []
    for i in range(bands):
        outside = [p for p in range(64) if not i * width <= p < i * width + size[i]]
        groups = [outside[g * len(outside) // bands : (g + 1) * len(outside) // bands] for g in range(bands)]
        finer.append(F.array(*[F.struct(F.lit(g).alias("sub"), one.bitwiseAND(F.lit(sum(1 << p for p in bits) - (1 << 64) * (63 in bits)).cast("long")).alias("subkey")) for g, bits in enumerate(groups)]))
    pick = finer[-1]
    for i in range(bands - 1):
        pick = F.when(F.col("band") == i, finer[i]).otherwise(pick)
    plain = F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("subkey")))
    cell = keyed.select("fp", "band", "key", F.explode(F.when(F.col("_hot"), pick).otherwise(plain)).alias("s")).select("fp", F.xxhash64("band", "key", "s.sub", "s.subkey").alias("cell"))
    big = cell.groupBy("cell").agg(F.count("*").alias("_n")).filter(F.col("_n") > tile).select("cell", F.ceil(F.col("_n") / tile).cast("int").alias("_g"))
    cell = cell.join(big, "cell", "left").withColumn("_g", F.coalesce("_g", F.lit(1)))
    own = F.pmod(F.xxhash64(one, F.lit(1)), F.col("_g")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("_g") - 1), lambda t: F.struct(F.least(t, own).alias("x"), F.greatest(t, own).alias("y")))
    tiles = cell.select("fp", "cell", F.explode(pairs).alias("p")).select(F.xxhash64("cell", "p.x", "p.y").alias("bucket"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def solve(t: pa.Table) -> pa.RecordBatch:
            a, b = bucket_links(t["bucket"].to_numpy(), t["fp"].to_numpy().view(U64), distance, pivots)
            return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows < 200_000:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            at = t["bucket"].to_numpy()
            cut = int(np.searchsorted(at, at[-1]))
            if cut:
                yield solve(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                rows = len(t) - cut
        if rows:
            yield solve(pa.Table.from_batches(held).combine_chunks())

    return tiles.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tx.tidied(run), "a long, b long")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(id, fp, component_id): for each row the least id that links of ``distance`` bits reach.

    Texts without words have fingerprint zero and link like any other. Null
    ids take part in links but are no component's id unless nothing else is
    there. Ids are integers; texts of any length are read whole. Repeated rows
    give repeated results, an empty table an empty one. Other columns are left
    out.
    """
    each = checkpoint(fingerprints(docs, id_col, text_col, shingle))
    nodes = each.groupBy("fp").agg(F.min("id").alias("least"))
    found = components(links(nodes.select("fp"), distance))
    rooted = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    best = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return each.join(rooted.join(best, "root").select("fp", "component_id"), "fp").select("id", "fp", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keeps one row of each group of near copies: SimHash over five-word shingles with pivot tables, links verified at a Jaccard similarity of 0.8 (``near_copies``)."""
    return near_copies.near_dedup(docs, id_col, text_col)
