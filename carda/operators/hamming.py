"""Nearest neighbour by Hamming distance within a radius, exact, by block probing instead of comparing all pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carda.functions.text import hamming64
from carda.session import cut, ship_package, sized_broadcast

BLOCKS, WIDTH = 4, 16


def _masks(flips: int, width: int = WIDTH) -> list[int]:
    """All masks of ``width`` bits with at most ``flips`` bits set."""
    out = [0]
    for k in range(1, flips + 1):
        out += [sum(1 << b for b in bits) for bits in combinations(range(width), k)]
    return out


def _block(c, i: int):
    return F.shiftrightunsigned(c, WIDTH * i).bitwiseAND(0xFFFF).cast("int")


#: Distinct base fingerprints up to which their blocks are broadcast; beyond it both sides are shuffled by block.
BROADCAST_FINGERPRINTS = 200_000


def _close(probe: DataFrame, base: DataFrame, radius: int) -> DataFrame:
    """(simhash, other) of all distinct fingerprints within ``radius``."""
    if not 0 <= radius <= 11:
        raise ValueError("radius must be between 0 and 11")
    p = probe.where("simhash is not null").select("simhash").distinct()
    b = base.where("simhash is not null").select(F.col("simhash").alias("other")).distinct()
    masks = F.array(*[F.lit(m) for m in _masks(radius // BLOCKS)])
    blocks = lambda c: F.array(*[F.struct(F.lit(i).alias("i"), _block(c, i).alias("v")) for i in range(BLOCKS)])
    pk = p.select("simhash", F.explode(blocks(F.col("simhash"))).alias("k")).select("simhash", F.col("k.i").alias("i"), F.explode(F.transform(masks, lambda m: F.col("k.v").bitwiseXOR(m))).alias("v"))
    bk = sized_broadcast(b.select("other", F.explode(blocks(F.col("other"))).alias("k")).select("other", "k.i", "k.v"), b.count(), BROADCAST_FINGERPRINTS)
    return pk.join(bk, ["i", "v"]).where(hamming64(F.col("simhash"), F.col("other")) <= radius).select("simhash", "other").distinct()


def neighbor_pairs(probe: DataFrame, base: DataFrame, radius: int = 8) -> DataFrame:
    """(id, base_id, dist) of all pairs within ``radius`` (at most 11). Columns id and simhash on both sides.

    Within distance r one of four 16-bit blocks differs in at most r // 4 bits, so probing each block's neighbourhood
    finds every pair. Equal fingerprints are collapsed first: a fingerprint many rows share probes once.
    """
    close = _close(probe, base, radius)
    ids = probe.select("id", "simhash").join(close, "simhash")
    out = ids.join(base.select(F.col("id").alias("base_id"), F.col("simhash").alias("other")), "other")
    return out.select("id", "base_id", hamming64(F.col("simhash"), F.col("other")).cast("int").alias("dist"))


#: (lowest bit, width) of the three chunks the search for the nearest probes. Wide chunks make short buckets.
CHUNKS = ((0, 22), (22, 21), (43, 21))
#: Pairs up to which the chunks are not cut further; base fingerprints a part holds and probes it takes at a time, about.
SMALL_PAIRS, PART_BASE, PART_PROBES = 100_000_000, 2_000_000, 500_000
#: Rows packed at a time, and candidates compared at a time.
PACK_ROWS, CANDIDATES = 100_000, 1_000_000
_NO_ID = np.iinfo(np.int64).min


def _radii(radius: int) -> list[int]:
    """Flips to try in each chunk: were every chunk to differ in more, the whole would differ in more than ``radius``.
    -1: the chunk is not needed."""
    q, more = divmod(radius + 1, len(CHUNKS))
    return [q - 1 + (i < more) for i in range(len(CHUNKS))]


def _bits(x: np.ndarray, low: int, width: int) -> np.ndarray:
    return ((x.view(np.uint64) >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)


def _apart(x: np.ndarray, y: np.ndarray | int) -> np.ndarray:
    return np.bitwise_count((x ^ y).view(np.uint64))


def _packer(side: int, radius: int, bits: int, pieces: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of longs, the fingerprint first, as (part, side, rows in bytes). A part is a chunk, a value of its upper
    ``bits`` and a piece of the probes. A base row (side 1) goes to its own value, a probe to all it may differ in."""
    radii = _radii(radius)

    def pack(rows: np.ndarray) -> pa.RecordBatch:
        parts, data = [], []
        for i, (low, width) in enumerate(CHUNKS):
            upper = _bits(np.ascontiguousarray(rows[:, 0]), low + width - bits, bits)
            for value in range(1 << bits) if radii[i] >= 0 else ():
                near = rows[_apart(upper, value) <= (0 if side else radii[i])]
                for j in range(pieces):
                    some = near if side else near[j::pieces]
                    if len(some):
                        parts.append(((i << bits) + value) * pieces + j)
                        data.append(some.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([side] * len(parts), pa.int32()), pa.array(data, pa.binary())], ["part", "side", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1))
            if sum(map(len, held)) >= PACK_ROWS:
                yield pack(np.concatenate(held))
                held = []
        if held:
            yield pack(np.concatenate(held))

    return run


def _candidates(first: np.ndarray, count: np.ndarray) -> Iterator[tuple[int, int]]:
    """Slices of probes that have about CANDIDATES candidates together."""
    ends = np.cumsum(count)
    at = 0
    while at < len(count):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CANDIDATES, "right")))
        yield at, to
        at = to


def _best(probes: np.ndarray, base: np.ndarray, radius: int, part: int, bits: int, exclude: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of ``probes``, id, distance) of the best base row of one part for each probe that has one within ``radius``.

    ``probes``: fingerprint, own id unless ``exclude`` is None. ``base``: fingerprint, lowest id, for "self" the next id.
    """
    i, value = part >> bits, part & ((1 << bits) - 1)
    low, width = CHUNKS[i]
    rest, reach = width - bits, _radii(radius)[i]
    base = base[np.argsort(_bits(np.ascontiguousarray(base[:, 0]), low, rest), kind="stable")]
    g, id1 = np.ascontiguousarray(base[:, 0]), np.ascontiguousarray(base[:, 1])
    start = np.zeros((1 << rest) + 1, np.int64)
    np.cumsum(np.bincount(_bits(g, low, rest), minlength=1 << rest), out=start[1:])
    f = np.ascontiguousarray(probes[:, 0])
    keys, away = _bits(f, low, rest), _apart(_bits(f, low + rest, bits), value)
    best_d, best_id = np.full(len(f), radius + 1, np.int64), np.full(len(f), np.iinfo(np.int64).max)
    for d in range(reach + 1):
        rows = np.flatnonzero(away == d)
        for mask in _masks(reach - d, rest) if len(rows) else ():
            k = keys[rows] ^ mask
            first, count = start[k], start[k + 1] - start[k]
            some = np.flatnonzero(count)
            at, first, count = rows[some], first[some], count[some]
            for lo, hi in _candidates(first, count):
                c = count[lo:hi]
                ends = np.cumsum(c)
                pos = np.arange(ends[-1]) + np.repeat(first[lo:hi] - ends + c, c)
                dist = _apart(np.repeat(f[at[lo:hi]], c), g[pos])
                hit = np.flatnonzero(dist <= radius)
                if not len(hit):
                    continue
                who, pos, dist = at[lo:hi][np.searchsorted(ends, hit, "right")], pos[hit], dist[hit].astype(np.int64)
                ids = id1[pos]
                keep = dist <= best_d[who]
                if exclude == "self":
                    ids = np.where(ids == probes[who, 1], base[pos, 2], ids)
                    keep &= ids != _NO_ID
                elif exclude == "later":
                    keep &= ids < probes[who, 1]
                who, ids, dist = who[keep], ids[keep], dist[keep]
                order = np.lexsort((ids, dist, who))
                who, ids, dist = who[order], ids[order], dist[order]
                top = np.flatnonzero(np.diff(who, prepend=-1))
                top = top[(dist[top] < best_d[who[top]]) | (ids[top] < best_id[who[top]])]
                best_d[who[top]], best_id[who[top]] = dist[top], ids[top]
    found = np.flatnonzero(best_d <= radius)
    return found, best_id[found], best_d[found]


def _searcher(radius: int, bits: int, pieces: int, exclude: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, base_id, dist) from packed rows; the key is the probe's id, or its fingerprint where nothing is excluded."""
    shapes = (1 if exclude is None else 2), (3 if exclude == "self" else 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        for b in batches:
            for part, side, data in zip(*(c.to_pylist() for c in b.columns)):
                held.setdefault(part, ([], []))[side].append(np.frombuffer(data, np.int64))
        for part, sides in held.items():
            if all(sides):
                probes, base = (np.concatenate(x).reshape(-1, n) for x, n in zip(sides, shapes))
                found, ids, dist = _best(probes, base, radius, part // pieces, bits, exclude)
                yield pa.RecordBatch.from_arrays([pa.array(probes[found, -1]), pa.array(ids), pa.array(dist.astype(np.int32))], ["key", "base_id", "dist"])

    return run


def _searched(probe: DataFrame, low: DataFrame, radius: int, exclude: str | None) -> DataFrame:
    """(id, base_id, dist) of the best of ``low`` (simhash, id1, id2) for each row of ``probe``; both are counted first."""
    units = probe.select("simhash").distinct() if exclude is None else probe.select("simhash", "id")
    base = low.select("simhash", "id1", *([F.coalesce("id2", F.lit(_NO_ID)).alias("id2")] if exclude == "self" else []))
    probes, rows = probe.count(), low.count()
    bits = 0 if probes * rows <= SMALL_PAIRS else max(4, ceil(log2(rows / PART_BASE)))
    pieces = min(32, 2 + probes // PART_PROBES)
    schema = "part int, side int, data binary"
    packs = units.mapInArrow(_packer(0, radius, bits, pieces), schema).unionByName(base.mapInArrow(_packer(1, radius, bits, pieces), schema))
    # one part a task: a part is few bytes and much work, so it must not be merged with others by size
    parts = packs.repartitionById((len(CHUNKS) << bits) * pieces, F.col("part"))
    found = parts.mapInArrow(_searcher(radius, bits, pieces, exclude), "key long, base_id long, dist int")
    found = found.groupBy("key").agg(F.min(F.struct("dist", "base_id")).alias("m")).select("key", "m.base_id", "m.dist")
    if exclude is None:
        return probe.select("id", F.col("simhash").alias("key")).join(found, "key").select("id", "base_id", "dist")
    return found.withColumnRenamed("key", "id")


def nearest(probe: DataFrame, base: DataFrame, radius: int = 8, exclude: str | None = None) -> DataFrame:
    """(id, best_id, dist): the closest base row within ``radius`` (at most 11), the lowest id among equals.

    ``exclude``: None keeps all, "self" drops the probe's own id, "later" keeps lower base ids only. Equal fingerprints
    are joined; what they leave open searches the distinct fingerprints in parts, each the rows that agree in the upper
    bits of a chunk. A part keeps only the best of each probe, so no pairs are written and copies are never paired.
    """
    if not 0 <= radius <= 11:
        raise ValueError("radius must be between 0 and 11")
    ship_package(probe.sparkSession)
    rows = base.where("simhash is not null").select("id", "simhash")
    # per fingerprint its two lowest ids: enough to leave the probe itself out
    low = rows.groupBy("simhash").agg(F.min("id").alias("id1"))
    second = rows.join(low, "simhash").where("id <> id1").groupBy("simhash").agg(F.min("id").alias("id2"))
    low = cut(low.join(second, "simhash", "left"))
    probe = cut(probe.where("simhash is not null").select("id", "simhash").join(low, "simhash", "left"))
    same = {"self": F.when(F.col("id1") == F.col("id"), F.col("id2")).otherwise(F.col("id1")), "later": F.when(F.col("id1") < F.col("id"), F.col("id1"))}.get(exclude, F.col("id1"))
    probe = probe.select("id", "simhash", same.alias("base_id"))
    out = probe.where("base_id is not null").select("id", "base_id", F.lit(0).alias("dist"))
    if radius:
        out = out.unionByName(_searched(probe.where("base_id is null"), low, radius, exclude))
    return out.select("id", F.col("base_id").alias("best_id"), "dist")
