"""Hard negatives of anchors: rows of other labels that score just below an anchor's positives, read by zone maps.

Scores are integer inner products. A vector's component x counts as floor(256 * x).

1. Blocks. Rows are sorted by (label, place on a Hilbert curve through all dimensions, id) and written as Parquet rows of up to
   `rows` vectors of one label, each with its smallest and largest value in every dimension: the zone map. The curve's cells
   are cut at the mean and two thirds of a deviation to either side, from sums over all rows.
2. Anchors (ids divisible by `every`) are packed into groups of one label; the fifth best score in an anchor's own block is
   its first threshold.
3. Bounds. Interval arithmetic over a zone map gives the lowest and highest score any row of the block can have with an
   anchor: two small matrix products for a group and a page of zone maps. Groups meet pages by page number, so every page
   has the same work whatever the labels are.
4. Positives: blocks of the anchor's label whose highest possible score reaches its threshold are read, and the best `positives`
   rows kept. Negatives: blocks of other labels whose range of scores meets the window of one of the positives are read.

Only anchors that need a block are scored on it, and a task keeps a group's best rows as the group's blocks go by. Nothing is
capped: a block is left out only by its bounds.

Rows with a null id, label or vector, or a null or non-finite component, take no part. Shorter vectors
count as filled up with zeros. Rows that agree in id, label and vector count once; rows that share only an id
are different rows. Ties go to the smaller id. Scores of 2^53 or more (components of some 46,000 in 64 dimensions) are
refused with an error. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.frames import stage

LIMIT = 2.0 ** 53
NEVER = -(1 << 62)


@dataclass(frozen=True)
class NegativeParams:
    every: int = 50
    positives: int = 5
    negatives: int = 3
    # A negative's score, in hundredths of its positive's.
    low: int = 50
    high: int = 95
    rows: int = 2048
    group: int = 512
    page: int = 256


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of every row of `cells` (values below 2^bits), as bytes that sort like the place."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    # Axes to the transposed index: undo the excess turns from the top bit down, then take the Gray code.
    for b in range(bits - 1, 0, -1):
        q, low = 1 << b, (1 << b) - 1
        for d in range(dims):
            turned = (x[d] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << b), (1 << b) - 1, 0)
    x ^= flip
    planes = np.stack([(x[d] >> b) & 1 for b in range(bits - 1, -1, -1) for d in range(dims)], axis=1)
    return np.packbits(planes.astype(np.uint8), axis=1)


def vectors(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of a list column as floor(256 x), one row each."""
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        whole = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    else:
        whole = np.zeros((len(sizes), width))
        for row, v in zip(whole, column.to_pylist()):
            row[:len(v)] = v
    return np.floor(256 * whole)


def usable(rows: DataFrame, key: str, label: Column, vector: str) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part."""
    return rows.select(F.col(key).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector")).filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()).filter(~F.coalesce(
            F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False)))


def moments(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of every dimension, over all rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = vectors(b.column("vector"), width)
            if len(v) and width * np.abs(v).max(initial=0) ** 2 >= LIMIT:
                raise ValueError("components are too large for exact scores")
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(np.full(width, float(len(v)))),
                                              pa.array(v.sum(axis=0)), pa.array((v * v).sum(axis=0))], names=["d", "n", "s", "t"])

    sums = rows.select("vector").mapInArrow(run, "d int, n double, s double, t double").groupBy("d").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("t").alias("t")).collect()
    mean, spread = np.zeros(width), np.ones(width)
    for r in sums:
        n = max(r["n"], 1)
        mean[r["d"]] = r["s"] / n
        spread[r["d"]] = np.sqrt(max(r["t"] / n - mean[r["d"]] ** 2, 0))
    return mean, spread


def blocks_of(rows: DataFrame, width: int, params: NegativeParams) -> DataFrame:
    """Blocks of one label each, in order of the curve: block, label, n, ids, rows, lo, hi (packed 64-bit ids, 32-bit components)."""
    mean, spread = moments(rows, width)
    edges = np.stack([mean - 0.67 * spread, mean, mean + 0.67 * spread])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = vectors(b.column("vector"), width)
            where = hilbert((v[:, None, :] > edges[None]).sum(axis=1), 2)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([x.tobytes() for x in where], pa.binary()),
                                              pa.array([x.tobytes() for x in v.astype("<i4")], pa.binary())], names=["vec_id", "label", "place", "ints"])

    placed = stage(rows.mapInArrow(place, "vec_id long, label long, place binary, ints binary"), "placed")
    size = params.rows

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, label, ids, ints, last = TaskContext.get().partitionId(), 0, None, [], [], None

        def block():
            m = np.frombuffer(b"".join(ints), "<i4").reshape(len(ids), width)
            return pa.RecordBatch.from_pylist([{
                "block": (part << 36) | seq, "label": label, "n": len(ids), "ids": np.array(ids, "<i8").tobytes(), "rows": m.tobytes(),
                "lo": m.min(axis=0).tobytes(), "hi": m.max(axis=0).tobytes()}], schema=target)

        for b in batches:
            for i, of, at, v in zip(*(b.column(c).to_pylist() for c in ("vec_id", "label", "place", "ints"))):
                if ids and (of != label or len(ids) == size):
                    yield block()
                    seq, ids, ints = seq + 1, [], []
                if (i, of, v) != last:
                    label, last = of, (i, of, v)
                    ids.append(i)
                    ints.append(v)
        if ids:
            yield block()

    target = pa.schema([("block", pa.int64()), ("label", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("rows", pa.binary()), ("lo", pa.binary()), ("hi", pa.binary())])
    order = ["label", "place", "vec_id", "ints"]
    return stage(placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        cut, "block long, label long, n long, ids binary, rows binary, lo binary, hi binary"), "blocks")


def longs(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i8")


def floats(raw: bytes, width: int) -> np.ndarray:
    """Packed components as doubles, which add and multiply them exactly below LIMIT."""
    return np.frombuffer(raw, "<i4").reshape(-1, width).astype(np.float64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by (score down, id up) of those that are not NEVER."""
    at = np.flatnonzero(scores > NEVER)
    if len(at) > k:
        at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k]]
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def groups_of(blocks: DataFrame, width: int, params: NegativeParams) -> DataFrame:
    """Anchors in groups of one label: grp, label, ids, rows, windows (one [low, high] or more per anchor), own block and place.

    The first window of an anchor reaches from the last of its best scores in its own block upwards.
    """
    k, size, every = params.positives, params.group, params.every
    target = pa.schema([("grp", pa.int64()), ("label", pa.int64()), ("ids", pa.binary()), ("rows", pa.binary()), ("windows", pa.binary()), ("home", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, label, held = TaskContext.get().partitionId(), 0, None, []

        def group():
            ids, rows, low, home = (np.concatenate(x) for x in zip(*held))
            windows = np.stack([low, np.full(len(low), -NEVER)], axis=1)
            return pa.RecordBatch.from_pylist([{"grp": (part << 36) | seq, "label": label, "ids": ids.tobytes(), "rows": rows.astype("<i4").tobytes(),
                                                "windows": windows.astype("<i8").tobytes(), "home": home.tobytes()}], schema=target)

        for b in batches:
            for r in b.to_pylist():
                ids, rows = longs(r["ids"]), floats(r["rows"], width)
                at = np.flatnonzero(ids % every == 0)
                if not len(at):
                    continue
                if held and r["label"] != label:
                    yield group()
                    seq, held = seq + 1, []
                scores = (rows[at] @ rows.T).astype(np.int64)
                scores[np.arange(len(at)), at] = NEVER
                low = np.full(len(at), NEVER)
                if rows.shape[0] > k:
                    low = np.partition(scores, rows.shape[0] - k, axis=1)[:, rows.shape[0] - k]
                label = r["label"]
                home = np.stack([np.full(len(at), r["block"]), at], axis=1).astype("<i8")
                for c in range(0, len(at), size):
                    s = slice(c, c + size)
                    if held and sum(len(h[0]) for h in held) + len(at[s]) > size:
                        yield group()
                        seq, held = seq + 1, []
                    held.append((ids[at[s]], rows[at[s]], low[s], home[s]))
        if held:
            yield group()

    return stage(blocks.select("block", "label", "ids", "rows").mapInArrow(run, "grp long, label long, ids binary, rows binary, windows binary, home binary"), "anchors")


def pages_of(blocks: DataFrame, params: NegativeParams) -> tuple[DataFrame, int]:
    """Zone maps of up to about `page` blocks in a row, numbered from 0, and the number of pages."""
    pages = -(-blocks.count() // params.page)
    zones = blocks.select("block", "label", "lo", "hi").withColumn("page", F.pmod(F.xxhash64("block"), F.lit(max(pages, 1))))
    return stage(zones.groupBy("page").agg(F.collect_list(F.struct("block", "label", "lo", "hi")).alias("zones")), "pages"), pages


def needed(groups: DataFrame, pages: DataFrame, n_pages: int, width: int, same_label: bool) -> DataFrame:
    """(grp, block, who): the anchors of a group, by place, that the bounds send to a block."""
    target = pa.schema([("grp", pa.int64()), ("block", pa.int64()), ("who", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                zones = [z for z in r["zones"] if (z["label"] == r["label"]) == same_label]
                if not zones:
                    continue
                a, lo, hi = floats(r["rows"], width), *(floats(b"".join(z[c] for z in zones), width) for c in ("lo", "hi"))
                up, down = np.maximum(a, 0), np.minimum(a, 0)
                most, least = up @ hi.T + down @ lo.T, up @ lo.T + down @ hi.T
                windows = longs(r["windows"]).reshape(len(a), -1, 2)
                meet = np.zeros(most.shape, bool)
                for k in range(windows.shape[1]):
                    meet |= (most >= windows[:, k, :1]) & (least <= windows[:, k, 1:])
                out = [(r["grp"], z["block"], np.flatnonzero(meet[:, j]).astype("<i4").tobytes()) for j, z in enumerate(zones) if meet[:, j].any()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), target)], schema=target)

    dealt = groups.select("grp", "label", "rows", "windows", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(n_pages, 1) - 1).cast("long"))).alias("page"))
    met = dealt.join(pages, "page").select("grp", "label", "rows", "windows", "zones")
    return stage(met.mapInArrow(run, "grp long, block long, who binary"), "needed")


def scored(need: DataFrame, groups: DataFrame, blocks: DataFrame, width: int, k: int) -> DataFrame:
    """(grp, who, win, partner, score, rank): the k best rows of all needed blocks in every window of an anchor.

    Blocks come to the groups that need them, so a task keeps the best rows of a group as its blocks go by.
    """
    target = pa.schema([("grp", pa.int64()), ("who", pa.int32()), ("win", pa.int32()), ("partner", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, kept = None, {}

        def best_rows():
            out = [(grp, who, win, partner, score) for (who, win), pairs in kept.items() for score, partner in pairs]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), target)], schema=target)

        for b in batches:
            for r in b.to_pylist():
                if r["grp"] != grp and kept:
                    yield best_rows()
                    kept = {}
                grp = r["grp"]
                who, home = np.frombuffer(r["who"], "<i4"), longs(r["home"]).reshape(-1, 2)
                windows = longs(r["windows"]).reshape(len(home), -1, 2)
                ids, rows = longs(r["b_ids"]), floats(r["b_rows"], width)
                scores = (floats(r["rows"], width)[who] @ rows.T).astype(np.int64)
                for line, w in zip(scores, who.tolist()):
                    if home[w, 0] == r["block"]:
                        line[home[w, 1]] = NEVER
                    for x, (low, high) in enumerate(windows[w].tolist()):
                        at = best(np.where((line >= low) & (line <= high), line, NEVER), ids, k)
                        if len(at):
                            more = [*kept.get((w, x), ()), *zip(line[at].tolist(), ids[at].tolist())]
                            kept[w, x] = sorted(more, key=lambda p: (-p[0], p[1]))[:k]
        if kept:
            yield best_rows()

    met = need.join(blocks.select("block", F.col("ids").alias("b_ids"), F.col("rows").alias("b_rows")), "block").join(
        groups.select("grp", "rows", "windows", "home"), "grp")
    found = met.mapInArrow(run, "grp long, who int, win int, partner long, score long")
    # A group whose blocks were dealt to several tasks has several candidates for a rank.
    place = F.row_number().over(Window.partitionBy("grp", "who", "win").orderBy(F.desc("score"), "partner"))
    return stage(found.withColumn("rank", place).filter(F.col("rank") <= k), "scored")


def with_windows(groups: DataFrame, positives: DataFrame, params: NegativeParams) -> DataFrame:
    """`groups` with the score windows of every anchor's positives."""
    k, low, high = params.positives, params.low, params.high

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                windows = np.tile(np.array([1, 0], "<i8"), (len(longs(r["ids"])), k, 1))
                for p in r["found"]:
                    windows[p["who"], p["rank"] - 1] = -(-low * p["score"] // 100), high * p["score"] // 100
                yield pa.RecordBatch.from_pylist([{**{c: r[c] for c in target.names}, "windows": windows.tobytes()}], schema=target)

    target = pa.schema([("grp", pa.int64()), ("label", pa.int64()), ("ids", pa.binary()), ("rows", pa.binary()), ("windows", pa.binary()), ("home", pa.binary())])
    found = positives.groupBy("grp").agg(F.collect_list(F.struct("who", "rank", "score")).alias("found"))
    return stage(groups.join(found, "grp").mapInArrow(run, "grp long, label long, ids binary, rows binary, windows binary, home binary"), "anchors")


def named(groups: DataFrame) -> DataFrame:
    """(grp, who, anchor_id)"""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, raw in zip(b.column("grp").to_pylist(), b.column("ids").to_pylist()):
                ids = longs(raw)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), g)), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids)], names=["grp", "who", "anchor_id"])

    return groups.select("grp", "ids").mapInArrow(run, "grp long, who int, anchor_id long")


def hard_negatives(rows: DataFrame, params: NegativeParams = NegativeParams(), key: str = "vec_id", label: Column | str = "label",
                   vector: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor and positive."""
    used = usable(rows, key, F.col(label) if isinstance(label, str) else label, vector)
    width = max(used.agg(F.max(F.size("vector"))).first()[0] or 1, 1)
    blocks = blocks_of(used, width, params)
    groups = groups_of(blocks, width, params)
    pages, n_pages = pages_of(blocks, params)
    positives = scored(needed(groups, pages, n_pages, width, True), groups, blocks, width, params.positives)
    targets = with_windows(groups, positives, params)
    negatives = scored(needed(targets, pages, n_pages, width, False), targets, blocks, width, params.negatives)
    of = positives.select("grp", "who", (F.col("rank") - 1).alias("win"), F.col("partner").alias("positive_id"), F.col("score").alias("positive_score"))
    return negatives.join(of, ["grp", "who", "win"]).join(named(groups), ["grp", "who"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("partner").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
