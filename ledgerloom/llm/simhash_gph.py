"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has a bit set where over half of the XXH64 hashes (seed 42) of the text's word shingles have it set. Texts are
linked when their fingerprints differ in at most `radius` bits, and a document's component is what links reach.

Links are found between distinct fingerprints only, so copies cost one row:

1. Bits are put in an order that keeps correlated bits together (counts of all pairs of bits over all fingerprints) and cut
   into 2, 3 or 4 partitions.
2. With radius r and m partitions, any thresholds t_1..t_m >= -1 that sum to r - m + 1 lose no link: two fingerprints within
   r bits are within t_i in some partition i. Each fingerprint takes the thresholds with the lowest estimated cost, by dynamic
   programming over the partitions; a busy partition value gets a low threshold or none. Candidates are estimated from
   histograms of at most 2^11 values of each block of bits, counted over all fingerprints. The number of partitions is the
   one with the lowest total estimate: few wide ones as the corpus grows, so candidates per fingerprint stay few.
3. A fingerprint probes all values within t_i of its own in partition i; joined pairs are verified on all 64 bits.

Values held by more than `hot` distinct fingerprints are not joined: there, every fingerprint meets its links at the words
one or two bits away from it (a link of up to 3 bits has a word one bit from one end and two from the other), and whatever
meets at a word is tied to the smallest fingerprint there. That is linear in the group and as exact.

Null and empty texts have fingerprint zero and are linked like any other. Repeated rows and ids are kept; the component id
is the smallest non-null id reached, null if there is none. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import components
from ledgerloom.llm.frames import any_names, arrow_schema, pieces, stage
from pyspark.sql import types as T

BLOCK = 11


@dataclass(frozen=True)
class SimHashParams:
    width: int = 3
    radius: int = 3
    hot: int = 4096
    # Work of making and shuffling one probe, in tests of one candidate.
    probe_cost: float = 5.0
    partitions: tuple[int, ...] = (2, 3, 4)


def fingerprint(raw: bytes, width: int) -> int:
    words = raw.lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    k = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(text[a:b], 42) for a, b in zip(start[:len(words) - k + 1].tolist(), end[k - 1:].tolist())], "<u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, params: SimHashParams, key: str = "doc_id") -> DataFrame:
    """(key, fp) of every row."""
    schema = T.StructType([docs.schema[key], T.StructField("fp", T.LongType())])
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            fp = [fingerprint(x or b"", params.width) for x in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(key).cast(target[0].type), pa.array(fp, pa.int64())], schema=target)

    return docs.select(key, "text").mapInArrow(run, schema)


def column_of(batches: Iterator[pa.RecordBatch], name: str = "fp") -> Iterator[np.ndarray]:
    for b in batches:
        if b.num_rows:
            yield b.column(name).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def bits_of(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def counted(fps: DataFrame, count) -> dict[tuple[int, int], int]:
    """Sums over all fingerprints of what `count` returns for a batch: {(row, column): n} as arrays; few cells, so few rows."""
    def run(batches):
        total = None
        for fp in column_of(batches):
            total = count(fp) if total is None else total + count(fp)
        if total is not None:
            r, c = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(total[r, c].astype(np.int64))], names=["r", "c", "n"])

    cells = fps.select("fp").mapInArrow(run, "r int, c int, n long").groupBy("r", "c").agg(F.sum("n").alias("n")).collect()
    return {(x["r"], x["c"]): x["n"] for x in cells}


def bit_order(fps: DataFrame) -> tuple[list[int], int]:
    """Bits with correlated ones side by side, and the number of fingerprints."""
    def pairs(fp):
        b = np.c_[bits_of(fp), np.ones(len(fp), np.uint8)].astype(np.float64)
        return (b.T @ b).astype(np.int64)

    cells = counted(fps, pairs)
    both = np.zeros((65, 65))
    for (r, c), n in cells.items():
        both[r, c] = n
    n = max(both[64, 64], 1)
    share = both[64, :64] / n
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    tie = np.abs(both[:64, :64] / n - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(tie, 0)
    order = [int(tie.sum(axis=0).argmax())]
    left = set(range(64)) - set(order)
    while left:
        recent = order[-BLOCK:]
        order.append(max(sorted(left), key=lambda b: tie[b, recent].mean()))
        left.remove(order[-1])
    return order, int(both[64, 64])


def rearranged(fp: np.ndarray, order: list[int]) -> np.ndarray:
    out = np.zeros_like(fp)
    for to, bit in enumerate(order):
        out |= ((fp >> np.uint64(bit)) & np.uint64(1)) << np.uint64(to)
    return out


def masks(width: int, most: int) -> list[np.ndarray]:
    """Words of `width` bits with d bits set, for d = 0..most."""
    return [np.array([sum(1 << b for b in c) for c in combinations(range(width), d)], np.uint64) for d in range(most + 1)]


def cuts(total: int, parts: int) -> list[tuple[int, int]]:
    """(offset, width) of `parts` nearly equal runs of `total` bits."""
    edge = [round(total * i / parts) for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edge, edge[1:])]


class Plan:
    """Bit order, partitions and the estimates behind the thresholds."""

    def __init__(self, order: list[int], n: int, parts: int, histograms: np.ndarray, params: SimHashParams):
        self.order, self.n, self.params, self.ranges = order, n, params, cuts(64, parts)
        self.blocks = self.block_layout(parts)
        r = params.radius
        self.near = []
        for row, (_, width) in zip(histograms, (b for part in self.blocks for b in part)):
            h = row[:1 << width].astype(np.float64) / max(n, 1)
            values = np.arange(1 << width, dtype=np.int64)
            self.near.append(np.stack([h[values[:, None] ^ m.astype(np.int64)[None, :]].sum(axis=1) if len(m) else np.zeros(1 << width)
                                       for m in masks(width, r)], axis=1))
        self.masks = [np.concatenate(masks(w, r)) for _, w in self.ranges]
        self.probes = [np.cumsum([len(m) for m in masks(w, r)]) for _, w in self.ranges]

    @staticmethod
    def block_layout(parts: int) -> list[list[tuple[int, int]]]:
        return [[(o + a, w) for a, w in cuts(width, -(-width // BLOCK))] for o, width in cuts(64, parts)]

    @classmethod
    def histogram(cls, order: list[int], parts: int):
        blocks = [b for part in cls.block_layout(parts) for b in part]

        def count(fp):
            x = rearranged(fp, order)
            return np.stack([np.bincount(((x >> np.uint64(o)) & np.uint64((1 << w) - 1)).astype(np.int64), minlength=1 << BLOCK) for o, w in blocks])
        return count, (len(blocks), 1 << BLOCK)

    def thresholds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Thresholds (rows x partitions) with the lowest estimated cost, and that cost, for rearranged fingerprints."""
        r = self.params.radius
        costs, block = [], 0
        for i, part in enumerate(self.blocks):
            seen = None
            for o, w in part:
                d = self.near[block][((x >> np.uint64(o)) & np.uint64((1 << w) - 1)).astype(np.int64)]
                seen = d if seen is None else np.stack([(seen[:, :k + 1] * d[:, k::-1]).sum(axis=1) for k in range(r + 1)], axis=1)
                block += 1
            found = np.cumsum(seen, axis=1) * self.n
            costs.append(np.c_[np.zeros(len(x)), found + self.params.probe_cost * self.probes[i]])
        # best[u]: lowest cost with u units given out, where threshold t takes t + 1 of the radius + 1 units.
        best, picks = np.full((len(x), r + 2), np.inf), []
        best[:, 0] = 0
        for c in costs:
            options = np.stack([np.stack([best[:, u - g] + c[:, g] if g <= u else np.full(len(x), np.inf) for g in range(r + 2)], axis=1) for u in range(r + 2)], axis=1)
            picks.append(options.argmin(axis=2))
            best = options.min(axis=2)
        out, units = np.zeros((len(x), len(costs)), np.int64), np.full(len(x), r + 1)
        for i in range(len(costs) - 1, -1, -1):
            out[:, i] = picks[i][np.arange(len(x)), units]
            units = units - out[:, i]
        return out - 1, best[:, r + 1]

    def keys(self, x: np.ndarray, i: int) -> np.ndarray:
        o, w = self.ranges[i]
        return ((x >> np.uint64(o)) & np.uint64((1 << w) - 1)) | np.uint64(i << 32)

    def index(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([self.keys(x, i) for i in range(len(self.ranges))]), np.tile(np.arange(len(x)), len(self.ranges))

    def probe(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t, _ = self.thresholds(x)
        keys, rows = [], []
        for i in range(len(self.ranges)):
            key = self.keys(x, i)
            for level in range(self.params.radius + 1):
                at = np.flatnonzero(t[:, i] == level)
                if len(at):
                    m = self.masks[i][:self.probes[i][level]]
                    keys.append((key[at][:, None] ^ m[None, :]).ravel())
                    rows.append(np.repeat(at, len(m)))
        return np.concatenate(keys), np.concatenate(rows)


def make_plan(fps: DataFrame, params: SimHashParams) -> Plan:
    """The number of partitions with the lowest estimated total over all fingerprints."""
    order, n = bit_order(fps)
    plans = []
    for parts in params.partitions:
        count, shape = Plan.histogram(order, parts)
        h = np.zeros(shape, np.int64)
        for (r, c), k in counted(fps, count).items():
            h[r, c] = k
        plans.append(Plan(order, n, parts, h, params))
    if len(plans) == 1:
        return plans[0]

    def totals(fp):
        x = rearranged(fp, order)
        return np.array([[int(p.thresholds(x)[1].sum()) + 1 for p in plans]])

    sums = counted(fps, totals)
    return min(enumerate(plans), key=lambda p: sums.get((0, p[0]), 0))[1]


def keyed(fps: DataFrame, plan: Plan, make: str) -> DataFrame:
    """(key, x): rearranged fingerprints under their own partition values ("index"), or the values they probe ("probe")."""
    def run(batches):
        for b in batches:
            whole = b.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for k in range(0, len(whole), 2000):
                x = rearranged(whole[k:k + 2000], plan.order)
                key, row = getattr(plan, make)(x)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(x[row].view(np.int64))], names=["key", "x"])

    return fps.select("fp").mapInArrow(run, "key long, x long")


def balls(points: DataFrame, most: int) -> DataFrame:
    """(word, x): all words within `most` bits of each x."""
    flips = np.concatenate(masks(64, most)).view(np.int64)

    def run(batches):
        for b in batches:
            x = b.column("x").to_numpy(zero_copy_only=False).astype(np.int64)
            for k in range(0, len(x), 200):
                word = (x[k:k + 200, None] ^ flips[None, :]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(np.repeat(x[k:k + 200], len(flips)))], names=["word", "x"])

    return points.mapInArrow(run, "word long, x long")


def links(fps: DataFrame, params: SimHashParams) -> DataFrame:
    """Edges (a, b) over rearranged fingerprints that connect exactly what pairs within the radius connect; and the plan."""
    if params.radius > 3:
        raise ValueError("busy values are handled for a radius of at most 3")
    plan = make_plan(fps, params)
    index, probes = keyed(fps, plan, "index"), keyed(fps, plan, "probe")
    hot = stage(index.groupBy("key").count().filter(F.col("count") > params.hot).select("key"), "hot_values")
    extra = None
    if not hot.isEmpty():
        inside = index.join(hot, "key", "left_semi").select("x").distinct()
        reach = probes.join(hot, "key", "left_semi").select("x").distinct()
        near = balls(inside.union(reach).distinct(), params.radius // 2)
        centre = near.groupBy("word").agg(F.min("x").alias("b"))
        wide = balls(inside, params.radius - params.radius // 2)
        extra = near.union(wide).join(centre, "word").filter("x <> b").select(F.col("x").alias("a"), "b").distinct()
        index, probes = index.join(hot, "key", "left_anti"), probes.join(hot, "key", "left_anti")
    p, q = probes.alias("p"), index.alias("q")
    close = F.bit_count(F.col("p.x").bitwiseXOR(F.col("q.x"))) <= params.radius
    found = p.join(q, (F.col("p.key") == F.col("q.key")) & (F.col("p.x") < F.col("q.x")) & close).select(
        F.col("q.x").alias("a"), F.col("p.x").alias("b")).distinct()
    return (found if extra is None else found.union(extra)), plan


def near_duplicates(docs: DataFrame, params: SimHashParams = SimHashParams(), key: str = "doc_id") -> DataFrame:
    """(key, fp, component_id) for every row of `docs`."""
    rows = stage(fingerprints(docs, params, key), "fingerprints")
    fps = stage(rows.groupBy("fp").agg(F.min(key).alias("first")), "distinct_fingerprints")
    edges, plan = links(fps, params)
    label = components(edges)
    order = plan.order

    def put_back(batches):
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("fp"), pa.array(rearranged(fp.view(np.uint64), order).view(np.int64)), b.column("first")],
                                             names=["fp", "x", "first"])

    first_type = fps.schema["first"].dataType.simpleString()
    named = (fps.mapInArrow(put_back, f"fp long, x long, first {first_type}")
             .join(label, F.col("x") == F.col("id"), "left").select("fp", "first", F.coalesce("label", "x").alias("label")))
    smallest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    lookup = named.join(smallest, "label").select("fp", "component_id")
    return rows.join(lookup, "fp").select(key, "fp", "component_id")


@any_names
def one_of_each(docs: DataFrame, params: SimHashParams = SimHashParams(), key: str = "doc_id") -> DataFrame:
    """`docs` without near-duplicates: of every component the row with its id stays.

    Of rows that agree in id and text one stays. Of a component without any id one row stays.
    """
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    named = docs.select(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), text.alias("t")).alias("row"), "text")
    found = near_duplicates(named, params, "row")
    # A component is named by its smallest row, of those with an id where there are any.
    kept = found.select(F.col("component_id.id").alias("__id"), F.col("component_id.t").alias("__u")).distinct()
    marked = docs.withColumn("__t", text)
    return (marked.join(kept, F.col(key).eqNullSafe(F.col("__id")) & (F.col("__t") == F.col("__u")), "left_semi")
            .dropDuplicates([key, "__t"]).drop("__t"))
