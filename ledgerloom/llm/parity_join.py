"""Jaccard join of documents by parity sketches: components of texts whose word shingles overlap by a given share.

A document's set holds the distinct `width`-word shingles of its lower-cased words; with fewer words, all of them as one. Two sets
link when 100 * |A and B| >= percent * |A or B|. Links of 80 per cent mean a symmetric difference of at most (|A| + |B|) / 9.

1. Sketch. In a sketch of m parts every shingle flips one place of the part that its hash names; a part's parity is carried as
   the XOR of its shingles' 64-bit hashes, so the parts in which two sketches differ are at most as many as the shingles in
   the symmetric difference.
2. Bands. Sizes are cut at powers of four. Sets of one band share a sketch layout, and sets within reach of the next band's
   share another with those there, so every pair that can link is in one of them. A set that can differ by D from any partner in
   its layout must agree with it in m - D parts; so its D + 1 first parts, in an order that all sets share, hold a common one.
   The order puts parts with many shingles first: such a part is rarely the same in strangers, and empty parts are used last.
3. Join. Rows are dealt by part once; parts found in one set only leave. What is left is one row per part and set; every
   set is compared with the smallest of its part, and linked sets get one component. A part whose sets are all in one
   component is settled. The sets of the others are met again: now all parts of a sketch are put in order of how many
   of these sets have them, rare ones first, so that what a shared passage makes alike comes last. Where a part still has
   several components after another round, its sets are dealt into blocks of bounded size, and sketches are compared block
   by block: first the closest pair of a set and a block, then, between components that are still apart, all pairs that
   can link.
4. Verification. A packed one-bit sketch of either set gives a Hamming distance, which bounds the symmetric difference from below.
   Pairs that pass are counted on their whole sets of hashes.

Sets are named by 128-bit hashes of their shingles; rows of equal sets are one set throughout. Shorter names of 64 bits are used in the
join, and sets whose short names clash get others.

Null, empty and blank texts have an empty set and link with nothing: each is its own component. Rows without an id are linked
as any other; a component is named by its smallest id, null where no row has one. Repeated rows and ids are kept. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.components import components
from ledgerloom.llm.frames import arrow_schema, pieces, stage

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class JaccardParams:
    width: int = 5
    percent: int = 80
    # Sets of a block in which parts that are still open are compared.
    block: int = 128
    # Short names that may clash, before the join is refused: some n^2 / 2^65 of n sets do.
    clashes: int = 100_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, one text behind the other, and the sizes of the sets."""
    names = defaultdict(count().__next__)
    words = [t.lower().split() for t in texts]
    ids = [np.fromiter(map(names.__getitem__, w), np.int64, len(w)) for w in words]
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
    flat = hashed[np.concatenate([np.zeros(0, np.int64), *ids])]
    # Of every place, the hash of the words there and behind; a short text's only shingle has a start value of its own.
    whole = np.zeros(max(len(flat) - width + 1, 0), np.uint64)
    for j in range(width):
        whole = whole * MIX1 + flat[j:j + len(whole)]
    whole = mixed(whole)
    sets, at = [], 0
    for w in ids:
        n = len(w)
        if n >= width:
            h = np.sort(whole[at:at + n - width + 1])
            fresh = h[1:] != h[:-1]
            sets.append(h if fresh.all() else np.concatenate([h[:1], h[1:][fresh]]))
        elif n:
            few = np.array([n], np.uint64)
            for x in flat[at:at + n]:
                few = mixed(few * MIX2 + x)
            sets.append(few)
        else:
            sets.append(whole[:0])
        at += n
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.fromiter(map(len, sets), np.int64, len(sets))


def layouts(sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(set, layout, parts, most): the layouts of every set, their numbers of parts, and how many shingles it can differ by there."""
    def apart(x, y):
        return (x + y) * (100 - percent) // (100 + percent)

    at = np.flatnonzero(sizes > 0)
    a = sizes[at]
    band = (np.frexp(a.astype(np.float64))[1] - 1) // 2
    low, high = 4 ** band, 4 ** (band + 1) - 1
    reach = a * 100 // percent
    own = (at, 2 * band, apart(high, high), apart(a, np.minimum(reach, high)))
    up = reach > high
    above = (at[up], 2 * band[up] + 1, apart(high[up], high[up] * 100 // percent), apart(a[up], reach[up]))
    down = (low > 1) & (a <= (low - 1) * 100 // percent)
    below = (at[down], 2 * band[down] - 1, apart(low[down] - 1, (low[down] - 1) * 100 // percent), apart(a[down], low[down] - 1))
    s, layout, differ, most = (np.concatenate(x) for x in zip(own, above, below))
    return s, layout, np.maximum(differ * 5 // 4, 64) + 1, most


def parts(h: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """(set, layout, key, held, most) of every part of every set in every layout of it: its parity, the shingles it holds, and
    how many shingles the set can differ by. A set's parts in a layout stand together.
    """
    s, layout, m, most = layouts(sizes, percent)
    starts = np.cumsum(sizes) - sizes
    n = sizes[s]
    entry = np.repeat(np.arange(len(s)), n)
    token = h[np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n) + starts[s][entry]]
    turned = mixed(token + layout[entry].astype(np.uint64) * MIX2)
    first = np.cumsum(m) - m
    part = ((turned >> np.uint64(32)) * m.astype(np.uint64)[entry]) >> np.uint64(32)
    cell = first[entry] + part.astype(np.int64)
    held = np.bincount(cell, minlength=int(m.sum()))
    filled = np.flatnonzero(held)
    parity = np.zeros(len(held), np.uint64)
    if len(filled):
        parity[filled] = np.bitwise_xor.reduceat(turned[np.argsort(cell, kind="stable")], np.cumsum(held[filled]) - held[filled])
    of = np.repeat(np.arange(len(s)), m)
    place = (np.arange(len(of)) - first[of]).astype(np.uint64)
    key = mixed(parity + mixed((layout[of].astype(np.uint64) << np.uint64(40)) + place))
    return s[of], layout[of], key, held, most[of]


def lookup(h: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, key): the parts that a set is looked up by, those with many shingles first."""
    s, layout, key, held, most = parts(h, sizes, percent)
    if not len(s):
        return s, key
    new = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (layout[1:] != layout[:-1])]))
    of = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(s))))
    order = np.lexsort((key, -held, of))
    chosen = order[np.arange(len(of)) - new[of] <= most]
    return s[chosen], key[chosen]


def packed_sketches(h: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """For every set, the parity of its hashes at each of about |set| places (a power of two, 64 at least), packed."""
    places = np.maximum(1 << np.frexp(np.maximum(sizes, 1) - 1.0)[1], 64).astype(np.int64)
    first = np.cumsum(places) - places
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = first[owner] + (mixed(h) & (places[owner] - 1).astype(np.uint64)).astype(np.int64)
    bits = np.packbits((np.bincount(at, minlength=int(places.sum())) & 1).astype(np.uint8), bitorder="little")
    cut = np.append(first, places.sum()) // 8
    return [bits[x:y].tobytes() for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())]


def hamming(x: bytes, y: bytes) -> int:
    """Bits in which two sketches differ once the longer one is folded to the shorter one's length."""
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        half = len(x) // 2
        x = (np.frombuffer(x[:half], np.uint8) ^ np.frombuffer(x[half:], np.uint8)).tobytes()
    return (int.from_bytes(x, "little") ^ int.from_bytes(y, "little")).bit_count()


def set_rows(docs: DataFrame, params: JaccardParams, key: str) -> DataFrame:
    """(key, t, n, k1, k2, sketch) of every row: a hash of the text, the size, the 128-bit name and the packed sketch of its set."""
    rows = docs.select(key, "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"))
    schema = T.StructType([docs.schema[key], *T.StructType.fromDDL("t long, n long, k1 long, k2 long, sketch binary").fields])
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, h, sizes in hashed_batches(batches, params.width):
            name = np.frombuffer(b"".join(names_of(h, sizes)), "<i8").reshape(-1, 2)
            cols = [sizes, name[:, 0], name[:, 1], packed_sketches(h, sizes)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(target[0].type), b.column("t"), *(pa.array(c, f.type) for c, f in zip(cols, list(target)[2:]))], schema=target)

    return rows.mapInArrow(run, schema)


def hashed_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for b in pieces(batches, "text", 1 << 20):
        yield b, *shingle_sets([x or b"" for x in b.column("text").cast(pa.binary()).to_pylist()], width)


def names_of(h: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    cut = np.append(0, np.cumsum(sizes)).tolist()
    return [xxhash.xxh3_128_digest(h[x:y].tobytes()) for x, y in zip(cut, cut[1:])]


def short_names(name: np.ndarray, clashing: np.ndarray) -> np.ndarray:
    """64-bit names of sets; those whose first half is in `clashing` get one mixed from both halves."""
    both = mixed(name[:, 0].view(np.uint64) + mixed(name[:, 1].view(np.uint64))).view(np.int64)
    return np.where(np.isin(name[:, 0], clashing), both, name[:, 0])


def part_rows(docs: DataFrame, params: JaccardParams, clashing: np.ndarray) -> DataFrame:
    """(part, num): the parts that every set is looked up by. Copies within a task count once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, h, sizes in hashed_batches(batches, params.width):
            name = np.frombuffer(b"".join(names_of(h, sizes)), "<i8").reshape(-1, 2)
            num = short_names(name, clashing)
            fresh = np.array([n > 0 and x not in seen and not seen.add(x) for x, n in zip(num.tolist(), sizes.tolist())], bool)
            if len(seen) > 1 << 20:
                seen.clear()
            if fresh.any():
                of, key = lookup(h[np.repeat(fresh, sizes)], sizes[fresh], params.percent)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(num[fresh][of])], names=["part", "num"])

    return docs.select("text").mapInArrow(run, "part long, num long")


def shared_parts(rows: DataFrame) -> DataFrame:
    """The distinct (part, num) of `rows` whose part several sets have.

    The rows are dealt by part once, for the comparison and for themselves: the plan reuses that exchange, so that their texts
    are hashed once, and nothing is written for it.
    """
    dealt = rows.repartition("part")
    several = dealt.groupBy("part").agg(F.min("num").alias("lo"), F.max("num").alias("hi")).filter("lo < hi").select("part")
    return dealt.join(several, "part").distinct()


def rare_parts(bodies: DataFrame, params: JaccardParams) -> DataFrame:
    """(part, num): for every set, as many parts as it needs, those that fewest of these sets have."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(k, 256) for k in range(0, whole.num_rows, 256)):
                lists = b.column("body")
                h = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                of, layout, key, _, most = parts(h, np.diff(lists.offsets.to_numpy()).astype(np.int64), params.percent)
                num = b.column("num").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(num[of]), pa.array(layout.astype(np.int32)), pa.array(most.astype(np.int32))],
                                                 names=["part", "num", "layout", "most"])

    rows = stage(bodies.select("num", "body").mapInArrow(run, "part long, num long, layout int, most int"), "all_parts")
    held = rows.groupBy("part").agg(F.count("*").alias("held"))
    # A set that is there twice, from repeated rows, has every part twice: both have one rank.
    place = F.dense_rank().over(Window.partitionBy("num", "layout").orderBy("held", "part"))
    return rows.join(held, "part").withColumn("place", place).filter((F.col("place") <= F.col("most") + 1) & (F.col("held") > 1)).select("part", "num").distinct()


def close(pairs: DataFrame, bodies: DataFrame, params: JaccardParams) -> DataFrame:
    """The pairs (a, b) of `pairs` that link."""
    share, rest = params.percent, 100 - params.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            apart = np.fromiter((hamming(x, y) for x, y in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist())), np.int64, b.num_rows)
            total = b.column("na").to_numpy(zero_copy_only=False) + b.column("nb").to_numpy(zero_copy_only=False)
            yield b.filter(pa.array(apart * (100 + share) <= total * rest)).select(["a", "b"])

    def side(c: str, *extra: str) -> DataFrame:
        return bodies.select(F.col("num").alias(c), *(F.col(x).alias(f"{x[0]}{c}") for x in extra))

    near = stage(pairs.join(side("a", "n", "sketch"), "a").join(side("b", "n", "sketch"), "b").mapInArrow(run, "a long, b long"), "near")
    both = F.size(F.array_intersect("ba", "bb"))
    return stage(near.join(side("a", "body"), "a").join(side("b", "body"), "b").filter(
        100 * both >= share * (F.size("ba") + F.size("bb") - both)).select("a", "b"), "links")


def unsettled(rows: DataFrame, label: DataFrame) -> DataFrame:
    """(part, num, label) of the rows in parts that hold sets of several components."""
    named = rows.select("part", "num").join(label.select(F.col("id").alias("num"), "label"), "num", "left").withColumn("label", F.coalesce("label", "num"))
    several = named.groupBy("part").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("part")
    return stage(named.join(several, "part"), "unsettled")


def joined_so_far(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id within two edges. Equal labels are one component; one component may have several labels.

    That is enough to see what is settled, at a part of the cost of whole components; what it leaves open is only compared again.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("id", "to")
    one = both.groupBy("id").agg(F.min("to").alias("m")).select("id", F.least("id", "m").alias("label"))
    two = both.join(one.select(F.col("id").alias("to"), "label"), "to").select("id", "label")
    return stage(one.union(two).groupBy("id").agg(F.min("label").alias("label")), "labels")


def starred(rows: DataFrame) -> DataFrame:
    """(part, num, low): the rows without the smallest set of each part, beside it."""
    low = rows.groupBy("part").agg(F.min("num").alias("low"))
    return stage(rows.join(low, "part").filter("num <> low"), "starred")


def starred_apart(rows: DataFrame, label: DataFrame) -> DataFrame:
    """`starred`, and `apart`: whether the two sets have different labels. Others are linked, directly or through a third."""
    named = rows.join(label.select(F.col("id").alias("num"), "label"), "num", "left").withColumn("label", F.coalesce("label", "num"))
    low = named.groupBy("part").agg(F.min("num").alias("low"), F.min_by("label", "num").alias("low_label"))
    return stage(named.join(low, "part").filter("num <> low").select("part", "num", "low", (F.col("label") != F.col("low_label")).alias("apart")), "starred")


def in_blocks(left: DataFrame, bodies: DataFrame, params: JaccardParams, nearest: bool) -> DataFrame:
    """Pairs (num, low) of sets of one part and different components whose sketches are close enough to link.

    A part's sets are dealt into blocks of bounded size by hash. Rows are pairs of blocks, and only pairs of sets that pass come
    out; with `nearest`, of those a set has in a block only the closest one.
    """
    size, share, rest = params.block, params.percent, 100 - params.percent
    counts = left.groupBy("part").agg(F.ceil(F.count("*") / size).cast("int").alias("n_blocks"))
    dealt = left.join(counts, "part").withColumn("block", F.pmod(F.xxhash64("num", "part"), F.col("n_blocks")).cast("int"))
    item = F.struct("num", "label", "n", "sketch")
    blocks = stage(dealt.join(bodies.select("num", "n", "sketch"), "num").groupBy("part", "block", "n_blocks").agg(F.collect_list(item).alias("items")), "blocks")
    first = blocks.select("part", F.col("block").alias("own"), F.col("items").alias("x"), F.explode(F.sequence("block", F.col("n_blocks") - 1)).alias("block"))
    met = first.join(blocks.select("part", "block", F.col("items").alias("y")), ["part", "block"]).select((F.col("own") == F.col("block")).alias("same"), "x", "y")

    def packed(items: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        num, label, n = (np.array([i[c] for i in items], np.int64) for c in ("num", "label", "n"))
        return num, label, n, min(len(i["sketch"]) for i in items)

    def folded(items: list[dict], width: int) -> np.ndarray:
        return np.stack([np.bitwise_xor.reduce(np.frombuffer(i["sketch"], "<u8").reshape(-1, width // 8), axis=0) for i in items])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 64):
                out = []
                for r in whole.slice(k, 64).to_pylist():
                    (a, la, na, wa), (b, lb, nb, wb) = packed(r["x"]), packed(r["y"])
                    if r["same"] and (la == la[0]).all():
                        continue
                    u, v = (folded(z, min(wa, wb)) for z in (r["x"], r["y"]))
                    apart = np.zeros((len(a), len(b)), np.int64)
                    for w in range(u.shape[1]):
                        apart += np.bitwise_count(u[:, w, None] ^ v[None, :, w])
                    ok = (la[:, None] != lb) & (apart * (100 + share) <= (na[:, None] + nb) * rest)
                    if r["same"]:
                        ok &= a[:, None] > b
                    at, to = np.nonzero(ok)
                    if nearest and len(at):
                        at = np.flatnonzero(ok.any(axis=1))
                        to = np.where(ok, apart / (na[:, None] + nb), np.inf)[at].argmin(axis=1)
                    out.append((a[at], b[to]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["num", "low"])

    return met.mapInArrow(run, "num long, low long")


def linked(rows: DataFrame, bodies: DataFrame, params: JaccardParams) -> DataFrame:
    """Edges (a, b) that connect what links between sets with a part in common connect."""
    def met(pairs: DataFrame) -> DataFrame:
        return close(pairs.select(F.col("num").alias("a"), F.col("low").alias("b")).distinct(), bodies, params)

    # A set that all others of its part were compared with has done its work there.
    rest = starred(rows)
    edges = met(rest)
    label = joined_so_far(edges)
    left = unsettled(rest, label)
    if left.isEmpty():
        return edges
    rest = starred_apart(stage(rare_parts(bodies.join(left.select("num").distinct(), "num", "left_semi"), params), "rare_parts"), label)
    edges = stage(edges.union(met(rest.filter("apart"))), "links")
    for nearest in (True, False):
        left = unsettled(rest, joined_so_far(edges))
        if left.isEmpty():
            return edges
        rest = left
        edges = stage(edges.union(met(in_blocks(left, bodies, params, nearest))), "links")
    return edges


def jaccard_components(docs: DataFrame, params: JaccardParams = JaccardParams(), key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id) for every row of `docs`."""
    rows = stage(set_rows(docs, params, key), "set_rows")
    sets = (rows.filter("n > 0").groupBy("k1", "k2")
            .agg(F.min(key).alias("first"), F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.col("t").alias("t"))).alias("where"),
                 F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    clash = [r[0] for r in rows.filter("n > 0").select("k1", "k2").distinct().groupBy("k1").count().filter("count > 1").select("k1").limit(params.clashes + 1).collect()]
    if len(clash) > params.clashes:
        raise ValueError("too many sets share short names")
    clashing = np.array(sorted(clash), np.int64)

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            name = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2")], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(short_names(name, clashing)), *b.columns], schema=target)

    schema = T.StructType([T.StructField("num", T.LongType()), *sets.schema.fields])
    target = arrow_schema(schema)
    sets = stage(sets.mapInArrow(shorten, schema), "sets")

    members = stage(shared_parts(part_rows(docs, params, clashing)), "shared_parts")

    # Whole sets of those that have a part in common with another, from the row that names them.
    wanted = sets.join(members.select("num").distinct(), "num", "left_semi").select("num", "n", "sketch", F.col("where.id").alias("w_id"), F.col("where.t").alias("w_t"))
    texts = docs.select(F.col(key).alias("d_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("d_t"))
    met = texts.join(wanted, F.col("d_id").eqNullSafe(F.col("w_id")) & (F.col("d_t") == F.col("w_t"))).select("num", "n", "sketch", "text")

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, h, sizes in hashed_batches(batches, params.width):
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("num"), b.column("n"), b.column("sketch"), lists], names=["num", "n", "sketch", "body"])

    bodies = stage(met.mapInArrow(whole_sets, "num long, n long, sketch binary, body array<long>"), "whole_sets")
    label = components(linked(members, bodies, params)).select(F.col("id").alias("num"), "label")
    named = sets.select("num", "k1", "k2", "first").join(label, "num", "left").withColumn("label", F.coalesce("label", "num"))
    smallest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    of = named.join(smallest, "label").select("k1", "k2", "component_id")
    return rows.filter("n > 0").join(of, ["k1", "k2"]).select(key, F.col("n").alias("n_shingles"), "component_id").union(
        rows.filter("n = 0").select(key, F.col("n").alias("n_shingles"), F.col(key).alias("component_id")))
