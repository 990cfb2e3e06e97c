"""Best-fit packing of token sequences in bulk-synchronous rounds.

`pieces` cuts documents into runs of tokens; `pack` gives every run a place in a sequence of `capacity` tokens.

Runs of over half the capacity open a sequence each. Then, round by round, the runs still without a place and the gaps at
the ends of sequences are range-sorted together by size, largest first, gaps ahead of runs of the same size. Each task sweeps
its own range: a run takes the smallest gap met so far that holds it, and what the gap has left over is open again. At the
end of a range some runs and some gaps are left. Gaps at least as large as the last row of the range hold every run of the
ranges after it; their number and that of the runs (two numbers for each task) settle which ranks of which ranges belong
together, and these pairs meet in a join on the pair's number. A gap takes one run across ranges in a round, so none is
overfilled. Then gaps shrink and the next round begins, in which gaps that hold every run still waiting are dealt to the
ranges in proportion to the tokens waiting there. When no run fits a gap, as many of the largest runs open new
sequences as the tokens left over need at least.

There are as many ranges as rows ask for, so the last few runs take one sweep. A size held by many rows is a range of its
own, dealt to several tasks by id. The state of each
round is written to shared storage. Runs longer than the capacity are refused; zero-length runs get a place like any other.
An empty frame gives an empty result. Null texts count as empty, repeated rows are packed each on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.bpe import encoder, ids_of
from ledgerloom.llm.frames import arrow_schema, stage

GAP, RUN, PAIR, SMALL = 0, 1, 2, 3


def pieces(docs: DataFrame, vocabulary: str, pattern: str, capacity: int, end_id: int = 0, key: str = "doc_id") -> DataFrame:
    """(item, key, piece, start, ids): each document's ids and the end id, cut where longer than `capacity`.

    `item` is unique. `ids` holds unsigned 32-bit little-endian ids. The first piece takes what full pieces leave over.
    """
    schema = T.StructType([T.StructField("item", T.LongType()), docs.schema[key], T.StructField("piece", T.IntegerType()),
                           T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType())])
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, item = encoder(vocabulary, pattern), TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        for b in batches:
            for doc, text in zip(b.column(key), b.column("text")):
                ids = np.append(ids_of(text.as_py() or "", encode), np.uint32(end_id)).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                for piece, start in enumerate([0, *range(first, len(ids), capacity)]):
                    stop = first if piece == 0 else start + capacity
                    rows.append((item, doc.as_py(), piece, start, ids[start:stop].tobytes()))
                    item += 1
                if len(rows) >= 1000:
                    yield as_batch(rows, target)
                    rows = []
        if rows:
            yield as_batch(rows, target)

    return docs.select(key, "text").mapInArrow(run, schema)


def as_batch(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target)


SWEPT = T.StructType(
    [T.StructField("kind", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("size", T.LongType()),
     T.StructField("part", T.IntegerType()), T.StructField("rank", T.LongType()), T.StructField("gap", T.LongType()),
     T.StructField("gap_size", T.LongType())])


def sweep(rows: DataFrame) -> DataFrame:
    """One round's local part: pairs found inside a range, and the runs and gaps left open with their rank in the range.

    Gaps smaller than the last row of their range come back as SMALL: ranges after it may hold larger runs.
    """
    target = arrow_schema(SWEPT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, open_runs, last, out = TaskContext.get().partitionId(), 0, 0, []
        gaps: dict[int, list[int]] = {}
        sizes = 0  # bit s is set if a gap of size s is open
        for b in batches:
            for kind, item, size, last in zip(*(b.column(c).to_pylist() for c in ("kind", "id", "size", "key"))):
                if kind == GAP:
                    gaps.setdefault(size, []).append(item)
                    sizes |= 1 << size
                    continue
                above = sizes >> size
                if not above:
                    out.append((RUN, item, size, part, open_runs, None, None))
                    open_runs += 1
                    continue
                found = size + (above & -above).bit_length() - 1
                gap = gaps[found].pop()
                if not gaps[found]:
                    sizes ^= 1 << found
                out.append((PAIR, item, size, part, None, gap, found))
                if found > size:
                    gaps.setdefault(found - size, []).append(gap)
                    sizes |= 1 << (found - size)
            if out:
                yield as_batch(out, target)
                out = []
        rank = 0
        for size in sorted((s for s, ids in gaps.items() if ids), reverse=True):
            for gap in gaps[size]:
                kind = GAP if size >= last else SMALL
                out.append((kind, gap, size, part, rank if kind == GAP else None, None, None))
                rank += 1
            if len(out) > 10_000:
                yield as_batch(out, target)
                out = []
        if out:
            yield as_batch(out, target)

    return (rows.repartitionByRange("range", "share").sortWithinPartitions(F.desc("key"), F.asc("kind"), F.asc("id"))
            .drop("range", "share").mapInArrow(run, SWEPT))


def ranges_of(rows: DataFrame, range_rows: int) -> DataFrame:
    """`rows` with the `range` of sizes they belong to, the largest first, and their `share` of it.

    Ranges hold about `range_rows` rows, more if there would be more ranges than shuffle partitions. A size with more rows
    than that is a range of its own, cut into shares by a hash of the id. Sizes are whole numbers up to the capacity, so
    counting them takes that many rows at most.
    """
    counts = sorted(((r["key"], r["count"]) for r in rows.groupBy("key").count().collect()), reverse=True)
    limit = max(range_rows, -(-sum(n for _, n in counts) // int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    edges, shares, held, last = [], [], 0, 0
    for key, n in counts:
        if shares and held + n > limit:
            edges.append(last)
            held = 0
        if not held:
            shares.append(-(-n // limit))
        held += n
        last = key
    at = F.size(F.filter(F.array(*(F.lit(e).cast("long") for e in edges)), lambda e: F.col("key") < e)) if edges else F.lit(0)
    share = F.element_at(F.array(*(F.lit(s) for s in shares or [1])), F.col("range") + 1)
    return rows.withColumn("range", at).withColumn("share", F.pmod(F.xxhash64("id"), share))


def settle(left: dict[int, tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Which open runs of a range take which open gaps of a range before it.

    `left`: {range: (open runs, open gaps)}. Returns (run range, first run rank, gap range, last gap rank, count): run
    ranks go up while gap ranks go down from the last.
    """
    stack: list[list[int]] = []
    found = []
    for part in sorted(left):
        runs, gaps = left[part]
        taken = 0
        while taken < runs and stack:
            source, count = stack[-1]
            n = min(runs - taken, count)
            found.append((part, taken, source, count - 1, n))
            taken += n
            stack[-1][1] -= n
            if not stack[-1][1]:
                stack.pop()
        if gaps:
            stack.append([part, gaps])
    return found


def dealt(gaps: DataFrame, waiting: list[tuple[int, int, int]], shares: int = 64) -> DataFrame:
    """Gaps with the size (`key`) they are sorted by: their own, or for those that hold every waiting run, one of the
    largest sizes of the ranges (`waiting`: range, tokens, largest size), as often as the range's share of tokens.
    """
    total = sum(t for _, t, _ in waiting)
    tops, upto, k = [], 0, 0
    for _, tokens, top in sorted(waiting):
        upto += tokens
        while k < shares and (k + 0.5) * total <= upto * shares:
            tops.append(top)
            k += 1
    most = max(top for _, _, top in waiting)
    tops += [most] * (shares - len(tops))
    pick = F.element_at(F.array(*(F.lit(t).cast("long") for t in tops)), (F.pmod(F.xxhash64("id"), F.lit(shares)) + 1).cast("int"))
    return gaps.select("id", "size", F.when(F.col("size") >= most, pick).otherwise(F.col("size")).alias("key"))


def numbered_pairs(swept: DataFrame, kind: int, spans: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """Open rows of one kind with the number of their pair, null where they have none. Spans: at most two for each task."""
    base, by_part = 0, {}
    for run_part, first, gap_part, last, n in spans:
        own = (first, first + n, base, 1) if kind == RUN else (last - n + 1, last + 1, base + n - 1, -1)
        by_part.setdefault(run_part if kind == RUN else gap_part, []).append(own)
        base += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("part", "rank"))
            pair = np.full(b.num_rows, -1, np.int64)
            for p in np.unique(part):
                for low, high, at, step in by_part.get(int(p), ()):
                    hit = (part == p) & (rank >= low) & (rank < high)
                    pair[hit] = at + step * (rank[hit] - low)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "size", "part", "rank")), pa.array(pair)],
                                             names=["id", "size", "part", "rank", "pair"])

    return (swept.filter(F.col("kind") == kind).select("id", "size", "part", "rank")
            .mapInArrow(run, "id long, size long, part int, rank long, pair long"))


def pack(lengths: DataFrame, capacity: int, range_rows: int = 20_000, max_rounds: int = 100_000) -> DataFrame:
    """(item, sequence_id, offset) for every row of `lengths` (item: unique long, length: long)."""
    rows = lengths.select(F.col("item").alias("id"), F.col("length").alias("size"))
    if not rows.filter(F.col("size") > capacity).isEmpty():
        raise ValueError("a run is longer than the capacity")
    opens = F.col("size") * 2 > capacity
    placed = [rows.filter(opens).select("id", F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    runs = rows.filter(~opens)
    gaps = rows.filter(opens & (F.col("size") < capacity)).select("id", (F.lit(capacity) - F.col("size")).alias("size"))
    gaps = gaps.withColumn("key", F.col("size"))
    for _ in range(max_rounds):
        rows = runs.select(F.lit(RUN).alias("kind"), "id", "size", F.col("size").alias("key")).union(
            gaps.select(F.lit(GAP).alias("kind"), "id", "size", "key"))
        swept = stage(sweep(ranges_of(rows, range_rows)), "swept")
        counts = swept.groupBy("kind", "part").agg(F.count("*").alias("n"), F.sum("size").alias("tokens"), F.min("size").alias("least"),
                                                  F.max("size").alias("most")).collect()
        if not any(c["kind"] in (RUN, PAIR) for c in counts):
            break
        left: dict[int, tuple[int, int]] = {}
        for c in counts:
            r, g = left.get(c["part"], (0, 0))
            left[c["part"]] = (c["n"], g) if c["kind"] == RUN else (r, c["n"]) if c["kind"] == GAP else (r, g)
        spans = settle(left)
        if any(c["kind"] == PAIR for c in counts):
            placed.append(swept.filter(F.col("kind") == PAIR).select(
                "id", F.col("gap").alias("sequence_id"), (F.lit(capacity) - F.col("gap_size")).alias("offset")))
        waiting = [c for c in counts if c["kind"] == RUN]
        ranges = [(c["part"], c["tokens"], c["most"]) for c in waiting]
        if not waiting:
            break
        if spans or any(c["kind"] in (PAIR, SMALL) for c in counts):
            gaps = swept.filter(F.col("kind") == SMALL).select("id", "size")
            if spans:
                open_runs, open_gaps = numbered_pairs(swept, RUN, spans), numbered_pairs(swept, GAP, spans)
                pairs = open_runs.filter("pair >= 0").select("id", "size", "pair").join(
                    open_gaps.filter("pair >= 0").select(F.col("id").alias("gap"), F.col("size").alias("gap_size"), "pair"), "pair")
                placed.append(pairs.select("id", F.col("gap").alias("sequence_id"), (F.lit(capacity) - F.col("gap_size")).alias("offset")))
                runs = open_runs.filter("pair < 0").select("id", "size")
                gaps = gaps.union(open_gaps.filter("pair < 0").select("id", "size")).union(
                    pairs.select(F.col("gap").alias("id"), (F.col("gap_size") - F.col("size")).alias("size")))
            else:
                runs = swept.filter(F.col("kind") == RUN).select("id", "size")
                gaps = gaps.union(swept.filter(F.col("kind") == GAP).select("id", "size"))
            # A gap smaller than every run that is left can take none, now or later.
            gaps = dealt(gaps.filter(F.col("size") >= min(c["least"] for c in waiting)), ranges)
            continue
        # No gap takes any run: the largest runs open sequences.
        new = max(1, -(-sum(c["tokens"] for c in waiting) // capacity))
        ahead, offsets = 0, []
        for c in sorted(waiting, key=lambda c: c["part"]):
            offsets.append((c["part"], ahead))
            ahead += c["n"]
        order = F.col("rank") + F.create_map(*(F.lit(x) for pair in offsets for x in pair))[F.col("part")]
        ranked = swept.filter(F.col("kind") == RUN).select("id", "size", (order < new).alias("first"))
        placed.append(ranked.filter("first").select("id", F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
        gaps = dealt(ranked.filter("first").select("id", (F.lit(capacity) - F.col("size")).alias("size")).filter("size > 0"), ranges)
        runs = ranked.filter("not first").select("id", "size")
    else:
        raise RuntimeError(f"packing did not end in {max_rounds} rounds")
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return out.withColumnRenamed("id", "item")
