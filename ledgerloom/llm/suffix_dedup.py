"""Removal of byte strings that occur twice, by suffix arrays sorted in two stages.

A byte goes if it lies in a string of `length` bytes that starts anywhere else too, in the same text or another. Strings are
judged on the input and never span texts.

Every string of `length` bytes is sent to where it can meet its equals, without sending strings: its anchor is the smallest
hash of the `gram`-byte strings inside it, which equal strings share. Neighbouring strings mostly have the same anchor, so a
text falls into runs of string starts with one anchor each, about one for every (length - gram) / 2 bytes. Then:

1. Runs are counted by anchor. An anchor met in one run, and once in it, holds no repeat. If all runs of an anchor cover the same bytes (same
   digest), all their strings repeat. These counts are partial aggregates, so thousands of copies cost a row per task.
2. An anchor with runs of different bytes (copies end or differ nearby) needs its bytes: one run for each digest, joined with
   its text. Whole groups of an anchor meet in a task, about `bundle` bytes at a time, and their strings are put into suffix order:
   first, starts whose suffix is smaller than its successor are sorted directly; the rest are induced by scanning the
   buckets of first bytes in order, for a suffix larger than its successor comes after it. Neighbours in that order whose
   common prefix reaches `length` bytes repeat.
3. Groups of more than `most` different runs are not brought together. Their strings are counted by a 128-bit hash, one row
   for each start, so a passage in any number of surroundings is spread over all tasks.
4. Ranges of repeated starts are gathered by text (not by document) and cut from every document with that text.

Null and empty texts have nothing to remove. Repeated rows count as copies. Ids are carried, not used to tell texts apart, so
null and repeated ids are fine. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.frames import arrow_schema, pieces, stage


@dataclass(frozen=True)
class SuffixParams:
    length: int = 400
    gram: int = 128
    run: int = 2048
    bundle: int = 2 << 20
    most: int = 3000


def gram_hashes(x: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the `gram` bytes from every position; `gram` is a power of two, 8 at least."""
    h = np.ndarray((len(x) - 7,), "<u8", x.tobytes(), strides=(1,)) * np.uint64(0x9E3779B97F4A7C15)
    width = 8
    while width < gram:
        h = h[:-width] * np.uint64(0xC2B2AE3D27D4EB4F) + (h[width:] ^ (h[width:] >> np.uint64(29)))
        width *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Smallest of `width` values from every position."""
    out, have = h, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def runs_of(raw: bytes, p: SuffixParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First start, number of starts and anchor of every run of a text, and whether its anchor is in it twice."""
    h, wide = gram_hashes(np.frombuffer(raw, np.uint8), p.gram), p.length - p.gram + 1
    low = sliding_min(h, wide)
    first = np.r_[0, np.flatnonzero(low[1:] != low[:-1]) + 1]
    size = np.diff(np.r_[first, len(low)])
    if (size > p.run).any():
        # A periodic text keeps one anchor; its run is cut at multiples of `run` from where it begins.
        parts = -(-size // p.run)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        size = np.minimum(np.repeat(size, parts) - step * p.run, p.run)
        first = np.repeat(first, parts) + step * p.run
    anchor = low[first]
    again = np.array([np.count_nonzero(h[a:a + n + wide - 1] == m) > 1 for a, n, m in zip(first.tolist(), size.tolist(), anchor)])
    return first, size, anchor.view(np.int64), again


def text_key(text="text") -> list:
    """128 bits that stand for a text."""
    raw = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(raw).alias("t1"), F.xxhash64(F.lit(1), raw).alias("t2")]


def runs(docs: DataFrame, p: SuffixParams) -> DataFrame:
    """(t1, t2, start, size, anchor, digest, again) for every run of every row."""
    names = "t1 long, t2 long, start long, size long, anchor long, digest long, again boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 4 << 20):
            found: list[list[np.ndarray]] = [[] for _ in range(7)]
            for t1, t2, raw in zip(b.column("t1").to_pylist(), b.column("t2").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                if raw is None or len(raw) < p.length:
                    continue
                first, size, anchor, again = runs_of(raw, p)
                digest = np.array([xxhash.xxh3_64_intdigest(raw[s:s + n + p.length - 1]) for s, n in zip(first.tolist(), size.tolist())], np.uint64).view(np.int64)
                for to, x in zip(found, (np.full(len(first), t1), np.full(len(first), t2), first, size, anchor, digest, again)):
                    to.append(x)
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in found], names=["t1", "t2", "start", "size", "anchor", "digest", "again"])

    return docs.select(*text_key(), "text").mapInArrow(run, names)


def smaller_than_next(chars: np.ndarray) -> np.ndarray:
    """Which suffixes of a text are smaller than the suffix after them (the last one is not: the end is smaller)."""
    n = len(chars)
    ahead = np.append(chars[1:], -1)
    differs = np.flatnonzero(chars != ahead)
    decide = differs[np.searchsorted(differs, np.arange(n))]
    return chars[decide] < ahead[decide]


def sorted_places(words: np.ndarray, places: np.ndarray, left: np.ndarray, length: int) -> np.ndarray:
    """`places` of a buffer in the order of the `length` bytes from each; of equal ones, those with fewer bytes `left` come first.

    `words`: the eight bytes from every place as a number. Places are put in order by their first word, then groups of equal
    ones by the next, so no string is copied.
    """
    x = words[places].astype(np.uint64)
    rank = np.argsort(x, kind="stable")
    order, left, x = places[rank], np.minimum(left[rank], length), x[rank]
    new = np.r_[True, x[1:] != x[:-1]][:len(order)]
    for k in [*range(8, length, 8), None]:
        live = np.flatnonzero(~(new & np.r_[new[1:], True]))
        if not len(live):
            break
        x = left[live].astype(np.uint64) if k is None else words[order[live] + k].astype(np.uint64)
        head = new[live]
        group = np.cumsum(head) - 1
        mixed = np.zeros(group[-1] + 1, bool)
        mixed[group[1:][(x[1:] != x[:-1]) & ~head[1:]]] = True
        pick = mixed[group]
        at, x, group = live[pick], x[pick], group[pick]
        rank = np.lexsort((x, group))
        order[at], left[at] = order[at[rank]], left[at[rank]]
        x = x[rank]
        new[at[1:]] |= (x[1:] != x[:-1]) & (group[1:] == group[:-1])
    return order


BYTE_STEPS = np.uint64(1) << np.arange(8, 64, 8, dtype=np.uint64)


def common_prefixes(words: np.ndarray, order: np.ndarray, length: int, block: int = 1 << 16) -> np.ndarray:
    """How many bytes, `length` at most, each place of `order` has in common with the place before it."""
    out = np.zeros(len(order), np.int32)
    for lo in range(1, len(order), block):
        b = order[lo:lo + block]
        a, got, live = order[lo - 1:lo - 1 + len(b)], out[lo:lo + block], np.arange(len(b))
        for k in range(0, length, 8):
            x = words[a[live] + k].astype(np.uint64) ^ words[b[live] + k].astype(np.uint64)
            got[live] += np.where(x == 0, 8, 7 - np.searchsorted(BYTE_STEPS, x, side="right")).astype(np.int32)
            live = live[x == 0]
            if not len(live):
                break
    return np.minimum(out, length)


def repeated_starts(texts: list[bytes], sizes: list[int], length: int) -> list[np.ndarray]:
    """For each text, which of its first `size` starts begin a string of `length` bytes that also starts elsewhere.

    Everything is a place in one buffer, in which `length` + 8 zeros follow each text; nothing is kept for a place but a few
    numbers.
    """
    gap = bytes(length + 8)
    buffer = b"".join(x for raw in texts for x in (raw, gap))
    bases = np.cumsum([0] + [len(raw) + len(gap) for raw in texts[:-1]])
    chars = np.frombuffer(buffer, np.uint8)
    words = np.ndarray((len(buffer) - 7,), ">u8", buffer, strides=(1,))
    smaller, wanted, opens = (np.zeros(len(buffer), bool) for _ in range(3))
    opens[bases] = True
    direct, left, ends = [], [], [[] for _ in range(256)]
    for base, raw, size in zip(bases.tolist(), texts, sizes):
        s = smaller_than_next(np.frombuffer(raw, np.uint8).astype(np.int16))
        # Starts up to the first one, from the last string on, that is sorted directly: it induces those before it. If there
        # is none, the end of the text does.
        after = np.flatnonzero(s[size - 1:])
        n = size + int(after[0]) if len(after) else len(raw)
        if not len(after):
            ends[raw[-1]].append(base + n - 1)
        at = np.flatnonzero(s[:n])
        direct.append((base + at).astype(np.int32))
        left.append((len(raw) - at).astype(np.int32))
        smaller[base + at] = True
        wanted[base:base + size] = True
    # Stage one: the direct ones, by their bytes.
    direct = sorted_places(words, np.concatenate(direct), np.concatenate(left), length)
    edge = np.searchsorted(chars[direct], np.arange(257))
    buckets: list[list[np.ndarray]] = [[np.array(e, np.int32)] if e else [] for e in ends]
    order = []
    for c in range(256):
        # Stage two: what earlier buckets have put here, then what that puts into its own bucket, then the direct ones.
        whole, last = buckets[c], np.concatenate(buckets[c]) if buckets[c] else np.zeros(0, np.int32)
        while len(last):
            q = last[~opens[last]] - 1
            last = q[~smaller[q] & (chars[q] == c)]
            whole.append(last)
        whole = np.concatenate([*whole, direct[edge[c]:edge[c + 1]]])
        buckets[c] = []
        order.append(whole[wanted[whole]])
        q = whole[~opens[whole]] - 1
        q = q[~smaller[q] & (chars[q] > c)]
        if len(q):
            q = q[np.argsort(chars[q], kind="stable")]
            letters, starts = np.unique(chars[q], return_index=True)
            for letter, part in zip(letters.tolist(), np.split(q, starts[1:])):
                buckets[letter].append(part)
    order = np.concatenate(order)
    same = common_prefixes(words, order, length) >= length
    hit = np.zeros(len(buffer), bool)
    hit[order[same | np.r_[same[1:], False]]] = True
    return [hit[base:base + size] for base, size in zip(bases.tolist(), sizes)]


def spans(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, count) of the runs of True."""
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return [(int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2])]


RANGES = "t1 long, t2 long, start long, size long"


def sorted_repeats(groups: DataFrame, p: SuffixParams) -> DataFrame:
    """Ranges of repeated starts of the single runs; `groups` holds whole groups of an anchor, partitioned and sorted by it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0

        def solve() -> Iterator[pa.RecordBatch]:
            distinct = {(r["anchor"], r["digest"]): r for r in held}
            rows = list(distinct.values())
            found = []
            for r, flags in zip(rows, repeated_starts([r["bytes"] for r in rows], [r["size"] for r in rows], p.length)):
                if r["single"]:
                    found += [(r["t1"], r["t2"], r["start"] + a, n) for a, n in spans(flags)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["t1", "t2", "start", "size"])

        for b in pieces(batches, "bytes", p.bundle):
            for r in b.to_pylist():
                if size >= p.bundle and r["anchor"] != held[-1]["anchor"]:
                    yield from solve()
                    held, size = [], 0
                held.append(r)
                size += len(r["bytes"])
        if held:
            yield from solve()

    return groups.mapInArrow(run, RANGES)


def counted_repeats(groups: DataFrame, p: SuffixParams) -> DataFrame:
    """The same for groups of any size: every string by its hash, counted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "bytes", p.bundle):
            for r in b.to_pylist():
                raw = r["bytes"]
                digests = [xxhash.xxh3_128_intdigest(raw[k:k + p.length]) for k in range(r["size"])]
                n = len(digests)
                halves = [np.array([(d >> s) & (2 ** 64 - 1) for d in digests], np.uint64).view(np.int64) for s in (0, 64)]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(h) for h in halves), *(pa.array(np.full(n, r[k])) for k in ("t1", "t2")), pa.array(r["start"] + np.arange(n)), pa.array(np.full(n, r["single"]))],
                    names=["h1", "h2", "t1", "t2", "start", "single"])

    every = groups.mapInArrow(run, "h1 long, h2 long, t1 long, t2 long, start long, single boolean")
    twice = every.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1")
    return every.join(twice, ["h1", "h2"]).filter("single").select("t1", "t2", "start", F.lit(1).cast("long").alias("size"))


def repeats(docs: DataFrame, p: SuffixParams = SuffixParams(), key: str = "doc_id") -> DataFrame:
    """(t1, t2, start, size): ranges of starts of repeated strings, by text."""
    met = stage(runs(docs, p).groupBy("t1", "t2", "start", "size", "anchor", "digest", "again").agg(F.count("*").alias("n")), "runs")
    shared = (met.groupBy("anchor").agg(F.sum("n").alias("times"), F.min("digest").alias("low"), F.max("digest").alias("high"), F.max("again").alias("twice"))
              .filter("times > 1 or twice").select("anchor", (F.expr("times > 1") & (F.col("low") == F.col("high"))).alias("pure")))
    near = stage(met.drop("again").join(shared, "anchor"), "shared_runs")
    mixed = near.filter("not pure").withColumn("rank", F.xxhash64("t1", "t2", "start"))
    by_digest = mixed.groupBy("anchor", "digest").agg(F.sum("n").alias("times"), F.min("rank").alias("rank"))
    by_anchor = by_digest.groupBy("anchor").agg(F.count("*").alias("kinds"))
    chosen = stage(mixed.drop("rank", "n").withColumn("rank", F.xxhash64("t1", "t2", "start"))
                   .join(by_digest.withColumnRenamed("rank", "least"), ["anchor", "digest"])
                   .join(by_anchor, "anchor")
                   .select("t1", "t2", "start", "size", "anchor", "digest", (F.col("times") == 1).alias("single"),
                           (F.col("rank") == F.col("least")).alias("stands"), "kinds"), "mixed_runs")
    whole = near.filter("pure").select("t1", "t2", "start", "size").union(chosen.filter("not single").select("t1", "t2", "start", "size"))
    wanted = chosen.filter("stands").groupBy("t1", "t2").agg(
        F.collect_list(F.struct("start", "size", "anchor", "digest", "single", "kinds")).alias("wanted"))
    # One document for each text is enough to read the bytes from.
    first = docs.select(key, *text_key()).groupBy("t1", "t2").agg(F.min(key).alias("_first"))
    texts = docs.select(F.col(key).alias("_key"), "text", *text_key())
    lists = wanted.join(first, ["t1", "t2"])
    cut = texts.join(lists, ["t1", "t2"]).filter(F.col("_key").eqNullSafe(F.col("_first"))).select("t1", "t2", "text", "wanted")
    groups = slices(cut, p)
    small = groups.filter(F.col("kinds") <= p.most).drop("kinds").repartition("anchor").sortWithinPartitions("anchor", "digest")
    found = whole.union(sorted_repeats(small, p))
    if not chosen.filter(F.col("kinds") > p.most).isEmpty():
        found = found.union(counted_repeats(groups.filter(F.col("kinds") > p.most).drop("kinds"), p))
    return found


def slices(cut: DataFrame, p: SuffixParams) -> DataFrame:
    """The bytes of the wanted runs."""
    schema = T.StructType([T.StructField(n, t) for n, t in (
        ("t1", T.LongType()), ("t2", T.LongType()), ("start", T.LongType()), ("size", T.LongType()), ("anchor", T.LongType()),
        ("digest", T.LongType()), ("single", T.BooleanType()), ("kinds", T.LongType()), ("bytes", T.BinaryType()))])
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 2 << 20):
            rows = []
            for t1, t2, raw, wanted in zip(*(b.column(c).to_pylist() for c in ("t1", "t2")), b.column("text").cast(pa.binary()).to_pylist(), b.column("wanted").to_pylist()):
                for w in wanted:
                    rows.append((t1, t2, w["start"], w["size"], w["anchor"], w["digest"], w["single"], w["kinds"],
                                 raw[w["start"]:w["start"] + w["size"] + p.length - 1]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target)

    return cut.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, p: SuffixParams = SuffixParams(), key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, spans, kept): spans of removed bytes as (start, size), and the remaining bytes."""
    found = stage(repeats(docs, p, key), "repeats")
    lists = found.groupBy("t1", "t2").agg(F.collect_list(F.struct("start", "size")).alias("ranges"))
    rows = docs.select(key, "text", *text_key()).join(lists, ["t1", "t2"], "left").select(key, "text", "ranges")
    schema = T.StructType([docs.schema[key], *T.StructType.fromDDL("n_bytes long, spans array<struct<start: long, size: long>>, kept binary").fields])
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 4 << 20):
            out = []
            for raw, ranges in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("ranges").to_pylist()):
                raw, gone = raw or b"", []
                if ranges:
                    edge = np.zeros(len(raw) + 1, np.int64)
                    np.add.at(edge, [r["start"] for r in ranges], 1)
                    np.add.at(edge, [r["start"] + r["size"] + p.length - 1 for r in ranges], -1)
                    gone = spans(np.cumsum(edge[:-1]) > 0)
                kept, at = [], 0
                for a, n in gone:
                    kept.append(raw[at:a])
                    at = a + n
                out.append((len(raw), [{"start": a, "size": n} for a, n in gone], b"".join(kept) + raw[at:]))
            yield pa.RecordBatch.from_arrays([b.column(key).cast(target[0].type), *(pa.array(c, f.type) for c, f in zip(zip(*out), list(target)[1:]))], schema=target)

    return rows.mapInArrow(run, schema)
