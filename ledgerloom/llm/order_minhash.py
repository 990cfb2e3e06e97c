"""Document fingerprints by order MinHash.

The k-mers of a text are its runs of `k` words (the last ones shorter). The i-th occurrence of a k-mer counts as a k-mer of
its own, so repeats weigh in. Each of `size` permutations of the hashes picks the `picks` smallest; these are put back into
text order and hashed as a tuple. Two texts agree in an entry if the same k-mers are smallest in both and stand in the same
order there, so the share of equal entries falls with the edit distance, and with moved passages as well as with changed words.

The permutations turn the circle of hash values by fixed amounts: the smallest values are those that follow a fixed point.
The numbered hashes are sorted once for all of them, and each point is found by halving; no k-mer is compared with every point.

Everything is an expression on the row: no shuffle, and texts of equal content have equal fingerprints. Null and empty texts, and
texts of white space only, have no k-mers and an all-zero fingerprint. Native: SQL functions only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POSITION_BITS = 26
SPACE = " \t\n\x0b\f\r"


@dataclass(frozen=True)
class OMHParams:
    k: int = 2
    picks: int = 2
    size: int = 32


def halvings(n: Column) -> Column:
    """Powers of two from the largest at most n down to 1."""
    top = F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double"))).cast("int")
    return F.transform(F.sequence(top, F.lit(0)), lambda b: F.pow(F.lit(2.0), b.cast("double")).cast("int"))


def lower_bound(values: Column, n: Column, powers: Column, least: Column) -> Column:
    """How many of the n ascending values are smaller than `least`."""
    return F.aggregate(powers, F.lit(0), lambda at, step: F.when(
        (at + step <= n) & (F.get(values, at + step - 1) < least), at + step).otherwise(at))


def hash_of(packed: Column) -> Column:
    return F.shiftright(packed, POSITION_BITS)


def place_of(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit((1 << POSITION_BITS) - 1))


def pack(hashed: Column, place: Column) -> Column:
    """A hash in the upper bits, where it stands in the text in the lower ones: order by hash, then by place."""
    return F.shiftleft(F.shiftright(hashed, POSITION_BITS), POSITION_BITS).bitwiseOR(
        place.cast("long").bitwiseAND(F.lit((1 << POSITION_BITS) - 1)))


def with_fingerprint(df: DataFrame, text: str, out: str, params: OMHParams = OMHParams()) -> DataFrame:
    """`df` with the fingerprint of column `text` as an array of `size` numbers in column `out`."""
    t = [f"_{out}_{x}" for x in ("words", "kmers", "sorted", "numbered", "final")]
    words, kmers, runs, numbered, final = (F.col(x) for x in t)
    trimmed = F.trim(F.coalesce(F.col(text), F.lit("")), F.lit(SPACE))
    df = df.withColumn(t[0], F.split(trimmed, f"[{SPACE}]+"))
    df = df.withColumn(t[1], F.when(F.get(words, F.lit(0)) == "", F.lit(None)).otherwise(F.transform(
        words, lambda w, i: pack(F.xxhash64(w, *(F.get(words, i + j) for j in range(1, params.k))), i))))
    df = df.withColumn(t[2], F.sort_array(F.coalesce(kmers, F.array().cast("array<bigint>"))))
    n = F.size(runs)
    df = df.withColumn(f"_{out}_steps", halvings(n))
    steps = F.col(f"_{out}_steps")

    def number(x: Column, i: Column) -> Column:
        # Equal k-mers stand together in text order. How many of them are ahead of this one is found by halving, too.
        same = lambda back: (back <= i) & (hash_of(F.get(runs, i - back)) == hash_of(x))
        ahead = F.aggregate(steps, F.lit(0), lambda d, step: F.when(same(d + step), d + step).otherwise(d))
        return F.when((i > 0) & same(F.lit(1)), pack(F.xxhash64(hash_of(x), ahead), place_of(x))).otherwise(x)

    df = df.withColumn(t[3], F.transform(runs, number)).withColumn(t[4], F.sort_array(numbered))

    def entry(j: Column) -> Column:
        start = lower_bound(final, n, steps, pack(F.xxhash64(F.lit("point"), j), F.lit(0)))
        picked = F.transform(F.sequence(F.lit(0), F.lit(params.picks - 1)), lambda r: F.get(final, F.pmod(start + r, n)))
        in_text = F.sort_array(F.transform(picked, lambda x: F.struct(place_of(x).alias("p"), hash_of(x).alias("h"))))
        return F.xxhash64(F.transform(in_text, lambda x: x["h"]))

    signature = F.transform(F.sequence(F.lit(0), F.lit(params.size - 1)), entry)
    empty = F.array_repeat(F.lit(0).cast("long"), params.size)
    return df.withColumn(out, F.when(n > 0, signature).otherwise(empty)).drop(*t, f"_{out}_steps")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal entries of two fingerprints."""
    same = F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)
    return F.size(same) / F.size(a)


def as_text(fingerprint: Column) -> Column:
    """The low 32 bits of every entry in hex."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def with_next(docs: DataFrame, columns: list[str], derive: Callable[[DataFrame], DataFrame], key: str = "doc_id", tie: str = "text") -> DataFrame:
    """`derive(docs)` with `next_<column>` of the next row by `key`; the last row's next is the first row.

    Rows are dealt to ranges of ids by quantiles of the ids (as many as there are shuffle partitions), so no task sorts
    everything. The first row of every range is copied to the end of the range before it. Rows of one id stay in one
    range, ordered by a hash of `tie`.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = [i / parts for i in range(1, parts)] or [0.5]
    edges = sorted(set(docs.agg(F.percentile_approx(key, share, 10_000)).first()[0] or []))
    n = len(edges)
    if n:
        cut = F.array(*(F.lit(e) for e in edges))
        powers = F.array(*(F.lit(1 << b) for b in range(n.bit_length() - 1, -1, -1)))
        block = F.coalesce(F.aggregate(powers, F.lit(0), lambda at, step: F.when(
            (at + step <= n) & (F.get(cut, at + step - 1) <= F.col(key)), at + step).otherwise(at)), F.lit(0))
    else:
        block = F.lit(0)
    rows = docs.withColumn("__tie", F.xxhash64(tie)).withColumn("__block", block).withColumn("__copy", F.lit(0))
    heads = sorted(((r["__block"], r["h"][key], r["h"]["__tie"]) for r in rows.groupBy("__block").agg(
        F.min(F.struct(F.col(key).isNotNull().alias("has"), key, "__tie")).alias("h")).collect()), key=lambda h: h[0])
    if heads:
        before = [heads[-1][0], *(b for b, _, _ in heads[:-1])]
        wanted = spark.createDataFrame([(h, t, b, to) for (b, h, t), to in zip(heads, before)],
                                       f"_key {docs.schema[key].dataType.simpleString()}, _t long, _b int, _to int")
        copies = (rows.join(F.broadcast(wanted), F.col(key).eqNullSafe(F.col("_key")) & (F.col("__tie") == F.col("_t")) & (F.col("__block") == F.col("_b")))
                  .withColumn("__block", F.col("_to")).withColumn("__copy", F.lit(1)).select(*rows.columns).dropDuplicates([key, "__tie", "__block"]))
        rows = rows.unionByName(copies)
    order = Window.partitionBy("__block").orderBy("__copy", F.asc_nulls_first(key), "__tie")
    return (derive(rows).select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns))
            .filter("__copy = 0").drop("__tie", "__block", "__copy"))


def edited(text: Column, other: Column) -> Column:
    """`text` with its last quarter replaced by as much of the start of `other`."""
    n = F.length(text)
    quarter = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - quarter), F.substring(other, F.lit(1), quarter))
