"""Quality rules: an isolation forest on rule statistics.

Each tree splits `subsample` rows at random values of random statistics. Rows that differ from the bulk end up alone
after few splits; the mean path length over the trees, scaled by the mean path of a search in a tree of that size, gives an
anomaly score between 0 and 1. Every tree draws its own `subsample` rows, as the method has it, from all labelled good rows; split
values are drawn from the span of all labelled rows, so that a statistic on which good rows agree still sets others apart. The
threshold is the score that best separates all labelled good from all bad rows, but not below the `keep` quantile of the good ones.

Learning has no bound on labelled rows: they are measured and scored where they lie, draws are merged by tree, trees grow in
tasks of their own, and the threshold comes from running totals over the ordered scores. The driver gets the trees and a few numbers.

Rows that fail the base rules (fewer than `min_words` words, or more than `max_repeat` percent of words in repeated
windows) are out whatever the forest says. Every other row is judged on its whole text.

Null texts have no words and so fail the base rules. Without labelled rows the forest is empty and only the base rules
count. Repeated rows are judged one by one; an empty table stays empty; other columns are carried along.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.frames import arrow_schema, numbered, pieces, scratch, stage
from ledgerloom.llm.quality_fm import label_means, texts_of
from ledgerloom.llm.textstats import RATES, profile, rates

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
# Rates that tell junk from text in any language and at any length.
USED = ["word_length", "upper", "digit", "symbol", "mark", "stop", "other", "control", "dup_lines", "repeat_words",
        "distinct_gap", "space"]


@dataclass(frozen=True)
class ForestParams:
    trees: int = 200
    subsample: int = 256
    keep: float = 0.99
    min_words: int = 10
    max_repeat: int = 20
    seed: int = 11


def signals(p: dict) -> list[float]:
    r = dict(zip(RATES, rates(p)))
    # Distinct words fall with length; what is left after the usual fall tells repetition.
    r["distinct_gap"] = r["distinct"] - 1.02 + 0.04 * r["log_words"]
    # Square roots of the rates: most lie near zero, and split values are drawn evenly.
    return [float(np.sqrt(abs(r[k])) * np.sign(r[k])) for k in USED]


def mean_search(n: np.ndarray) -> np.ndarray:
    """Mean path of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class IsolationForest:
    params: ForestParams
    # One array per tree over its nodes: column, split value, left child (right is next), depth plus rest at leaves.
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    size: int = 0
    threshold: float = 2.0

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        if not self.trees or not len(x):
            return np.zeros(len(x))
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for column, value, left, path in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                c = column[at]
                inner = c >= 0
                if not inner.any():
                    break
                go = left[at] + (x[rows, np.maximum(c, 0)] >= value[at])
                at = np.where(inner, go, at)
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / max(float(mean_search(self.size)), 1e-9))


def base_failed(n_words, n_repeat, params: ForestParams):
    return (n_words < params.min_words) | (100 * n_repeat > params.max_repeat * n_words)


def grown(rows: np.ndarray, low: np.ndarray, high: np.ndarray, seed: list[int]) -> tuple[np.ndarray, ...]:
    """A tree over `rows`; splits fall in the box `low`..`high`, which bad rows span too."""
    rng = np.random.default_rng(seed)
    limit, spread = 2 * int(np.ceil(np.log2(max(len(rows), 2)))), np.flatnonzero(high > low)
    column, value, left, path = [-1], [0.0], [0], [0.0]
    todo = [(0, rows, low, high, 0)]
    while todo:
        node, rows, a, b, depth = todo.pop()
        c = int(rng.choice(spread))
        if depth >= limit or len(rows) < 2:
            path[node] = depth + float(mean_search(len(rows)))
            continue
        cut = rng.uniform(a[c], b[c])
        column[node], value[node], left[node] = c, cut, len(column)
        below, above = b.copy(), a.copy()
        below[c] = above[c] = cut
        for part, p, q in ((rows[rows[:, c] < cut], a, below), (rows[rows[:, c] >= cut], above, b)):
            todo.append((len(column), part, p, q, depth + 1))
            column.append(-1), value.append(0.0), left.append(0), path.append(0.0)
    return np.array(column), np.array(value), np.array(left), np.array(path)


def keys_by_tree(h: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """One pseudo-random key per row (hash `h`) and tree."""
    k = h.astype(np.uint64)[:, None] + np.uint64(0x9E3779B97F4A7C15) * (np.arange(trees, dtype=np.uint64) + np.uint64(seed * trees + 1))
    k = (k ^ (k >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    k = (k ^ (k >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return k ^ (k >> np.uint64(31))


def first_of(tree: np.ndarray, key: np.ndarray, size: int) -> np.ndarray:
    """Places of the `size` smallest keys of every tree."""
    order = np.lexsort((key, tree))
    ordered = tree[order]
    return order[np.arange(len(order)) - np.searchsorted(ordered, ordered) < size]


def trees_of(good: DataFrame, params: ForestParams, low: np.ndarray, high: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Trees over the good rows; a tree takes the rows whose keys for it are smallest, however rows lie in tasks."""
    size = params.subsample
    if not (high > low).any():
        return []

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, key, x = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros((0, len(low)))
        bound = np.full(params.trees, np.iinfo(np.uint64).max)
        for f in frames:
            for start in range(0, len(f), 2000):
                here = f.iloc[start:start + 2000]
                keys = keys_by_tree(here["h"].to_numpy(), params.trees, params.seed)
                row, t = np.nonzero(keys <= bound)
                k, own = np.r_[key, keys[row, t]], np.r_[tree, t]
                kept = first_of(own, k, size)
                at, n = kept - len(key), len(key)
                new = np.stack(here["x"].tolist())
                x = np.where((kept >= n)[:, None], new[row[np.maximum(at, 0)]] if len(row) else 0.0, x[np.minimum(kept, n - 1)] if n else 0.0)
                tree, key = own[kept], k[kept]
                full = np.bincount(tree, minlength=params.trees) == size
                worst = np.zeros(params.trees, np.uint64)
                np.maximum.at(worst, tree, key)
                bound[full] = worst[full]
        yield pd.DataFrame({"tree": tree, "key": key.astype(np.int64), "x": list(x)})

    def grow(f: pd.DataFrame) -> pd.DataFrame:
        t, key = int(f["tree"].iloc[0]), f["key"].to_numpy().astype(np.uint64)
        rows = np.stack(f["x"].tolist())[np.argsort(key, kind="stable")[:size]]
        return pd.DataFrame({"tree": [t], "model": [pickle.dumps(grown(rows, low, high, [params.seed, t]))]})

    drawn = good.mapInPandas(draw, "tree long, key long, x array<double>")
    found = drawn.groupBy("tree").applyInPandas(grow, "tree long, model binary").collect()
    return [pickle.loads(r["model"]) for r in sorted(found, key=lambda r: r["tree"])]


def threshold(scores: DataFrame, keep: float) -> float:
    """The cut of `scores` (score, good) with the best balanced accuracy among those that keep the `keep` share of good rows.

    Equal scores are counted first; the counts are ordered by range and added up across tasks. Two counts and five rows are collected.
    """
    counts = scores.groupBy("score").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    n_good, n_bad = counts.agg(F.sum("good"), F.sum("bad")).first()
    if not n_good:
        return IsolationForest.threshold
    placed = numbered(counts, [F.col("score")], "forest_good", "good").drop("ordinal").withColumnRenamed("before", "g")
    placed = numbered(placed, [F.col("score")], "forest_bad", "bad").drop("ordinal").withColumnRenamed("before", "b")
    # The quantile between the two good rows around its place, as numpy has it.
    place = (n_good - 1) * keep
    near = placed.filter("good > 0").select("score", "g", (F.col("g") + F.col("good")).alias("end")).filter(
        (F.col("g") <= int(np.ceil(place))) & (F.col("end") > int(np.floor(place)))).collect()
    lo, hi = (next(r["score"] for r in near if r["g"] <= i < r["end"]) for i in (int(np.floor(place)), int(np.ceil(place))))
    floor = float(np.quantile([lo, hi], place - np.floor(place)))
    kept, passed = (F.col("g") + F.col("good")) / n_good, (F.col("b") + F.col("bad")) / max(n_bad, 1)
    ranked = placed.select("score", (kept + (1 - passed)).alias("balance"))
    below = ranked.filter(F.col("score") <= floor).orderBy(F.col("score").desc()).limit(1).collect()
    best = ranked.filter(F.col("score") >= floor).orderBy(F.col("balance").desc(), "score").limit(1).collect()
    at_floor = below[0]["balance"] if below else 1.0
    return float(best[0]["score"]) if best and best[0]["balance"] > at_floor else floor


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", params: ForestParams = ForestParams()) -> IsolationForest:
    """Grow and calibrate on all labelled rows; rows that fail the base rules take no part."""
    measured = T.StructType([docs.schema["doc_id"], T.StructField("x", T.ArrayType(T.DoubleType()))])
    target = arrow_schema(measured)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            found = [(i, profile(t)) for i, t in zip(b.column("doc_id").to_pylist(), texts_of(b.column("text")))]
            yield pa.RecordBatch.from_pylist([{"doc_id": i, "x": signals(p)} for i, p in found
                                              if not base_failed(p["n_words"], p["n_repeat_words"], params)], schema=target)

    # Texts are measured before they meet the labels, so that what moves is short.
    rows = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull()).mapInArrow(measure, measured)
    forest = IsolationForest(params)
    with scratch(docs.sparkSession):
        known = stage(rows.join(label_means(labels, label), "doc_id").select(
            F.xxhash64("doc_id", "x").alias("h"), "x", (F.col("_label") == 1).alias("good")), "forest_rows")
        at = range(len(USED))
        span = known.agg(F.count_if("good").alias("n"), *[F.min(F.col("x")[i]).alias(f"a{i}") for i in at],
                         *[F.max(F.col("x")[i]).alias(f"b{i}") for i in at]).first()
        if not span["n"]:
            return forest
        low, high = (np.array([span[f"{side}{i}"] for i in at], float) for side in "ab")
        forest.size = min(params.subsample, span["n"])
        forest.trees = trees_of(known.filter("good"), params, low, high) if forest.size > 1 else []

        def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    yield pd.DataFrame({"score": forest.anomaly(np.stack(f["x"].tolist())), "good": f["good"]})

        scores = stage(known.select("x", "good").mapInPandas(score, "score double, good boolean"), "forest_scores")
        forest.threshold = threshold(scores, params.keep)
    return forest


def judge(docs: DataFrame, forest: IsolationForest) -> DataFrame:
    """`docs` with the rule counts, `base_failed`, `anomaly` and `kept`. One pass, no shuffle."""
    params = forest.params
    added = T.StructType.fromDDL(STATS + ", base_failed boolean, anomaly double, kept boolean")
    taken = {f.name for f in added}
    fed = docs.select(*(c for c in docs.columns if c not in taken))
    schema = T.StructType([*fed.schema.fields, *added.fields])
    target, width = arrow_schema(schema), len(fed.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            found = [profile(t) for t in texts_of(b.column("text"))]
            counts = {k: np.array([p[k] for p in found], np.int64) for k in COUNTS}
            out = base_failed(counts["n_words"], counts["n_repeat_words"], params)
            odd = forest.anomaly(np.array([signals(p) for p in found]).reshape(len(found), len(USED)))
            kept = ~out & (odd <= forest.threshold)
            own = [b.column(f.name).cast(f.type) for f in list(target)[:width]]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(counts[k]) for k in COUNTS), pa.array(out), pa.array(odd), pa.array(kept)], schema=target)

    return fed.mapInArrow(run, schema)
