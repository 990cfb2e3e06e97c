"""Quality classifier: a factorisation machine on hashed words, structure statistics and metadata.

Score of a row x with bias w0, weights w and factors V (one row of `factors` numbers for each feature):

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i V_if x_i)^2 - sum_i V_if^2 x_i^2)

The last term is the sum over all pairs <V_i, V_j> x_i x_j, in time linear in the features of the row.

Features: every word of the whole text, hashed into `buckets` (log counts, unit length), one indicator for the bin of
each structure statistic, and one for the bin of each numeric metadata column. Bin edges are quantiles of the training
rows. Rows are scored in Arrow batches where they lie; nothing is shuffled.

Training takes at most `max_rows` labelled rows (those with the smallest hash of their id), so its one task and the model
are bounded whatever the input. Everything else reads all rows.

Null and empty texts have no words, the smallest statistics, and a score. Null metadata gets a bin of its own. A label is
the mean of a row id's labels, 1 from one half on; null labels are left out. No labelled rows at all, or an empty table:
an untrained model scores 0.5. Repeated rows are scored one by one; other columns are carried along.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.frames import any_names, arrow_schema, pieces
from ledgerloom.llm.textstats import RATES, profile, rates


@dataclass(frozen=True)
class FMParams:
    buckets: int = 1 << 14
    factors: int = 8
    bins: int = 12
    max_rows: int = 20_000
    epochs: int = 8
    batch: int = 256
    rate: float = 0.1
    word_l2: float = 2e-4
    metadata: tuple[str, ...] = ("n_chars",)
    seed: int = 7


@dataclass
class FactorisationMachine:
    params: FMParams
    edges: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    bias: float = 0.0
    w: np.ndarray = field(default_factory=lambda: np.zeros(0))
    v: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    @property
    def numeric(self) -> int:
        return len(RATES) + len(self.params.metadata)

    @property
    def size(self) -> int:
        # The last bin of each statistic stands for a missing value.
        return self.params.buckets + self.numeric * (self.params.bins + 1)

    def rows(self, raw: list[bytes], meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Feature ids, values and row starts of texts, and their statistics before binning."""
        ids, values, starts, stats = [], [], [0], []
        for text, own in zip(raw, meta):
            p = profile(text)
            stats.append([*rates(p), *(np.log1p(np.maximum(own, 0)))])
            found = Counter(p["words"])
            at = np.fromiter((zlib.crc32(x) for x in found), np.int64, len(found)) % self.params.buckets
            tf = np.log1p(np.fromiter(found.values(), np.float64, len(found)))
            ids.append(at)
            values.append(tf / max(np.sqrt((tf ** 2).sum()), 1e-12))
            starts.append(starts[-1] + len(found))
        return (np.concatenate(ids) if ids else np.zeros(0, np.int64), np.concatenate(values) if values else np.zeros(0),
                np.array(starts), np.array(stats, np.float64).reshape(len(raw), self.numeric))

    def with_bins(self, ids, values, starts, stats):
        """Sparse rows with the indicators of the statistics added."""
        n = len(starts) - 1
        width = self.params.bins + 1
        slot = np.stack([np.where(np.isnan(stats[:, j]), self.params.bins, np.searchsorted(self.edges[j], stats[:, j], side="right"))
                         for j in range(self.numeric)], axis=1) if n else np.zeros((0, self.numeric), np.int64)
        own = (self.params.buckets + np.arange(self.numeric) * width + slot).astype(np.int64)
        place = np.repeat(starts[:-1], self.numeric)
        # Indicators weigh 1/sqrt(numeric) each, so that both halves of a row have length one.
        all_ids = np.insert(ids, place, own.ravel())
        all_values = np.insert(values, place, np.full(own.size, self.numeric ** -0.5))
        return all_ids, all_values, starts + self.numeric * np.arange(n + 1)

    def margins(self, ids, values, starts):
        """Scores before the logistic function, and the sums over features for each factor."""
        if len(starts) < 2:
            return np.zeros(0), np.zeros((0, self.params.factors))
        row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        n = len(starts) - 1
        linear = np.bincount(row, self.w[ids] * values, n)
        scaled = self.v[ids] * values[:, None]
        sums = np.stack([np.bincount(row, scaled[:, f], n) for f in range(self.params.factors)], axis=1)
        squares = np.bincount(row, (scaled ** 2).sum(axis=1), n)
        return self.bias + linear + 0.5 * ((sums ** 2).sum(axis=1) - squares), sums

    def fit(self, ids, values, starts, stats, label: np.ndarray) -> FactorisationMachine:
        p, rng = self.params, np.random.default_rng(self.params.seed)
        q = np.arange(1, p.bins) / p.bins
        self.edges = np.array([np.quantile(c[~np.isnan(c)], q) if (~np.isnan(c)).any() else np.zeros(p.bins - 1)
                               for c in stats.T])
        ids, values, starts = self.with_bins(ids, values, starts, stats)
        share = np.clip(label.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(share / (1 - share)))
        self.w, self.v = np.zeros(self.size), rng.normal(0, 0.05, (self.size, p.factors))
        seen_w, seen_v, seen_b = np.full(self.size, 1e-6), np.full((self.size, p.factors), 1e-6), 1e-6
        decay = np.where(np.arange(self.size) < p.buckets, p.word_l2, p.word_l2 / 10)
        for _ in range(p.epochs):
            order = rng.permutation(len(label))
            for k in range(0, len(order), p.batch):
                take = order[k:k + p.batch]
                size = starts[take + 1] - starts[take]
                at = np.repeat(starts[take] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
                bi, bv, bs = ids[at], values[at], np.r_[0, np.cumsum(size)]
                margin, sums = self.margins(bi, bv, bs)
                miss = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label[take]) / len(take)
                row = np.repeat(np.arange(len(take)), size)
                touched, slot = np.unique(bi, return_inverse=True)
                pull = miss[row] * bv
                gw = np.bincount(slot, pull, len(touched)) + decay[touched] * self.w[touched]
                # d margin / d V_if = x_i (sum_j V_jf x_j) - V_if x_i^2
                gv = np.stack([np.bincount(slot, pull * (sums[row, f] - self.v[bi, f] * bv), len(touched))
                               for f in range(p.factors)], axis=1) + decay[touched, None] * self.v[touched]
                seen_w[touched] += gw ** 2
                seen_v[touched] += gv ** 2
                seen_b += miss.sum() ** 2
                self.w[touched] -= p.rate * gw / np.sqrt(seen_w[touched])
                self.v[touched] -= p.rate * gv / np.sqrt(seen_v[touched])
                self.bias -= p.rate * miss.sum() / np.sqrt(seen_b)
        return self

    def score(self, raw: list[bytes], meta: np.ndarray) -> np.ndarray:
        if not self.w.size:
            return np.full(len(raw), 0.5)
        margin, _ = self.margins(*self.with_bins(*self.rows(raw, meta)))
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def texts_of(column) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def meta_of(batch: pa.RecordBatch, names: tuple[str, ...]) -> np.ndarray:
    return np.stack([batch.column(n).cast(pa.float64()).to_numpy(zero_copy_only=False) for n in names], axis=1) \
        if names else np.zeros((batch.num_rows, 0))


def inputs(docs: DataFrame, params: FMParams, *extra: str) -> DataFrame:
    return docs.select(*extra, "text", *(F.col(m).cast("double").alias(f"_meta_{m}") if m in docs.columns
                                        else F.lit(None).cast("double").alias(f"_meta_{m}") for m in params.metadata))


def label_means(labels: DataFrame, label: str, key: str = "doc_id") -> DataFrame:
    return (labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull())
            .groupBy(key).agg((F.avg(label) >= 0.5).cast("int").alias("_label")))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", params: FMParams = FMParams()) -> FactorisationMachine:
    """Fit on the labelled rows of `docs`, at most `params.max_rows` of them."""
    chosen = label_means(labels, label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(params.max_rows)
    rows = inputs(docs, params, "doc_id").join(F.broadcast(chosen), "doc_id").drop("doc_id")
    names = tuple(f"_meta_{m}" for m in params.metadata)
    sparse = T.StructType.fromDDL("ids array<int>, values array<float>, stats array<double>, y int")
    target = arrow_schema(sparse)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = FactorisationMachine(params)
        for b in pieces(batches, "text"):
            ids, values, starts, stats = machine.rows(texts_of(b.column("text")), meta_of(b, names))
            yield pa.RecordBatch.from_pylist([
                {"ids": ids[s:e].astype(np.int32), "values": values[s:e].astype(np.float32), "stats": stats[i], "y": int(y)}
                for i, (s, e, y) in enumerate(zip(starts[:-1], starts[1:], b.column("_label").to_pylist()))],
                schema=target)

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [f for f in frames if len(f)]
        if parts:
            data = pd.concat(parts, ignore_index=True)
            # The same bounded rows in the same order, however tasks delivered them.
            data["_k"] = [xxhash.xxh64_intdigest(i.tobytes() + v.tobytes() + x.tobytes())
                          for i, v, x in zip(data["ids"], data["values"], data["stats"])]
            data = data.sort_values(["_k", "y"], kind="stable")
            starts = np.r_[0, np.cumsum(data["ids"].map(len))]
            machine = FactorisationMachine(params).fit(
                np.concatenate(data["ids"].tolist()).astype(np.int64), np.concatenate(data["values"].tolist()).astype(np.float64),
                starts, np.stack(data["stats"].tolist()), data["y"].to_numpy(np.float64))
            yield pd.DataFrame({"model": [pickle.dumps((machine.edges, machine.bias, machine.w.astype(np.float32),
                                                        machine.v.astype(np.float32)))]})

    out = (rows.mapInArrow(featurise, sparse)
           .repartition(1).mapInPandas(learn, "model binary").collect())
    machine = FactorisationMachine(params)
    if out:
        machine.edges, machine.bias, machine.w, machine.v = pickle.loads(out[0]["model"])
    return machine


@any_names
def score(docs: DataFrame, machine: FactorisationMachine, out: str = "score") -> DataFrame:
    """`docs` with the probability of a good document in column `out`; one pass, no shuffle."""
    names = tuple(f"_meta_{m}" for m in machine.params.metadata)
    fed = inputs(docs, machine.params, *(c for c in docs.columns if c not in ("text", out)))
    schema = T.StructType([f for f in fed.schema.fields if f.name not in names] + [T.StructField(out, T.DoubleType())])
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            s = machine.score(texts_of(b.column("text")), meta_of(b, names))
            kept = [b.column(f.name).cast(f.type) for f in target if f.name != out]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(s)], schema=target)

    return fed.mapInArrow(run, schema)


def held_out(key: str = "doc_id"):
    """Rows kept away from training: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))
