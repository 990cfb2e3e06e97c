"""Periodic runs: stretches of words that repeat themselves, found by longest common extensions on a difference cover.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), of at least `min_exponent` x q
and at least `min_words` words, that no neighbouring word extends. Every text is worked on whole and by itself, so nothing is
shuffled and a hot group of copies is spread like any other rows; a batch of texts is handled as one word sequence in which
every text ends with a word of its own, which no stretch can cross.

1. Harmonic grid. The words where a run of period q agrees with the word q further on are more than 2q in a row, so one of the
   places 0, 2q, 4q, ... of the text is among them with more than q agreeing words behind it. For every q up to a quarter of
   the text those places are tried: n/2 x (1 + 1/2 + 1/3 + ...) tries for n words. A try compares a few words; the ones that
   hold go on. Tries are made in slices of bounded number, whatever the length of the text.
2. Longest common extension of what is left, forwards and backwards. Only suffixes at places whose remainder by 31 is in a
   difference cover are sorted (6 of 31): by their first 31 words, then by ranks of 31, 62, 124, ... words. Any two places
   reach the cover together within 30 words, which are compared; from there the answer is a range minimum over common prefixes
   of neighbours in the sorted order, read from a sparse table. Texts without a surviving try need no sorting.
3. A stretch of two extensions is a run of its smallest period: stretches found with multiples of it are the same stretch.

Null and empty texts have no words and no runs. Rows without an id keep their words as they are under `broken`. Repeated rows
and ids are kept, each with its own result. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerloom.llm.frames import arrow_schema, pieces

#: Every difference modulo MODULUS is one of two members of COVER (a perfect difference set).
MODULUS, COVER = 31, (0, 1, 3, 8, 12, 18)
SLICE = 1 << 20


@dataclass(frozen=True)
class RunParams:
    min_words: int = 6
    min_exponent: int = 4


def shift_table() -> np.ndarray:
    """[a, b] -> the smallest d for which a + d and b + d both lie in the cover, for remainders a and b."""
    inside = np.zeros(2 * MODULUS, bool)
    inside[[c + k for c in COVER for k in (0, MODULUS)]] = True
    d = np.arange(MODULUS)
    both = inside[d[:, None] + d][:, None, :] & inside[d[:, None] + d][None, :, :]
    return both.argmax(axis=2)


SHIFT = shift_table()


class Extension:
    """Longest common extensions of pairs of places in one word sequence whose last word is unlike all others."""

    def __init__(self, words: np.ndarray):
        self.n = n = len(words)
        # Behind the end, every place is unlike every other.
        self.words = np.concatenate([words, -1 - np.arange(2 * MODULUS)]).astype(np.int64)
        self.slot = np.full(n + MODULUS, -1, np.int64)
        places = np.concatenate([np.arange(c, n + MODULUS, MODULUS) for c in COVER])
        self.slot[places] = np.arange(len(places))
        follower = self.slot[np.minimum(places + MODULUS, n + MODULUS - 1)]
        follower[places + MODULUS >= n + MODULUS] = -1
        rank = self.first_ranks(places)
        ranks, nexts = [rank], [follower]
        while rank.max(initial=-1) + 1 < len(places):
            after = np.where(nexts[-1] >= 0, rank[nexts[-1]] + 1, 0)
            rank = np.unique(rank * (len(places) + 1) + after, return_inverse=True)[1]
            ranks.append(rank)
            nexts.append(np.where(nexts[-1] >= 0, nexts[-1][nexts[-1]], -1))
        self.rank = rank
        order = np.argsort(rank)
        self.table = self.minima(self.neighbours(places, order, ranks, nexts))

    def first_ranks(self, places: np.ndarray) -> np.ndarray:
        """Ranks of the suffixes at `places` by their first MODULUS words."""
        names = np.unique(self.words, return_inverse=True)[1]
        have, rank = 1, names
        while have < MODULUS:
            step = min(have, MODULUS - have)
            later = np.concatenate([rank[step:], np.zeros(step, np.int64)])
            rank, have = np.unique(rank * len(names) + later, return_inverse=True)[1], have + step
        return np.unique(rank[places], return_inverse=True)[1]

    def neighbours(self, places: np.ndarray, order: np.ndarray, ranks: list[np.ndarray], nexts: list[np.ndarray]) -> np.ndarray:
        """Common prefix, in words, of every suffix in the order with the one before it."""
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(a), np.int64)
        live = np.ones(len(a), bool)
        for k in range(len(ranks) - 1, -1, -1):
            same = live & (ranks[k][a] == ranks[k][b])
            common[same] += MODULUS << k
            a[same], b[same] = nexts[k][a[same]], nexts[k][b[same]]
            live &= (a >= 0) & (b >= 0)
            a[~live], b[~live] = 0, 0
        return common + self.compared(places[order[:-1]] + common, places[order[1:]] + common, np.full(len(a), MODULUS))

    @staticmethod
    def minima(values: np.ndarray) -> list[np.ndarray]:
        table = [values]
        while 2 << len(table) - 1 <= len(values):
            half = 1 << len(table) - 1
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        return table

    def compared(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that agree from places i and j on, up to `most`."""
        out, left = np.zeros(len(i), np.int64), np.arange(len(i))
        for k in range(int(most.max(initial=0))):
            left = left[(most[left] > k) & (self.words[np.minimum(i[left] + k, len(self.words) - 1)] == self.words[np.minimum(j[left] + k, len(self.words) - 2)])]
            if not len(left):
                break
            out[left] = k + 1
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree from places i and j (i < j) on."""
        shift = SHIFT[i % MODULUS, j % MODULUS]
        out = self.compared(i, j, shift)
        far = np.flatnonzero(out == shift)
        x, y = self.rank[self.slot[i[far] + shift[far]]], self.rank[self.slot[j[far] + shift[far]]]
        x, y = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((y - x).astype(np.float64))[1] - 1
        more = np.zeros(len(far), np.int64)
        for k in np.unique(level).tolist():
            at = level == k
            row = self.table[k]
            more[at] = np.minimum(row[x[at]], row[y[at] - (1 << k)])
        out[far] += more
        return out


def grid_pairs(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, params: RunParams) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of every grid place of every text where the words that a run would have agree."""
    most = np.where(sizes >= params.min_words, sizes // params.min_exponent, 0)
    text = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    # The last place whose partner is in the text.
    grid = (sizes[text] - period - 1) // (2 * period) + 1
    upto = np.cumsum(grid)
    found, k = [], 0
    while k < len(text):
        end = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + SLICE, side="right")))
        g = grid[k:end]
        q = np.repeat(period[k:end], g)
        i = np.repeat(starts[text[k:end]], g) + (np.arange(len(q)) - np.repeat(np.cumsum(g) - g, g)) * 2 * q
        need = np.minimum(q + 1, 6)
        for step in range(6):
            # Words of the next text, or behind the last, never agree: every text ends with a word of its own.
            on = (need <= step) | (words[np.minimum(i + step, len(words) - 1)] == words[np.minimum(i + q + step, len(words) - 2)])
            i, q, need = i[on], q[on], need[on]
        found.append((i, q))
        k = end
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def find_runs(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, params: RunParams) -> np.ndarray:
    """Rows (place, length, period) of all runs, by place and period, of texts laid one behind the other.

    `words` holds every text followed by one word that is found nowhere else; starts and sizes leave that word out.
    """
    i, q = grid_pairs(words, starts, sizes, params)
    if not len(i):
        return np.zeros((0, 3), np.int64)
    # Only texts with a surviving try are sorted.
    owner = np.searchsorted(starts, i, side="right") - 1
    owners, new = np.unique(owner, return_inverse=True)
    held = np.concatenate([np.arange(starts[o], starts[o] + sizes[o] + 1) for o in owners])
    edge = np.concatenate([[0], np.cumsum(sizes[owners] + 1)[:-1]])
    x = i - starts[owner] + edge[new]
    own = words[held]
    ahead = Extension(own)(x, x + q)
    # Backwards, the place before x is behind the one that stands at len(own) - x in the turned sequence; a word unlike all
    # others stands behind the first word.
    turned = np.concatenate([own[::-1], [own.max(initial=0) + 1]])
    behind = Extension(turned)(len(own) - x - q, len(own) - x)
    begin, length = x - behind, behind + ahead + q
    long = length >= np.maximum(params.min_words, params.min_exponent * q)
    found = np.stack([i - behind, length, q], axis=1)[long]
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    # The same stretch under several periods: the smallest is the first.
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    found = found[fresh]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def broken(words: list[bytes], key) -> list[bytes]:
    """`words` of one document in ten made periodic from some place on, by the checksum of its id; the others as they are."""
    if key is None or not words:
        return words
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def summary(words: list[bytes], runs: np.ndarray) -> tuple:
    """The row of one text, of its words and its runs (start, length, period)."""
    kept = words
    if len(runs):
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
        np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
        kept = [w for w, covered in zip(words, np.cumsum(edge).tolist()) if not covered]
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs.tolist())
    longest = min(runs.tolist(), key=lambda r: (-r[1], r[0], r[2]), default=None)
    best = (*longest, 1000 * longest[1] // longest[2]) if longest else (None,) * 4
    return (len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def periodic_runs(docs: DataFrame, params: RunParams = RunParams(), key: str = "doc_id", change=None) -> DataFrame:
    """(key, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) for every row of `docs`.

    start, length, period and exponent are those of the longest run, null without one; runs_sha256 is of all runs, and
    collapsed_sha256 of the text with every run cut to its first period. `change(words, key)` may edit the words first.
    """
    schema = T.StructType([docs.schema[key], *T.StructType.fromDDL(SCHEMA).fields])
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            texts = [(x or b"").split() for x in b.column("text").cast(pa.binary()).to_pylist()]
            if change:
                texts = [change(w, k) for w, k in zip(texts, b.column(key).to_pylist())]
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            starts = np.cumsum(sizes + 1) - sizes - 1
            names = defaultdict(count().__next__)
            words = np.zeros(int(sizes.sum()) + len(texts), np.int64)
            for t, s in zip(texts, starts.tolist()):
                words[s:s + len(t)] = np.fromiter(map(names.__getitem__, t), np.int64, len(t))
            words[starts + sizes] = len(names) + np.arange(len(texts))
            found = find_runs(words, starts, sizes, params)
            cut = np.searchsorted(found[:, 0], np.append(starts, len(words)))
            found[:, 0] -= np.repeat(starts, np.diff(cut))
            rows = [summary(t, found[x:y]) for t, x, y in zip(texts, cut[:-1].tolist(), cut[1:].tolist())]
            cols = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(target)[1:])]
            yield pa.RecordBatch.from_arrays([b.column(key).cast(target[0].type), *cols], schema=target)

    return docs.select(key, "text").mapInArrow(run, schema)
