import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import periodic_runs, queries, zone_negatives
from ledgerloom.llm.periodic_runs import RunParams
from ledgerloom.llm.zone_negatives import NegativeParams


def plain_runs(w: list, least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    out = set()
    for q in range(1, len(w) // exponent + 1):
        k = 0
        while k + q < len(w):
            s = k
            while k + q < len(w) and w[k] == w[k + q]:
                k += 1
            length = k - s + q
            part = w[s:s + length]
            if k > s and length >= max(least, exponent * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.add((s, length, q))
            k += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def runs_of(texts: list[list[int]]) -> list[list[tuple[int, int, int]]]:
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    words = np.array([x for i, t in enumerate(texts) for x in (*t, 10 ** 6 + i)], np.int64)
    out = [[] for _ in texts]
    for s, length, q in periodic_runs.find_runs(words, starts, sizes, RunParams()).tolist():
        at = int(np.searchsorted(starts, s, side="right") - 1)
        out[at].append((s - int(starts[at]), length, q))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=5))
def test_runs_of_few_words(texts):
    assert runs_of(texts) == [plain_runs(t) for t in texts]


def test_runs_of_repeated_phrases():
    r = random.Random(3)
    texts = []
    for _ in range(60):
        t = []
        while len(t) < 150:
            phrase = [r.randint(0, 9) for _ in range(r.randint(1, 30))]
            t += phrase * r.randint(1, 7) + phrase[:r.randint(0, len(phrase))]
        texts.append(t)
    assert runs_of(texts) == [plain_runs(t) for t in texts]
    assert any(len(x) > 1 for x in runs_of(texts))


def test_extensions_reach_far_over_the_cover():
    r = np.random.default_rng(1)
    words = np.concatenate([np.tile(r.integers(0, 50, 700), 3), [99]])
    lce = periodic_runs.Extension(words)
    i = r.integers(0, 1400, 400)
    j = i + r.integers(1, 700, 400)
    want = [next(k for k in range(3000) if j0 + k >= len(words) or words[i0 + k] != words[j0 + k]) for i0, j0 in zip(i, j)]
    assert lce(i, j).tolist() == want
    assert lce(np.array([5]), np.array([705])).tolist() == [1395]


def test_cover_meets_every_pair_of_remainders():
    m, inside = periodic_runs.MODULUS, set(periodic_runs.COVER)
    for a in range(m):
        for b in range(m):
            d = int(periodic_runs.SHIFT[a, b])
            assert (a + d) % m in inside and (b + d) % m in inside


def expected_row(key, text) -> tuple:
    w = (text or "").encode().split()
    h = zlib.crc32(str(key).encode())
    if key is not None and h % 10 == 0 and w:
        a = h // 10 % len(w)
        p = 1 + (len(w) - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = plain_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
    return (key, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


def test_run_query_equals_brute_force(spark, documents, folder):
    got = sorted(tuple(r) for r in queries.op13_periodic_runs(spark, folder).collect())
    want = sorted(expected_row(r.doc_id, r.text) for r in documents.collect() if len(r.text.split()) < 3000)
    assert sum(r[1] for r in want) > 10
    few = {r[0] for r in want}
    assert [r for r in got if r[0] in few] == want and len(got) == documents.count()


@pytest.mark.parametrize("table", ["odd_docs", "clashing", "empty"])
def test_runs_odd_input(request, table, odd_rows):
    docs = request.getfixturevalue(table)
    got = sorted((tuple(r) for r in periodic_runs.periodic_runs(docs, change=periodic_runs.broken).collect()), key=str)
    if table == "empty":
        assert got == []
    else:
        assert len(got) == len(odd_rows)
        short = [r for r in odd_rows if len((r[1] or "").split()) < 3000]
        want = sorted((expected_row(r[0], r[1]) for r in short), key=str)
        assert [r for r in got if r[0] != 6] == want


def test_hilbert_neighbours_are_one_step_apart():
    cells = np.array([[a, b, c] for a in range(4) for b in range(4) for c in range(4)])
    place = zone_negatives.hilbert(cells, 2)
    order = np.array(sorted(range(64), key=lambda i: place[i].tobytes()))
    assert len({p.tobytes() for p in place}) == 64
    assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def plain_negatives(rows: list[tuple], every: int = 50) -> list[tuple]:
    """rows: (id, label, integer vector), distinct."""
    out = []
    for i, (a, la, va) in enumerate(rows):
        if a % every:
            continue
        score = [sum(x * y for x, y in zip(va, v)) for _, _, v in rows]
        order = sorted((j for j in range(len(rows)) if j != i), key=lambda j: (-score[j], rows[j][0]))
        for p in [j for j in order if rows[j][1] == la][:5]:
            fit = [j for j in order if rows[j][1] != la and 50 * score[p] <= 100 * score[j] <= 95 * score[p]]
            out += [(a, rows[p][0], k + 1, rows[j][0], score[p], score[j]) for k, j in enumerate(fit[:3])]
    return sorted(out)


def whole(vector) -> list[int]:
    return [int(np.floor(256 * float(x))) for x in vector]


def results(df) -> list[tuple]:
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_negatives_query_equals_brute_force(spark, folder):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, whole(r.embedding))
            for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert results(queries.op11_zone_negatives(spark, folder)) == plain_negatives(rows)


VECTORS = "vec_id long, label int, embedding array<float>"


def planted(n: int, dims: int = 5) -> list[tuple]:
    """Tight clusters of other labels around common directions, with ties."""
    r = np.random.default_rng(4)
    centre = r.normal(size=(6, dims)) * 2
    return [(i, int(r.integers(0, 3)), (centre[i % 6] + r.normal(size=dims).round(1) * 0.3).tolist()) for i in range(n)]


def test_small_blocks_are_left_out_only_by_their_bounds(spark):
    rows = planted(600)
    used = [(i, k, whole(np.array(v, np.float32))) for i, k, v in rows]
    df = spark.createDataFrame(rows, VECTORS)
    params = NegativeParams(every=10, rows=8, group=16, page=4)
    assert results(zone_negatives.hard_negatives(df, params)) == plain_negatives(used, 10)
    # Bounds do leave blocks out.
    all_rows = zone_negatives.usable(df, "vec_id", df["label"], "embedding")
    blocks = zone_negatives.blocks_of(all_rows, 5, params)
    groups = zone_negatives.groups_of(blocks, 5, params)
    pages, n = zone_negatives.pages_of(blocks, params)
    need = zone_negatives.needed(groups, pages, n, 5, True).selectExpr("sum(octet_length(who) div 4)").first()[0]
    same = groups.join(blocks.select("label"), "label").selectExpr("sum(octet_length(ids) div 8)").first()[0]
    assert 0 < need < 0.7 * same


def test_negatives_odd_input(spark):
    nan, inf = float("nan"), float("inf")
    v = [0.5, 0.25]
    odd = [(0, 1, v), (0, 1, v), (50, 1, [0.4, 0.1]), (None, 1, v), (1, None, v), (2, 1, None), (3, 1, [nan, 1.0]), (4, 1, [inf, 1.0]),
           (5, 1, [None, 1.0]), (6, 1, [0.5]), (7, 1, v), (8, 2, [0.4, 0.2]), (9, 2, [0.4, 0.2]), (10, 2, []), (11, 2, [0.3, 0.1]),
           (12, 2, [0.39, 0.22]), (12, 3, [0.38, 0.2])]
    kept = [(0, 1, v), *[odd[k] for k in (2, 9, 10, 11, 12, 13, 14, 15, 16)]]
    plain = [(i, k, [*whole(np.array(x, np.float32)), 0, 0][:2]) for i, k, x in kept]
    df = spark.createDataFrame(odd, VECTORS)
    want = plain_negatives(plain)
    assert want and results(zone_negatives.hard_negatives(df)) == want
    clash = df.selectExpr("*", "1 AS block", "2 AS grp", "3 AS place", "4 AS vector", "5 AS n", "6 AS rank")
    assert results(zone_negatives.hard_negatives(clash)) == want
    assert results(zone_negatives.hard_negatives(spark.createDataFrame([], VECTORS))) == []
    with pytest.raises(Exception, match="too large"):
        zone_negatives.hard_negatives(spark.createDataFrame([(0, 1, [1e30])], VECTORS)).collect()
