import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import compact_windows as cw
from ledgerloom.llm import queries, simhash_gph
from ledgerloom.llm.components import components
from ledgerloom.llm.simhash_gph import SimHashParams, fingerprint
from tests.llm.conftest import SCHEMA, prose


def plain_fingerprint(text: str) -> int:
    words = text.encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps) -> dict:
    parent = {i: i for i in range(len(fps))}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


@pytest.mark.parametrize("text", ["", " \n", "One", "one two", "A B C", "é È É x y z z z z z", prose(4, 50)])
def test_fingerprint(text):
    assert fingerprint(text.encode(), 3) % 2 ** 64 == plain_fingerprint(text)


@pytest.mark.parametrize("params", [SimHashParams(), SimHashParams(hot=1), SimHashParams(partitions=(2,)), SimHashParams(partitions=(4,))])
def test_components_equal_brute_force(spark, params):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2 ** 63, 40)
    fps = [int(b) ^ sum(1 << int(x) for x in set(rng.integers(0, 63, rng.integers(0, 4)))) for b in base for _ in range(6)]
    rows = spark.createDataFrame([(f,) for f in set(fps)], "fp long")
    edges, plan = simhash_gph.links(rows, params)
    label = {r["id"]: r["label"] for r in components(edges).collect()}
    x = {f: int(simhash_gph.rearranged(np.array([f], np.int64).view(np.uint64), plan.order).view(np.int64)[0]) for f in set(fps)}
    got, uniq = {}, sorted(set(fps))
    for f in uniq:
        got.setdefault(label.get(x[f], x[f]), set()).add(f)
    want = {}
    for f, c in zip(uniq, plain_components(list(range(len(uniq))), uniq)):
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r["id"]: r["label"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


def test_simhash_query_equals_brute_force(spark, documents, folder):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op2_simhash_gph(spark, folder).collect()}
    rows = documents.select("doc_id", "text").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    want = plain_components([r.doc_id for r in rows], fps)
    assert got == {r.doc_id: (f"{f:016x}", c) for r, f, c in zip(rows, fps, want)}


@pytest.mark.parametrize("table", ["odd_docs", "clashing", "empty"])
def test_simhash_odd_input(request, table):
    docs = request.getfixturevalue(table)
    rows = simhash_gph.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    blank = {r.component_id for r in rows if r.fp == 0}
    assert not rows or blank == {3}
    one = simhash_gph.one_of_each(docs)
    assert one.columns == docs.columns
    ids = [r.doc_id for r in one.collect()]
    assert not rows or (sorted(i for i in ids if i is not None) == [1, 3, 6, 7, 8, 9, 9, 10, 11] and ids.count(None) == 1)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=8, max_size=40), st.integers(2, 6))
def test_every_stretch_has_its_window(values, least):
    h = cw.mix(np.array(values, np.uint64))
    sig, l, r = cw.windows(h, 0, least)
    g = cw.mix(h ^ np.uint64(0x2545F4914F6CDD1D))
    for a in range(len(h)):
        for b in range(a + least - 1, len(h)):
            assert ((l <= a) & (r >= b) & (sig == g[a:b + 1].min())).any()


def test_recall_at_the_least_similarity():
    assert cw.WindowParams().recall >= 0.99


def test_passages(spark):
    shared = prose(50, 60)
    edited = shared.split()
    edited[30] = "changed"
    long_shared = prose(51, 200).split()
    near = list(long_shared)
    near[60], near[140] = "here", "there"
    texts = [f"{prose(60, 90)} {shared} {prose(61, 40)}", f"{prose(62, 30)} {shared} {prose(63, 120)}", prose(64, 200),
             " ".join([prose(65, 20), *long_shared]), " ".join([*near, prose(66, 30)]), prose(67, 10), prose(67, 10),
             f"{prose(68, 100)} {' '.join(shared.split()[:20])} {prose(69, 100)}"]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: (r.class_id, r.n_links) for r in cw.classes(docs).collect()}
    assert got == {0: (0, 1), 1: (0, 1), 2: (2, 0), 3: (3, 1), 4: (3, 1), 5: (5, 0), 6: (6, 0), 7: (7, 0)}
    found, _ = cw.passages(docs)
    by_text = {r.t: r.text for r in docs.select(cw.text_id(), "text").collect()}
    for r in found.collect():
        a = set(map(tuple, (by_text[r.a].split()[r.a_from:r.a_to][i:i + 5] for i in range(r.a_to - r.a_from - 4))))
        b = set(map(tuple, (by_text[r.b].split()[r.b_from:r.b_to][i:i + 5] for i in range(r.b_to - r.b_from - 4))))
        assert len(a & b) / len(a | b) >= 0.8 and abs(len(a & b) / len(a | b) - r.similarity) < 1e-9


def crowd() -> list[str]:
    """Passages whose halves many strangers hold, a passage in 36 texts with edits, and a chain of ever more edits."""
    hot = prose(200, 56).split()
    texts = [" ".join([prose(1000 + i, 60), *(hot[:28] if i % 2 else hot[28:]), prose(2000 + i, 60)]) for i in range(240)]
    texts += [" ".join([prose(3000 + i, 30), *hot, prose(3100 + i, 30)]) for i in range(4)]
    often = prose(201, 90).split()
    for i in range(36):
        now = list(often)
        for k in range(i % 3):
            now[(7 * i + 31 * k) % 90] = f"edit{i}x{k}"
        texts.append(" ".join([prose(4000 + i, 25), *now, prose(4100 + i, 25)]))
    chain = prose(202, 120).split()
    for i in range(6):
        texts.append(" ".join([prose(5000 + i, 25), *chain, prose(5100 + i, 25)]))
        chain = list(chain)
        chain[10 + 20 * i % 120], chain[15 + 20 * i % 120] = f"drift{i}", f"drift{i}y"
    return texts


def brute_force(texts: list[str]) -> tuple[list[int], list[set[int]]]:
    """Class of every text and the texts it is linked to, from all pairs."""
    p = cw.WindowParams()
    every = [cw.Text(t.encode(), p) for t in texts]
    links: list[set[int]] = [set() for _ in texts]
    for i, x in enumerate(every):
        for j in range(i):
            y = every[j]
            if cw.verify(x, y, {"al": 0, "ar": len(x.h), "bl": 0, "br": len(y.h)}, p):
                links[i].add(j)
                links[j].add(i)
    label = [-1] * len(texts)
    for i in range(len(texts)):
        todo = [i] if label[i] < 0 else []
        while todo:
            k = todo.pop()
            if label[k] < 0:
                label[k] = i
                todo += links[k]
    return label, links


@pytest.fixture(scope="module")
def crowded(spark):
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(crowd())], SCHEMA)
    return {r.doc_id: r for r in cw.classes(docs).collect()}


def test_passages_among_strangers_equal_brute_force(crowded):
    label, _ = brute_force(crowd())
    assert label[240:244] == [240] * 4 and len(set(label[244:280])) == len(set(label[280:286])) == 1
    assert [crowded[i].class_id for i in range(len(label))] == label


def test_link_counts_equal_brute_force(crowded):
    # Every text here has one passage, so those linked to it, directly or through others, have it too.
    label, links = brute_force(crowd())
    assert [crowded[i].n_links for i in range(len(label))] == [label.count(c) - 1 for c in label]
    assert [crowded[i].n_passages for i in range(len(label))] == [int(label.count(c) > 1) for c in label]
    assert 285 not in links[280] and crowded[280].n_links == 5
    assert all(crowded[i].repeated_words >= 50 for i in range(244, 280))


def test_few_strangers_hide_no_passage(spark):
    """Two texts with a passage whose middle the other texts of their group hold: all find each other, however small the group."""
    texts, want = [], []
    for g in range(150):
        strangers = [4, 3, 4, 2, 4, 5][g % 6] if g else 48
        hot = prose(30_000 + g, 56).split()
        want += [len(texts)] * 2
        texts += [f"{prose(40_000 + g, 40)} {' '.join(hot)} {prose(50_000 + g, 40)}", f"{prose(60_000 + g, 30)} {' '.join(hot)} {prose(70_000 + g, 50)}"]
        for k in range(strangers):
            want.append(len(texts))
            texts.append(f"{prose(100_000 + 100 * g + k, 60)} {' '.join(hot[7:49])} {prose(200_000 + 100 * g + k, 60)}")
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.class_id for r in cw.classes(docs).collect()}
    assert [i for i, c in enumerate(want) if got[i] != c] == []


def test_links_through_several_passages(spark):
    known = spark.createDataFrame([(1, 0, 60, 7), (2, 0, 60, 7), (2, 80, 150, 8), (3, 0, 70, 8), (4, 0, 70, 8), (4, 90, 150, 7)],
                                  "t long, f int, u int, passage long")
    assert {r.t: r.n_links for r in cw.link_counts(known).collect()} == {1: 2, 2: 3, 3: 2, 4: 3}


@pytest.mark.parametrize("batch", [1, 3, 10_000])
def test_shared_windows_are_those_of_two_texts(spark, batch):
    rng = np.random.default_rng(7)
    rows = [tuple(map(int, x)) for x in zip(rng.integers(0, 60, 400), rng.integers(0, 5, 400), rng.integers(0, 3, 400), rng.integers(50, 53, 400))]
    rows += [(100, 1, k, 90) for k in range(30)] + [(101, 1, k, 90) for k in range(30)] + [(101, 2, 0, 60)]
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = sorted(map(tuple, cw.shared_windows(spark.createDataFrame(rows, "key long, t long, l int, r int")).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert got == sorted({x for x in rows if len({y[1] for y in rows if y[0] == x[0]}) > 1})


def test_windows_of_texts_put_together_are_those_of_each(spark):
    p = cw.WindowParams()
    texts = [prose(80_000 + i, n) for i, n in enumerate([50, 51, 49, 300, 700])] + ["all the same words here again " * 40]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], SCHEMA).coalesce(1)
    want = set()
    for i, t in enumerate(texts):
        h = cw.shingles(t.encode(), p.width)
        for j in range(p.hashes if len(h) >= p.least else 0):
            want |= {((int(s) & ~7 | j), i, int(l), int(r)) for s, l, r in zip(*cw.windows(h, j, p.least))}
    ids = {r.t: r.doc_id for r in docs.select("doc_id", cw.text_id()).collect()}
    rows = cw.all_windows(docs, p).collect()
    assert {(r.key % 2 ** 64, ids[r.t], r.l, r.r) for r in rows} == want and len(rows) == len(want)


@pytest.mark.parametrize("cell", [512, 3])
def test_a_crowd_is_compared_in_cells(spark, monkeypatch, cell):
    monkeypatch.setattr(cw, "CELL", cell)
    monkeypatch.setattr(cw, "CROWD", cell // 3)
    p = cw.WindowParams()
    texts = crowd()[236:286]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)] * 2, SCHEMA)
    t_of = {r.doc_id: r.t for r in docs.select("doc_id", cw.text_id()).collect()}
    every = [cw.Text(t.encode(), p) for t in texts]
    pairs, want = [], set()
    for i in range(len(texts)):
        for j in range(i):
            box = {"al": 0, "ar": len(every[i].h) - 1, "bl": 0, "br": len(every[j].h) - 1}
            pairs.append((t_of[i], t_of[j], *box.values(), (i + j) % 3))
            want |= {(t_of[i], t_of[j], *m) for m in cw.verify(every[i], every[j], box, p)}
    met = spark.createDataFrame(pairs, "a long, b long, al int, ar int, bl int, br int, home long")
    got = [tuple(r) for r in cw.verified(docs, met, p).collect()]
    assert set(got) == want and len(got) == len(want) > 50


def test_a_large_crowd_sends_few_copies_of_its_texts(spark, monkeypatch):
    staged = {}

    def keep(df, name, stage=cw.stage):
        staged[name] = stage(df, name)
        return staged[name]

    monkeypatch.setattr(cw, "stage", keep)
    n = 400
    docs = spark.createDataFrame([(i, prose(300_000 + i, 20), "en", "a", 1) for i in range(n)], SCHEMA)
    t = sorted(r.t for r in docs.select(cw.text_id()).collect())
    pairs = [(t[i], t[j], 0, 15, 0, 15, 5) for j in range(n) for i in range(j)]
    assert cw.verified(docs, spark.createDataFrame(pairs, "a long, b long, al int, ar int, bl int, br int, home long"), cw.WindowParams()).count() == 0
    cells = staged["cells"]
    assert cells.count() == len(pairs)
    assert cells.select("cell", "a").union(cells.select("cell", "b")).distinct().count() <= 6 * n


def test_windows_inside_others_are_not_met_one_by_one(spark, monkeypatch):
    """Texts that repeat themselves have a window from every repetition to the end; only the widest can find anything."""
    counts = {}

    def count(df, name, stage=cw.stage):
        out = stage(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(cw, "stage", count)
    rows = [(8 * k + k, t, 10 * n, 2000) for k in (1, 2) for t in range(10) for n in range(100)]
    known = spark.createDataFrame([(0, 0, 60, 77)], "t long, f int, u int, passage long")
    met = spark.createDataFrame([], "a long, b long, al int, ar int, bl int, br int, home long")
    got = cw.left_over(spark.createDataFrame(rows, "key long, t long, l int, r int"), met, known, cw.WindowParams()).collect()
    assert {(r.a, r.b, r.al, r.ar, r.bl, r.br) for r in got} == {(a, b, 0, 2000, 0, 2000) for b in range(10) for a in range(b)}
    assert counts["unsettled_windows"] <= 2 * 11


@pytest.mark.parametrize("part", [1 << 20, 64])
def test_promising_texts_equal_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(cw, "PART", part)
    p = cw.WindowParams()
    often = prose(400_000, 70).split()
    near = [w if i % 30 else f"{w}x" for i, w in enumerate(often)]
    far = [w if i % 6 else f"{w}x" for i, w in enumerate(often)]
    texts = [" ".join([prose(400_001 + i, 40), *x, prose(400_101 + i, 40)]) for i, x in enumerate([often, near, far, often[:35], often[35:], often[:48], often[10:], near[:56]])]
    texts += [f"{prose(400_201 + i, 60)} {prose(400_300, 14)} {prose(400_401 + i, 60)}" for i in range(60)] + ["again " * 80, "again " * 90 + prose(400_500, 30), prose(400_501, 49)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate([*texts, *texts[:9]])], SCHEMA)
    ids = {r.doc_id: r.t for r in docs.select("doc_id", cw.text_id()).collect()}
    hulls = spark.createDataFrame([(ids[i], i % 3, 400) for i in range(len(texts))], "t long, l int, r int")
    h = [set(cw.shingles(t.encode(), p.width)[i % 3:401].tolist()) for i, t in enumerate(texts)]
    share, want = 2 * p.similarity / (1 + p.similarity), set()
    for i, t in enumerate(texts):
        of = [any(x in other for j, other in enumerate(h) if j != i) for x in cw.shingles(t.encode(), p.width)[i % 3:401].tolist()]
        if any(sum(of[a:b]) >= share * (b - a) - 1e-9 for a in range(len(of)) for b in range(a + p.least, len(of) + 1)):
            want.add(ids[i])
    got = [r.t for r in cw.promising(docs, hulls, p).collect()]
    assert set(got) == want and len(got) == len(want)
    assert {ids[0], ids[1], ids[6]} <= want and not want & {ids[i] for i in range(8, 68)}


def test_strangers_around_a_line_are_no_pairs(spark, monkeypatch):
    """A line of 20 words in all of 300 texts makes no pairs of them; the passages among them are found."""
    counts = {}

    def count(df, name, stage=cw.stage, **how):
        out = stage(df, name, **how)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(cw, "stage", count)
    line, hot = prose(410_000, 20), prose(410_001, 60)
    texts = [f"{prose(411_000 + i, 50)} {line} {prose(412_000 + i, 50)}" for i in range(300)]
    texts += [f"{prose(413_000 + i, 50)} {line} {hot} {prose(414_000 + i, 20)}" for i in range(3)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: (r.class_id, r.n_links) for r in cw.classes(docs).collect()}
    assert got == {i: (i, 0) for i in range(300)} | {i: (300, 2) for i in range(300, 303)}
    assert counts["meetings"] > 300 and counts["pairs_left_over"] <= 3


def test_few_texts_are_moved(spark):
    docs = spark.createDataFrame([(i, prose(420_000 + i, 12), "en", "a", 1) for i in range(400)] * 2 + [(900, None, "en", "a", 0)], SCHEMA)
    wanted = docs.filter("doc_id % 40 = 0").select(cw.text_id()).union(docs.filter("doc_id = 80").select(cw.text_id()))
    of = {r.t: r.text for r in docs.select(cw.text_id(), "text").collect()}
    got = {r.t: r.text for r in cw.texts_of(docs, wanted).collect()}
    assert {r.t for r in wanted.collect()} - {t for t, x in of.items() if x is None} <= set(got) and len(got) < 20
    assert all(of[t] == x for t, x in got.items()) and cw.texts_of(docs, wanted.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_passages_of_a_pair_are_whole_and_maximal(seed):
    rng = np.random.default_rng(seed)
    p = cw.WindowParams()
    for _ in range(60):
        a = rng.integers(0, rng.integers(3, 2000), 200)
        b = np.where(rng.random(200) < rng.choice([0, 0.02, 0.05]), rng.integers(3000, 4000, 200), a)
        x, y = cw.Text(b"", p), cw.Text(b"", p)
        x.h, y.h = cw.mix(a.astype(np.uint64)), cw.mix(np.r_[rng.integers(5000, 6000, 30), b].astype(np.uint64))
        for a0, a1, b0, b1, s in cw.verify(x, y, {"al": 0, "ar": 199, "bl": 0, "br": 229}, p):
            one, two = set(x.h[a0:a1 - p.width + 1].tolist()), set(y.h[b0:b1 - p.width + 1].tolist())
            assert s == len(one & two) / len(one | two) >= p.similarity


def test_every_shared_50_word_string_is_in_one_class(spark, documents, folder):
    got = {r.doc_id: r.class_id for r in queries.op6_compact_windows(spark, folder).collect()}
    seen: dict = {}
    for r in documents.collect():
        w = r.text.split()
        for k in range(len(w) - 49):
            seen.setdefault(tuple(w[k:k + 50]), set()).add(r.doc_id)
    shared = [s for s in seen.values() if len(s) > 1]
    assert shared and all(len({got[i] for i in s}) == 1 for s in shared)


@pytest.mark.parametrize("table", ["odd_docs", "clashing", "empty"])
def test_passages_odd_input(request, table):
    docs = request.getfixturevalue(table)
    rows = cw.classes(docs).collect()
    assert len(rows) == docs.count()
    got = {r.doc_id: r.class_id for r in rows if r.doc_id not in (None, 9)}
    assert not rows or got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 10: 10, 11: 11}
