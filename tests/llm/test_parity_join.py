import re
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import parity_join as pj
from ledgerloom.llm import queries
from tests.llm.conftest import SCHEMA, prose

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text: str | None) -> set[tuple]:
    w = WORD.findall((text or "").encode().lower())
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain(rows: list[tuple]) -> dict:
    """{place: (n_shingles, component)} of (id, text) rows, by comparing all pairs; components by smallest id."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x
    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            label[y] = x
    least: dict[int, int | None] = {}
    for k, (i, _) in enumerate(rows):
        ids = [x for x in (least.get(top(k)), i) if x is not None]
        least[top(k)] = min(ids, default=None)
    return sorted(((i, len(sets[k]), least[top(k)]) for k, (i, _) in enumerate(rows)), key=str)


def joined(spark, rows, params=pj.JaccardParams()) -> list[tuple]:
    df = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in pj.jaccard_components(df, params).collect()), key=str)


def test_query_equals_all_pairs(spark, documents, folder):
    got = sorted((tuple(r) for r in queries.op12_parity_join(spark, folder).collect()), key=str)
    assert got == plain([(r.doc_id, r.text) for r in documents.collect()])


def edited(words: list[str], r, share: float) -> list[str]:
    return [w if r.random() > share else f"new{r.integers(1 << 30)}" for w in words]


def family_rows(seed: int) -> list[tuple]:
    """Families of variants around the limit, a drift chain, strangers that share one passage, and very short texts."""
    r = np.random.default_rng(seed)
    texts = []
    for f, size in enumerate((20, 60, 150, 400)):
        base = prose(50 + f, size).split()
        texts += [" ".join(edited(base, r, share)) for share in (0, 0.01, 0.02, 0.03, 0.04) for _ in range(4)]
    chain = prose(99, 200).split()
    for _ in range(12):
        texts.append(" ".join(chain))
        chain = chain[3:] + prose(int(r.integers(1 << 30)), 3).split()
    passage = prose(7, 60)
    texts += [f"{prose(1000 + k, 40)} {passage} {prose(2000 + k, 30)}" for k in range(40)]
    texts += ["a b c d e", "a b c d", "A  b\tc d", "a", "", "b c d e f", "a b c d e f g h", "a b c d e f g h i"]
    return [(100 + 7 * k % 911, t) for k, t in enumerate(texts)]


def test_families_chains_and_shared_passages(spark):
    rows = family_rows(3)
    want = plain(rows)
    assert len({x[2] for x in want}) > 60
    assert joined(spark, rows) == want
    # Blocks of a few sets take many block pairs; the result is the same.
    assert joined(spark, rows, pj.JaccardParams(block=2)) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=120, unique=True), st.integers(0, 40), st.integers(0, 40), st.integers(0, 10 ** 6))
def test_linked_sets_share_a_part_in_any_batch(tokens, drop, add, seed):
    r = np.random.default_rng(seed)
    a = set(tokens)
    b = set(sorted(a)[min(drop, len(a) - 1):]) | {1000 + k for k in range(add)}
    others = [set(r.integers(0, 2000, int(r.integers(1, 300))).tolist()) for _ in range(4)]
    sets = [others[0], a, *others[1:3], b, others[3]]
    hashed = [np.sort(pj.mixed(np.array(sorted(s), np.uint64))) for s in sets]
    sizes = np.array([len(s) for s in sets])
    of, key = pj.lookup(np.concatenate(hashed), sizes, 80)
    sketches = pj.packed_sketches(np.concatenate(hashed), sizes)
    assert pj.hamming(sketches[1], sketches[4]) <= len(a ^ b)
    if 100 * len(a & b) >= 80 * len(a | b):
        assert set(key[of == 1].tolist()) & set(key[of == 4].tolist())
    # A set's parts do not depend on what else is in the batch.
    for k, h in enumerate(hashed):
        alone = pj.lookup(h, sizes[k:k + 1], 80)[1]
        assert sorted(alone.tolist()) == sorted(key[of == k].tolist())


def test_clashing_short_names_get_others():
    name = np.array([[5, 1], [5, 2], [6, 1]], np.int64)
    assert pj.short_names(name, np.zeros(0, np.int64)).tolist() == [5, 5, 6]
    got = pj.short_names(name, np.array([5])).tolist()
    assert len(set(got)) == 3 and got[2] == 6


@pytest.mark.parametrize("table", ["odd_docs", "clashing", "empty"])
def test_odd_input(request, table, odd_rows):
    docs = request.getfixturevalue(table)
    got = sorted((tuple(r) for r in pj.jaccard_components(docs).collect()), key=str)
    assert got == ([] if table == "empty" else plain([(r[0], r[1]) for r in odd_rows]))


def test_texts_are_hashed_once_for_their_parts(spark, documents):
    """op12, CPU: counting the sets of a part and reading its rows took a pass over all texts each."""
    rows = pj.part_rows(documents, pj.JaccardParams(), np.zeros(0, np.int64))
    found = pj.shared_parts(rows)
    got = {tuple(r) for r in found.collect()}
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("MapInArrow") == 1 and plan.count("ReusedExchange") == 1
    sets = {}
    for part, num in {tuple(r) for r in rows.collect()}:
        sets.setdefault(part, set()).add(num)
    assert got == {(part, num) for part, held in sets.items() if len(held) > 1 for num in held} and got
