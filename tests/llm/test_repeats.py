import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import line_runs, queries, suffix_dedup
from ledgerloom.llm.line_runs import LineParams
from ledgerloom.llm.suffix_dedup import SuffixParams
from parity.check import compare, connect
from tests.llm.conftest import SCHEMA, prose


def gone_bytes(texts: list[bytes], length: int) -> list[np.ndarray]:
    seen: dict[bytes, int] = {}
    for t in texts:
        for k in range(len(t) - length + 1):
            seen[t[k:k + length]] = seen.get(t[k:k + length], 0) + 1
    out = []
    for t in texts:
        flags = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if seen[t[k:k + length]] > 1:
                flags[k:k + length] = True
        out.append(flags)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", min_size=9, max_size=50), min_size=1, max_size=5), st.integers(3, 8))
def test_two_stage_sort_finds_repeated_starts(texts, length):
    raw = [t.encode() for t in texts]
    sizes = [len(t) - length + 1 for t in raw]
    got = suffix_dedup.repeated_starts(raw, sizes, length)
    seen: dict[bytes, int] = {}
    for t, n in zip(raw, sizes):
        for k in range(n):
            seen[t[k:k + length]] = seen.get(t[k:k + length], 0) + 1
    assert [g.tolist() for g in got] == [[seen[t[k:k + length]] > 1 for k in range(n)] for t, n in zip(raw, sizes)]


def test_suffix_query_equals_brute_force(spark, documents, folder):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op8_suffix_dedup(spark, folder).collect()}
    rows = documents.collect()
    raw = [r.text.encode() for r in rows]
    for r, t, f in zip(rows, raw, gone_bytes(raw, 400)):
        kept = bytes(np.frombuffer(t, np.uint8)[~f])
        assert got[r.doc_id] == (len(t), int(f.sum()), len(suffix_dedup.spans(f)), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("most", [1, 3000])
def test_hot_passage_with_many_surroundings(spark, most):
    passage = prose(9, 90)
    texts = [f"{prose(100 + i, 60)} {passage} {prose(200 + i, 60)}" for i in range(40)] + ["ab" * 700, "xyz " * 400, prose(5, 400)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], SCHEMA)
    raw = [t.encode() for t in texts]
    got = {r.doc_id: [(s["start"], s["size"]) for s in r.spans] for r in suffix_dedup.remove_repeats(docs, SuffixParams(most=most, run=64)).collect()}
    assert got == {i: suffix_dedup.spans(f) for i, f in enumerate(gone_bytes(raw, 400))}
    assert all(got[i] for i in range(42)) and not got[42]


@pytest.mark.parametrize("table", ["odd_docs", "clashing", "empty"])
def test_suffix_odd_input(request, table):
    docs = request.getfixturevalue(table)
    rows = suffix_dedup.remove_repeats(docs).collect()
    assert len(rows) == docs.count()
    left = {r.doc_id: len(r.kept) for r in rows if r.doc_id is not None}
    assert not rows or (left[1] == left[2] == left[3] == left[4] == left[8] == 0 and left[7] == 3 and left[6] > 1_000_000)


@pytest.mark.parametrize("name", ["op9_line_runs", "op10_raking"])
def test_sql_twins(spark, folder, name):
    assert compare(queries.QUERIES[name](spark, folder), connect(folder), queries.SQL[name]) == []


def plain_lines(docs: list[tuple], p: LineParams) -> dict:
    seen_run, seen_line, out = set(), set(), {}
    for i, text in docs:
        lines = text.split("\n")
        gone = set()
        for k, line in enumerate(lines):
            run = tuple(lines[k:k + p.min_lines])
            if len(run) == p.min_lines:
                if run in seen_run:
                    gone |= set(range(k, k + p.min_lines))
                seen_run.add(run)
            if line in seen_line and len(line.split()) >= p.min_words:
                gone.add(k)
            seen_line.add(line)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


@pytest.mark.parametrize("min_lines", [1, 2, 3, 4, 7])
def test_line_runs_equal_plain_loops(spark, min_lines):
    rng = np.random.default_rng(3)
    pool = ["a", "b", "c d", "", prose(1, 12), prose(2, 3)]
    docs = [(i, "\n".join(rng.choice(pool, rng.integers(1, 15)))) for i in range(60)]
    p = LineParams(min_lines=min_lines)
    df = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in docs], SCHEMA)
    assert {r.doc_id: r.text for r in line_runs.drop_copies(df, p).collect()} == plain_lines(docs, p)


@pytest.mark.parametrize("table", ["odd_docs", "clashing", "empty"])
def test_lines_odd_input(request, table):
    docs = request.getfixturevalue(table)
    out = line_runs.drop_copies(docs)
    rows = out.collect()
    assert len(rows) == docs.count() and set(docs.columns) <= set(out.columns)
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert not rows or (by_id[1].n_removed == 0 and by_id[2].text == "" and by_id[3].text == "" and by_id[7].text == "one"
                        and by_id[8].n_removed == 39 and by_id[6].n_removed == 0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=20, max_size=60).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=6), st.integers(1, 20))
def test_suffix_order_and_common_prefixes_with_zero_bytes(texts, length):
    gap = bytes(length + 8)
    buffer = b"".join(t + gap for t in texts)
    bases = np.cumsum([0] + [len(t) + len(gap) for t in texts[:-1]])
    words = np.ndarray((len(buffer) - 7,), ">u8", buffer, strides=(1,))
    places = np.concatenate([b + np.arange(len(t)) for b, t in zip(bases, texts)])
    left = np.concatenate([len(t) - np.arange(len(t)) for t in texts])
    string = {int(b + k): t[k:k + length] for b, t in zip(bases, texts) for k in range(len(t))}
    wide = -(-length // 8) * 8
    order = suffix_dedup.sorted_places(words, places, left, wide)
    keys = [(string[int(q)], ) for q in order]
    assert keys == sorted(keys)
    got = suffix_dedup.common_prefixes(words, places[left >= length], length, block=7)
    kept = [string[int(q)] for q in places[left >= length]]
    plain = [next((i for i, (a, b) in enumerate(zip(u, v)) if a != b), length) for u, v in zip(kept, kept[1:])]
    assert got.tolist()[1:] == plain and not got[:1].any()


def test_suffix_order_keeps_no_copy_for_each_start():
    import tracemalloc
    passage = prose(4, 160).encode()
    texts = [prose(1000 + i, 20).encode() + passage + prose(5000 + i, 20).encode() for i in range(800)]
    tracemalloc.start()
    flags = suffix_dedup.repeated_starts(texts, [len(t) - 399 for t in texts], 400)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(f.sum() >= len(passage) - 399 for f in flags)
    assert peak < 60 * sum(map(len, texts))
