import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import queries, quality_fm, rules_forest
from ledgerloom.llm.quality_fm import FactorisationMachine, FMParams
from ledgerloom.llm.textstats import dup_lines, profile, repeated_words


def test_pairs_by_squares_equal_pairs_by_sum():
    rng = np.random.default_rng(0)
    m = FactorisationMachine(FMParams(buckets=8, factors=3))
    m.w, m.v, m.bias = rng.normal(size=m.size), rng.normal(size=(m.size, 3)), 0.3
    ids, values = rng.choice(m.size, 12, replace=False), rng.normal(size=12)
    want = m.bias + m.w[ids] @ values + sum(m.v[ids[i]] @ m.v[ids[j]] * values[i] * values[j] for i in range(12) for j in range(i))
    assert np.isclose(m.margins(ids, values, np.array([0, 12]))[0][0], want)


def test_learns_to_tell_two_kinds_apart():
    texts = [b"good words in a row here", b"!!! $$$ BAD ### BAD", b"fine text again with words", b"$$$ &&& ### !!!"]
    m = FactorisationMachine(FMParams(buckets=64, epochs=200, batch=4))
    rows = m.rows(texts, np.full((4, 1), 10.0))
    m.fit(*rows, np.array([1.0, 0.0, 1.0, 0.0]))
    s = m.score(texts, np.full((4, 1), 10.0))
    assert s[[0, 2]].min() > 0.9 and s[[1, 3]].max() < 0.1


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op1_quality_fm(spark, folder)
    assert got.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    rows = got.filter("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([g >= 0.5 for g in good]) > 0.95


def test_learning_never_sees_the_held_out_third(spark, documents, labels):
    flipped = labels.withColumn("quality", F.when(quality_fm.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality_fm.train(documents, x.filter(~quality_fm.held_out())) for x in (labels, flipped))
    assert np.array_equal(a.v, b.v) and a.bias == b.bias


@pytest.mark.parametrize("n, want", [(0, 0), (5, 0), (6, 6), (20, 20)])
def test_repeated_words_of_one_word(n, want):
    assert repeated_words([b"x"] * n) == want


def test_counts_against_plain_loops(odd_rows):
    for text in [r[1] or "" for r in odd_rows]:
        words = text.encode().split()[:3000]
        text = b"\n".join(b" ".join(words[i:i + 7]) for i in range(0, len(words), 7)).decode()
        p, w = profile(text.encode()), text.encode().split()
        grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        times = Counter(grams)
        assert p["n_repeat_words"] == len({i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(5)})
        assert p["word_chars"] == sum(len(x.decode()) for x in w)
        assert p["n_symbols"] == sum(text.count(c) for c in "#*$%&|<>")
        lines = [x for x in text.split("\n") if x.split()]
        assert p["n_dup_lines"] == sum(x in lines[:i] for i, x in enumerate(lines))


def test_blank_lines_are_no_duplicates():
    assert dup_lines(b"a\n\n \n\na\nb") == (3, 1)


def test_forest_catches_junk_and_keeps_text(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op3_rules_forest(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    judged = [r for r in got if not r.base_failed]
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in got)
    assert not any(r.kept for r in got if r.base_failed)
    assert np.mean([r.kept for r in judged if r.quality == 1]) > 0.95
    assert np.mean([r.kept for r in judged if r.quality == 0]) < 0.1


@pytest.mark.parametrize("table", ["odd_docs", "clashing", "empty"])
def test_odd_input(request, labels, table):
    docs = request.getfixturevalue(table)
    n = docs.count()
    for out in (quality_fm.score(docs, quality_fm.train(docs, labels)), rules_forest.judge(docs, rules_forest.train(docs, labels))):
        rows = out.collect()
        assert len(rows) == n and len(out.columns) == len(set(out.columns))
    scored = quality_fm.score(docs, quality_fm.train(docs, labels.limit(0)))
    assert all(r.score == 0.5 for r in scored.collect())
    kept = {(r.doc_id, r.n_chars): r.kept for r in rules_forest.judge(docs, rules_forest.train(docs, labels.limit(0))).collect()}
    assert not any(kept[k] for k in kept if k in {(3, None), (4, 0), (5, 4), (7, 3)})


def test_the_threshold_of_a_forest_comes_from_every_row(spark):
    rng = np.random.default_rng(3)
    for n, keep in [(1, 0.99), (7, 0.5), (900, 0.99), (900, 0.9)]:
        score, good = np.round(rng.uniform(0.3, 0.7, n), 2), rng.uniform(size=n) < 0.7
        good[0] = True
        floor = np.quantile(score[good], keep)
        cuts = np.unique(np.r_[floor, score[score >= floor]])
        balance = [np.mean(score[good] <= c) + 1 - np.sum(score[~good] <= c) / max((~good).sum(), 1) for c in cuts]
        frame = spark.createDataFrame(list(zip(score.tolist(), good.tolist())), "score double, good boolean").repartition(5)
        assert np.isclose(rules_forest.threshold(frame, keep), cuts[np.argmax(np.round(balance, 12))])


def test_a_forest_draws_from_all_rows_however_they_lie(spark):
    params = rules_forest.ForestParams(trees=5, subsample=8)
    rows = [(i * 7919, [float(i % 50), i / 100.0]) for i in range(5000)]
    frame = spark.createDataFrame(rows, "h long, x array<double>")
    low, high = np.zeros(2), np.array([50.0, 50.0])
    few, many = (rules_forest.trees_of(frame.repartition(n), params, low, high) for n in (1, 9))
    keys = rules_forest.keys_by_tree(np.array([r[0] for r in rows]), 5, params.seed)
    for t in range(5):
        mine = np.array([rows[i][1] for i in np.argsort(keys[:, t])[:8]])
        for got, again, want in zip(few[t], many[t], rules_forest.grown(mine, low, high, [params.seed, t])):
            assert np.array_equal(got, want) and np.array_equal(again, want)


def test_a_forest_learns_from_more_rows_than_it_once_took(spark, monkeypatch):
    # 20,100 labelled rows: all of them are scored for the threshold.
    seen = []
    counted = rules_forest.threshold
    monkeypatch.setattr(rules_forest, "threshold", lambda scores, keep: seen.append(scores.count()) or counted(scores, keep))
    docs = spark.range(20100).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.md5((F.col("id") * 20 + i).cast("string")) for i in range(11)]).alias("text"))
    rules_forest.train(docs, docs.select("doc_id", (F.col("doc_id") % 10 > 0).cast("int").alias("quality")))
    assert seen == [20100]
