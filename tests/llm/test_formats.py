import hashlib
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerloom.llm import best_fit, frames, line_runs, order_minhash, prefix_tree, quality_fm, queries, raking, simhash_gph
from ledgerloom.llm.bpe import decoder, encoder, ids_of

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_the_library(text):
    t = Tokenizer.from_file(PATH) if not hasattr(test_ids_equal_the_library, "t") else test_ids_equal_the_library.t
    t.encode_special_tokens = True
    test_ids_equal_the_library.t = t
    ids = ids_of(text, encoder(PATH, PATTERN))
    assert ids.tolist() == t.encode(text, add_special_tokens=False).ids and decoder(PATH)(ids) == text


def test_long_text_is_cut_where_no_token_spans(tokenizer):
    text = "word <|endoftext|> it's 12  34\n\n x" * 40_000
    assert ids_of(text, encoder(PATH, PATTERN)).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_query(spark, folder, documents, tokenizer):
    rows = queries.op4_best_fit(spark, folder).collect()
    n = check_packing(rows, 2048)
    assert n <= 1.03 * sum(r.length for r in rows) / 2048 + 1
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    for d in documents.collect():
        ids = np.array([*tokenizer.encode(d.text, add_special_tokens=False).ids, 0], "<u4")
        mine = sorted(pieces[d.doc_id], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(-(-len(ids) // 2048))) and all(r.length == 2048 for r in mine[1:])
        at = 0
        for r in mine:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


@pytest.mark.parametrize("range_rows", [20_000, 40])
@pytest.mark.parametrize("sizes", ["mixed", "one", "tiny"])
def test_packing_in_any_number_of_ranges(spark, range_rows, sizes):
    rng = np.random.default_rng(5)
    lengths = {"mixed": np.r_[rng.integers(0, 101, 300), np.full(200, 37)], "one": np.full(300, 30), "tiny": rng.integers(1, 6, 300)}[sizes]
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(lengths)], "item long, length long")
    rows = best_fit.pack(df, 100, range_rows=range_rows).join(df, "item").collect()
    assert sorted(r.item for r in rows) == list(range(len(lengths)))
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(x for _, x in u) <= 100 and sorted(o for o, x in u if x) == np.r_[0, np.cumsum([x for _, x in sorted(u) if x])[:-1]].tolist()
               for u in used.values() if any(x for _, x in u))
    if sizes == "one":
        assert len(used) == 100


def test_settle_pairs_the_nearest_gaps():
    assert best_fit.settle({0: (0, 3), 1: (2, 1), 2: (3, 0)}) == [(1, 0, 0, 2, 2), (2, 0, 1, 0, 1), (2, 1, 0, 0, 1)]


@pytest.mark.parametrize("table", ["odd_docs", "clashing", "empty"])
def test_packing_odd_input(request, table):
    docs = request.getfixturevalue(table)
    rows = queries.packed(docs).collect()
    check_packing(rows, 2048)
    assert len([r for r in rows if r.piece == 0]) == docs.count()
    assert not rows or [r.length for r in rows if r.doc_id == 4] == [1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<", "[", "|", "\\", "/", "s", ">", "INST]", "a", "\n", "<|end|>"]), max_size=12).map("".join))
def test_escape_is_reversible(text):
    safe = prefix_tree.escape(text)
    assert prefix_tree.unescape(safe) == text and not any(c in safe for c in ("<|", "</s>", "<s>", "[INST]", "[/INST]"))
    assert prefix_tree.role_of(prefix_tree.header(text)) == text


def digests(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_round_trip(spark, folder):
    got = {r.conv_id: r for r in queries.op5_prefix_tree(spark, folder).collect()}
    want = {}
    for r in sorted(spark.read.parquet(f"{folder}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        want.setdefault(r.conv_id, []).append((r.role, r.text))
    want[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for k, r in got.items()} == {k: digests(v) for k, v in want.items()}
    assert all(r.attends for r in got.values())


def test_shared_turns_are_emitted_once_and_attended(spark):
    first = ("user", "hello there")
    convs = {1: [first, ("assistant", "a")], 2: [first, ("assistant", "b"), ("user", "c")], 3: [first], 4: [first, ("assistant", "a")],
             5: [("user", "other")], 6: [first, ("assistant", "b"), ("user", "d")], None: [(None, None), ("assistant", "<|end|>")]}
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"node": F.lit(1), "path": F.lit(2)})
    nodes, members = prefix_tree.build(turns, PATH, PATTERN)
    flat = nodes.collect()
    assert len(flat) == len({tuple(t[:i + 1]) for t in convs.values() for i in range(len(t))})
    stream = sorted((r.offset, r.n_tokens) for r in flat)
    assert all(a + n == b for (a, n), (b, _) in zip(stream, stream[1:])) and stream[0][0] == 0
    by = {bytes(r.node): r for r in flat}
    for r in flat:
        inside, up = set(), by.get(bytes(r.parent))
        while up is not None:
            inside |= set(range(up.offset, up.offset + up.n_tokens))
            up = by.get(bytes(up.parent))
        assert {x for a in r.ancestors for x in range(a["start"], a["stop"])} == inside and r.position == len(inside)
        assert not r.parent or r.offset > by[bytes(r.parent)].offset
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in prefix_tree.read_back(nodes, members, PATH).collect()}
    assert got == {c: digests([(r or "", t or "") for r, t in v]) for c, v in convs.items()}


def test_chat_empty(spark):
    nodes, members = prefix_tree.build(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), PATH, PATTERN)
    assert nodes.count() == 0 and prefix_tree.read_back(nodes, members, PATH).count() == 0


def test_fingerprint_query(spark, folder, documents):
    got = {r.doc_id: r for r in queries.op7_order_minhash(spark, folder).collect()}
    rows = sorted(documents.collect(), key=lambda r: r.doc_id)
    for r, n in zip(rows, [*rows[1:], rows[0]]):
        q = len(r.text) // 4
        edited = r.text[:len(r.text) - q] + n.text[:q]
        assert (got[r.doc_id].n_chars, got[r.doc_id].edited_sha256) == (len(r.text), hashlib.sha256(edited.encode()).hexdigest())
    assert len({(got[r.doc_id].fingerprint, r.text) for r in rows}) == len({r.text for r in rows})
    long = [got[r.doc_id] for r in rows if len(r.text) > 400]
    assert np.mean([r.near_edited for r in long]) > 0.25 > 0.05 > np.mean([r.near_next for r in long])


def test_order_minhash_sees_order_and_repeats(spark):
    words = [f"w{i}" for i in range(400)]
    texts = {"a": words, "swap": words[200:] + words[:200], "reverse": words[::-1], "cut": words[:300], "twice": words * 2, "same": words}
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "k string, text string")
    mark = {r.k: r.f for r in order_minhash.with_fingerprint(df, "text", "f", order_minhash.OMHParams(size=128)).collect()}
    like = {k: np.mean([x == y for x, y in zip(mark["a"], m)]) for k, m in mark.items()}
    assert like["same"] == 1 and like["reverse"] < 0.05 and 0.3 < like["swap"] < 0.8 and 0.3 < like["cut"] < 0.85 and like["twice"] < 0.7


def test_fingerprint_of_every_numbered_kmer(spark):
    """The numbering and the picks against plain loops."""
    text = "a b a b a b c a b"
    f = order_minhash.with_fingerprint(spark.createDataFrame([(text,)], "text string"), "text", "f", order_minhash.OMHParams(k=1, picks=9, size=2)).first().f
    g = order_minhash.with_fingerprint(spark.createDataFrame([(text,)], "text string"), "text", "f", order_minhash.OMHParams(k=1, picks=9, size=1)).first().f
    assert f[0] == f[1] == g[0]  # all nine k-mers are picked, in text order, whatever the point


@pytest.mark.parametrize("table", ["odd_docs", "clashing", "empty"])
def test_fingerprint_odd_input(request, table):
    docs = request.getfixturevalue(table)
    out = order_minhash.with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "n_chars"), ["text"],
                                  lambda rows: order_minhash.with_fingerprint(rows, "text", "mark"))
    rows = out.collect()
    assert len(rows) == docs.count() and all(r.next_text is not None for r in rows)
    assert all(r.mark == [0] * 32 for r in rows if not r.text.strip())


def test_raking_meets_its_targets(spark):
    rows = [(s, lang, n) for s, lang, n in [("a", "en", 900), ("a", "de", 50), ("b", "en", 30), ("b", "de", 20)]]
    cells = spark.createDataFrame(rows, "source string, lang string, tokens long")
    p = raking.MixParams(targets={"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.7, "de": 0.3}}, rounds=60, stage_every=20)
    got = raking.rake(cells, p).collect()
    for d, t in p.targets.items():
        for value, share in t.items():
            assert abs(sum(r.weight for r in got if r[d] == value) / 1000 - share) < 1e-6
    # The odds ratio of the cells is what raking keeps.
    w = {(r.source, r.lang): r.weight for r in got}
    assert np.isclose(w["a", "en"] * w["b", "de"] / w["a", "de"] / w["b", "en"], 900 * 20 / 50 / 30)


def test_mix_keeps_the_wanted_share(spark):
    docs = spark.createDataFrame([(i, "x" * 400, ["en", "de"][i % 10 == 0], f"s{i % 3 and 1}", 400) for i in range(3000)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    rows = raking.mix(docs, dims={"topic": raking.topic_of(F.col("text"))}).collect()
    assert abs(sum(r.probability * r.tokens for r in rows) / sum(r.tokens for r in rows) - 0.5) < 1e-9
    assert abs(sum(r.sampled for r in rows) / 3000 - 0.5) < 0.03


@pytest.mark.parametrize("table", ["odd_docs", "clashing", "empty"])
def test_mix_odd_input(request, table):
    docs = request.getfixturevalue(table)
    out = raking.mix(docs, dims={"topic": raking.topic_of(F.col("text"))})
    rows = out.collect()
    assert len(rows) == docs.count() and len(set(out.columns)) == len(out.columns)
    assert all(0 < r.probability <= 1 and r.tokens >= 1 for r in rows)


def test_pipeline(spark, folder, documents):
    docs, kept = documents, []
    for name, step in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(step(spark, docs, folder), name.replace(" ", "_"))
        kept.append(docs)
        if name != "best-fit packing":
            assert docs.columns == documents.columns
    good = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").filter("quality = 1").collect()}
    assert len(good - {r.doc_id for r in kept[0].collect()}) <= 0.02 * len(good)
    assert kept[1].count() == kept[0].count() and kept[2].count() < kept[1].count()
    assert {r.doc_id for r in kept[4].collect()} == {r.doc_id for r in kept[3].collect()}
    check_packing(kept[4].collect(), 2048)


@pytest.mark.parametrize("table", ["odd_docs", "clashing", "empty"])
def test_pipeline_stages_on_odd_input(spark, folder, request, table):
    docs = request.getfixturevalue(table)
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, folder)
        rows = out.collect()
        if name == "best-fit packing":
            check_packing(rows, 2048)
        else:
            assert out.columns == docs.columns and len(rows) <= docs.count()
        if table == "empty":
            assert rows == []


def test_private_columns_come_back(clashing, labels):
    names = [c for c in clashing.columns if c.startswith("_")]
    for out in (quality_fm.score(clashing, quality_fm.train(clashing, labels)), raking.mix(clashing, dims={"topic": raking.topic_of(F.col("text"))}),
                simhash_gph.one_of_each(clashing), line_runs.drop_copies(clashing)):
        assert len(names) == 11 and {tuple(r) for r in out.select(*names).collect()} == {("x",) * len(names)}


def test_scratch_tables_go_and_kept_ones_stay(spark):
    with frames.scratch(spark):
        gone = frames.stage(spark.range(3), "gone")
        kept = frames.stage(gone.selectExpr("id + 1 AS id"), "kept", keep=True)
        path = gone.inputFiles()[0]
    assert sorted(r.id for r in kept.collect()) == [1, 2, 3]
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file)
    outside = frames.stage(spark.range(2), "outside")
    assert outside.count() == 2


def test_kept_tables_of_an_inner_scratch_go_with_the_outer(spark):
    def there(table):
        folder = spark._jvm.org.apache.hadoop.fs.Path(table.staged_at)
        return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)

    with frames.scratch(spark):
        with frames.scratch(spark):
            gone, kept = frames.stage(spark.range(3), "gone"), frames.stage(spark.range(3), "kept", keep=True)
        early = frames.stage(spark.range(3), "early")
        frames.unstage(early)
        assert (there(gone), there(kept), there(early)) == (False, True, False)
    assert not there(kept)


def test_what_was_shuffled_for_a_table_goes_when_it_is_written(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before, old = shuffled(), spark.conf.get(frames.CLEANUP, None)
    table = frames.stage(spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 5).alias("k")).count(), "shuffled")
    until = time.time() + 10
    while shuffled() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffled() - before and spark.conf.get(frames.CLEANUP, None) == old
    assert sorted(r["count"] for r in table.collect()) == [200] * 5
