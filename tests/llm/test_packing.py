"""Token pieces, packing, token rows, shards, threads and the pipeline."""

import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

import corpus_pipeline
from plantpulse.llm import bestfit, shards, threads, tokenrows
from plantpulse.llm.tokens import Encoder, cut, default_file, document_ids


def frame(spark, rows, columns="doc_id long, text string"):
    return spark.createDataFrame(rows, columns)


TEXTS = [None, "", "short", "Ünïcode ñ 漢字 and <|endoftext|> words", "word " * 3000, "x" * 5000, "the same text", "the same text", " \n\n "] + [
    f"document number {i} " * (1 + i * 13 % 90) for i in range(60)]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_fast_ids_equal_the_library(text):
    encoder = Encoder.of(default_file())
    assert encoder.fast is not None
    assert encoder.ids(text).tolist() == encoder.slow.encode(text, add_special_tokens=False).ids


def test_cut_is_lossless():
    for total in (1, 7, 8, 9, 16, 17, 100):
        parts = cut(total, 8)
        assert sum(n for _, n in parts) == total and all(n == 8 for _, n in parts[1:])
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120))
def test_local_search_never_loses_and_always_gains(sizes):
    sizes = np.array(sizes, np.int64)
    bins, fills = bestfit.best_fit(sizes, 50)
    before = sum(f * f for f in fills), len(bins)
    bestfit.local_search(sizes, bins, fills, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(f == sum(int(sizes[i]) for i in b) <= 50 for b, f in zip(bins, fills))
    assert sum(f * f for f in fills) >= before[0] and sum(1 for b in bins if b) <= before[1]


def test_local_search_empties_sequences():
    rng = np.random.default_rng(1)
    sizes = rng.integers(200, 700, 5000)
    bins, _ = bestfit.best_fit(sizes, 1024)
    after, _, _ = bestfit.pack_sizes(sizes, 1024)
    assert after.max() + 1 < len(bins)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=100))
def test_segment_tree_finds_the_tightest_row(lengths):
    rows = tokenrows.best_fit_rows(lengths, 64)
    room, want = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [r for r in room if r >= lengths[i]]
        left = min(fits) if fits else 64
        if fits:
            room.remove(left)
        room.append(left - lengths[i])
        want.append(left)
    assert sorted(64 - sum(lengths[i] for i in r) for r in rows) == sorted(room)
    assert sorted(i for r in rows for i in r) == list(range(len(lengths)))


def check_packing(rows, texts, width=1024):
    encoder = Encoder.of(default_file())
    ids = {i: document_ids(t, encoder, 2) for i, t in texts}
    got = {}
    for r in rows:
        got.setdefault(r.sequence_id, []).append(r)
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert zlib.crc32(part.tobytes()) == r.ids_crc32
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    for members in got.values():
        end = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= width
    return len(got)


def test_packing_round_trip(spark):
    texts = list(enumerate(TEXTS))
    rows = bestfit.pack_documents(frame(spark, texts).repartition(6)).collect()
    n = check_packing(rows, texts)
    total = sum(r.length for r in rows)
    assert n <= -(-total // 1024) + 1
    assert Counter(r.doc_id for r in rows)[4] == len(cut(len(document_ids(TEXTS[4], Encoder.of(default_file()), 2)), 1024))
    assert bestfit.pack_documents(frame(spark, [])).count() == 0


def test_packing_null_ids_and_repeated_rows(spark):
    rows = bestfit.pack_documents(frame(spark, [(None, "a b"), (1, "c"), (1, "c")])).collect()
    assert Counter(r.doc_id for r in rows) == {None: 1, 1: 2} and len({(r.sequence_id, r.offset) for r in rows}) == 3


def test_token_rows_round_trip(spark):
    out = tokenrows.packed_rows(frame(spark, list(enumerate(TEXTS)) + [(None, "x")]), width=256)
    back = {}
    for r in out.collect():
        ids, places = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(places) == 256 and r.cu_seqlens[-1] == r.n_ids and not ids[r.n_ids:].any()
        for k, doc in enumerate(r.doc_ids):
            low, high = r.cu_seqlens[k:k + 2]
            assert places[low:high].tolist() == list(range(high - low))
            back.setdefault(doc, []).append((r.pieces[k], r.starts[k], ids[low:high]))
    encoder = Encoder.of(default_file())
    for i, t in list(enumerate(TEXTS)) + [(None, "x")]:
        parts = sorted(back[i], key=lambda p: p[0])
        assert np.concatenate([p[2] for p in parts]).tolist() == document_ids(t, encoder, 2).tolist()
    assert tokenrows.packed_rows(frame(spark, [])).count() == 0


def test_token_rows_flush_in_blocks(spark, monkeypatch, tmp_path):
    tokenrows.write_rows(frame(spark, list(enumerate(TEXTS))), f"{tmp_path}/rows", width=128)
    import pyarrow.parquet as pq

    batch = pq.read_table(f"{tmp_path}/rows").combine_chunks().to_batches()[0]
    assert tokenrows.matrix(batch, 128, 50_257).shape == (len(batch), 128)


# ---- shards ----

def test_shards_are_even_gapless_and_keep_copies_together(spark):
    rng = np.random.default_rng(2)
    texts = [f"text {i} of its own, quite unlike others" for i in range(300)] + ["one text that half of the rows share"] * 200
    texts += [f"pair {i} of equal texts" for i in range(60) for _ in range(2)] + [None, "", None]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts)]
    got = shards.assign(frame(spark, rows), shards=7).collect()
    of = dict(rows)
    count = Counter(r.shard for r in got)
    assert len(got) == len(rows) and len(count) == 7 and max(count.values()) - min(count.values()) <= 1
    for s in count:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(count[s]))
    for r in got:
        body = (of[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(body) + 16, zlib.crc32(body))
    where = {}
    for r in got:
        where.setdefault(of[r.doc_id] or "", set()).add(r.shard)
    assert sum(len(where[f"pair {i} of equal texts"]) > 1 for i in range(60)) <= 6


def test_linked_texts_meet(spark):
    rows = [(10 * g + k, f"a line that group {g} shares with itself\nown line {k} of {g} here") for g in range(40) for k in range(3)]
    got = {r.doc_id: r.shard for r in shards.assign(frame(spark, rows), shards=4, rounds=5).collect()}
    together = sum(len({got[10 * g + k] for k in range(3)}) == 1 for g in range(40))
    assert together > 20  # by chance it would be 2 or 3


def test_shards_of_few_or_no_rows(spark):
    assert shards.assign(frame(spark, []), shards=4).count() == 0
    got = shards.assign(frame(spark, [(None, "a"), (None, "a"), (1, None)]), shards=5).collect()
    assert len(got) == 3 and max(Counter(r.shard for r in got).values()) == 1 and {r.slot for r in got} == {0}


# ---- threads ----

def test_quotes_are_linked_and_removed(spark):
    rows = [
        (1, 0, "Hello there my friend.\nThis is the second line of it."), (1, 1, "> Hello there my friend.\nI answer the first."),
        (1, 2, "On Monday X wrote:\n> > Hello there my friend.\n> I answer the first.\n\nThanks for the answer."),
        (1, 3, "Something else entirely."), (1, 4, "> Hello there my friend. This is\n> the second line of it.\nRewrapped reply."),
        (2, 0, None), (2, 1, "> nothing known here at all\nyes"), (None, 0, "x"), (3, 0, "> Hello there my friend.\nother talk")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, text string, Depth int")
    got = {(r.conv_id, r.turn): r for r in threads.reply_order(df).collect()}
    assert [got[1, t].parent_turn for t in range(5)] == [None, 0, 1, None, 0]
    assert [got[1, t].depth for t in range(5)] == [0, 1, 2, 0, 1] and [got[1, t].position for t in range(5)] == [0, 1, 2, 4, 3]
    assert got[1, 2].text == "Thanks for the answer." and got[1, 4].text == "Rewrapped reply." and got[2, 0].text is None
    assert got[2, 1].parent_turn is None and got[3, 0].parent_turn is None and got[None, 0].position == 0
    assert threads.reply_order(df.limit(0)).count() == 0


def test_long_reply_chains(spark):
    rows = [(1, 0, "message number 0 says this")] + [
        (1, t, f"> message number {t - 1} says this\nmessage number {t} says this") for t in range(1, 40)]
    got = threads.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()
    assert all((r.depth, r.thread_turn, r.position) == (r.turn, 0, r.turn) for r in got)


def test_repeated_messages_stay(spark):
    rows = [(1, 0, "the same words twice here")] * 2 + [(1, 1, "> the same words twice here\nok")]
    got = threads.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()
    assert sorted(r.position for r in got) == [0, 1, 2] and [r.parent_turn for r in got if r.turn == 1] == [0]


# ---- pipeline ----

def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.saved(stage(spark, docs, sf), "test-stage")
        assert out.columns == docs.columns, name
        sizes.append(out.count())
        docs = out
    assert 0 < sizes[3] <= sizes[2] <= sizes[1] == sizes[0] < 200
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    check_packing(packed, [(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("rows", [[], [(1, None, None), (None, "", "s")]])
def test_pipeline_on_nothing(spark, sf, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
