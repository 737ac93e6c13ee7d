"""Whole-text encoding, token files and packing against the tokenizers library itself."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidelab.llm import packing, records, tokens
from tidelab.llm.common import scratch_dir, stored
from tidelab.llm.tokens import WordwiseEncoder

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def plain(path):
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return lambda text: tok.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize(("path", "kind"), [(BYTES, "bytes"), (WORDS, "words")])
def test_wordwise_equals_whole(path, kind):
    rnd = random.Random(3)
    parts = ["a", "é", "é", " ", "  ", "\n", "\t", "\x1c", "'s", "don't", "12", "!!", "|", "\x01", "\x00", "ΑΣ",
             "​", "<|endoftext|>", "Ġ", "漢字", "\r\n", "😀", " ", " b", " "]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 24))) for _ in range(1500)]
    enc = WordwiseEncoder(path, kind, capacity=500)
    one = plain(path)
    for at in range(0, len(texts), 300):
        for text, ids in zip(texts[at : at + 300], enc.encode(texts[at : at + 300]), strict=True):
            assert np.frombuffer(ids, enc.dtype).tolist() == one(text), repr(text)


def expect_records(rows):
    one, at, out = plain(BYTES), 0, []
    for doc_id, text in rows:
        ids = np.array([*one(text), 2], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_records_round_trip(spark, documents):
    got = [tuple(r) for r in records.token_records(spark, documents, BYTES).orderBy("doc_id").collect()]
    want = expect_records([(r.doc_id, r.text) for r in documents.orderBy("doc_id").collect()])
    assert got == want


def test_records_odd_rows_and_shuffled_reads(spark, odd_documents):
    path = scratch_dir(spark, "t-records")
    records.write_records(odd_documents, path, BYTES)
    index = records.build_index(spark, path)
    table = records.token_table(index).collect()
    assert len(table) == 10
    starts = sorted((r.start, r.n_tokens) for r in table)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False)) and starts[0][0] == 0
    ids = [r.doc_id for r in sorted(table, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    one = plain(BYTES)
    want = sorted([*one(r.text), 2] for r in odd_documents.collect() if r.doc_id in (1, 7))
    some = records.read_at(index.where("doc_id in (1, 7)"), path).collect()
    assert sorted(r.ids for r in some) == want


def test_records_detect_damage():
    good = records.frame(5, np.array([1, 2, 3], "<u2").tobytes(), 2)
    assert records.unframe(good, 0)[0] == 5
    for at in (0, 5, 12, len(good) - 3):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(Exception, match="damaged|unpack"):
            records.unframe(bytes(bad), 0)


def test_records_empty(spark, no_documents):
    assert records.token_records(spark, no_documents, BYTES).count() == 0


def check_packed(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        held.sort()
        assert held[0][0] == 0 and sum(n for _, n in held) <= capacity
        assert all(a + n == b for (a, n), (b, _) in zip(held, held[1:], strict=False))
    return len(bins)


def test_packing_pieces_and_bins(documents):
    rows = packing.pack_documents(documents, WORDS).collect()
    one = plain(WORDS)
    want = {}
    for d in documents.collect():
        ids = np.array([*one(d.text), 0], "<u4")
        for no, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[d.doc_id, no] = (at, len(part), zlib.crc32(part.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    assert len(rows) == len(want)
    used = check_packed(rows, 2048)
    assert used <= -(-sum(r.length for r in rows) // 2048) + 1


def test_packing_many_blocks(spark):
    rnd = random.Random(1)
    sizes = [rnd.randint(1, 100) for _ in range(3000)]
    rows = packing.pack(spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "k long, length long"), 100, block_pieces=400)
    got = rows.collect()
    assert sorted(r.k for r in got) == list(range(3000))
    assert check_packed(got, 100) <= 1.02 * packing.least_bins(np.array(sizes), 100)


def test_packing_odd_rows_and_empty(odd_documents, no_documents):
    rows = packing.pack_documents(odd_documents, WORDS).collect()
    assert len({id(r) for r in rows}) == len(rows) and sum(r.doc_id == 1 for r in rows) == 2
    assert sum(r.doc_id is None for r in rows) == 2 and [r.length for r in rows if r.doc_id == 3] == [1]
    check_packed(rows, 2048)
    assert packing.pack_documents(no_documents, WORDS).count() == 0
    with pytest.raises(ValueError, match="in use"):
        packing.pack(odd_documents.selectExpr("doc_id as block", "n_chars as length"))


def test_genetic_operators_keep_every_item():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 60, 200)
    none, no_room = np.full(200, -1), np.zeros(0, np.int64)
    a = packing.best_fit(sizes, np.argsort(-sizes), none, no_room, 100)
    b = packing.best_fit(sizes, rng.permutation(200), none, no_room, 100)
    for _ in range(50):
        child = packing.crossover(sizes, a, b, 100, rng)
        assert child.min() == 0 and packing.fills(sizes, child).max() <= 100 and (np.bincount(child) > 0).all()
        child = packing.mutate(sizes, child, 100, rng)
        assert packing.fills(sizes, child).max() <= 100 and (np.bincount(child) > 0).all()
        a = child


def test_packed_sequences_hold_their_ids(spark, documents, odd_documents):
    """The ids of a sequence's rows, in a row, are gapless, and the pieces of a document its tokens."""
    docs = documents.select("doc_id", "text").unionByName(odd_documents.select("doc_id", "text").where("doc_id = 1 or doc_id is null"))
    want = sorted(
        (r.doc_id is None, r.doc_id or 0, r.piece, r.ids)
        for r in packing.cut_pieces(docs, WORDS, with_ids=True).collect()
    )
    rows = packing.pack_documents(docs, WORDS).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.ids) for r in rows) == want
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    full, last = {}, None
    for r in rows:
        assert r.sequence_id == last or r.sequence_id not in full
        last = r.sequence_id
        assert len(full.setdefault(last, b"")) == 4 * r.offset
        full[last] += r.ids
    assert max(map(len, full.values())) <= 4 * 2048


def test_ids_are_shuffled_once_to_many_blocks(spark, documents, monkeypatch):
    """The ids meet their places block by block, without a join before or a shuffle after; sequences packed
    across blocks lie together too."""
    docs, plans = documents.select("doc_id", "text"), {}

    def spy(df, name, **options):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return stored(df, name, **options)

    monkeypatch.setattr(packing, "stored", spy)
    rows = packing.pack_documents(docs, WORDS, block_pieces=20).collect()
    assert "Join" not in plans["sequences"] and "Repartition" not in plans["sequences"]
    assert len({r.sequence_id % 4 for r in rows}) >= 2 and any(r.sequence_id % 4 == 2 for r in rows)
    want = [(r.doc_id, r.piece, r.start, r.ids) for r in packing.cut_pieces(docs, WORDS, with_ids=True).collect()]
    assert sorted((r.doc_id, r.piece, r.start, r.ids) for r in rows) == sorted(want)
    check_packed(rows, 2048)
    seen, last = {}, None
    for r in rows:
        assert r.sequence_id == last or r.sequence_id not in seen
        last = r.sequence_id
        assert seen.setdefault(last, 0) == r.offset
        seen[last] += r.length


def test_plain_texts_are_not_searched_for_wide_space(monkeypatch):
    class Never:
        def search(self, text):
            raise AssertionError(text)

    enc, one = WordwiseEncoder(BYTES, "bytes"), plain(BYTES)
    monkeypatch.setattr(tokens, "_WIDE_SPACE", Never())
    texts = ["one two\nthree, Two.", "", "é 漢字", "one"]
    assert [np.frombuffer(b, enc.dtype).tolist() for b in enc.encode(texts)] == [one(t) for t in texts]


def test_stored_leaves_no_shuffle_files(spark):
    def held():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before = held()
    kept, _ = stored(spark.range(1000).selectExpr("id % 7 as k", "id").groupBy("k").count().repartition(3, "count"), "t-shuffles")
    assert not held() - before and len(kept.collect()) == 7
