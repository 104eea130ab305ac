import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from corroba.llm import packing, rans, token_counts
from corroba.llm.tokens import PartCache, tokenizer_path

BYTES, WORDS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
PARTS = [" ", "  ", "\n", "\t", " \n", "a", "the", "Straße", "É", "é", "́", "<|endoftext|>", "<|", "it's", "'S", "12", "3.5", " ", "\xa0", "漢字", "🙂", "\x1c", ".", "!!", "\r\n", "ΑΣ", "İ", "\x00", "_", "÷", "ª"]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_parts_give_the_ids_of_whole_texts(path):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(14))) for _ in range(8000)]
    cache, whole = PartCache(path, "ids"), Tokenizer.from_file(path)
    got = [x for i in range(0, len(texts), 100) for x in cache.ids(texts[i : i + 100])]
    want = [np.array(e.ids, "<u2").tobytes() for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert got == want


def test_token_counts(spark, odd, nothing):
    whole = Tokenizer.from_file(BYTES)
    for r, given in zip(token_counts.count_tokens(odd, BYTES, limit=100).collect(), odd.collect()):
        text = given.text or ""
        assert (r.doc_id, r.n_bytes, r.n_tokens) == (given.doc_id, len(text.encode()), len(whole.encode(text, add_special_tokens=False).ids))
        assert r.over_limit == (r.n_tokens > 100)
    assert token_counts.count_tokens(nothing, BYTES).count() == 0


def test_token_count_query(spark, sf_dir, texts):
    whole = Tokenizer.from_file(BYTES)
    got = {r.doc_id: r.n_tokens for r in token_counts.op7_token_counts(spark, sf_dir).collect()}
    assert got == {i: len(whole.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}


@pytest.mark.parametrize("n", [1, 31, 33, rans.BLOCK, rans.BLOCK + 1, 100_000])
def test_coder_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.2, n) % 49_000).astype(np.int32)
    freq = rans.scaled(np.bincount(ids, minlength=1 << 16))
    assert freq.sum() == 1 << rans.SCALE
    start = np.cumsum(freq) - freq
    blocks = rans.encode_blocks(ids, freq, start)
    sizes = [min(rans.BLOCK, n - at) for at in range(0, n, rans.BLOCK)]
    assert (rans.decode_blocks(blocks, sizes, freq, start, np.repeat(np.arange(1 << 16, dtype=np.int32), freq)) == ids).all()


def test_token_files(spark, odd, nothing, tmp_path):
    whole = Tokenizer.from_file(WORDS)
    tokens = rans.tokenise(odd.filter("doc_id IS NOT NULL"), WORDS)
    rans.write_ids(tokens, str(tmp_path / "a"), rans.frequencies(tokens))
    got = sorted(rans.read_ids(spark, str(tmp_path / "a"), with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [1, 2, 3, 4, 5, 6, 6, 7, 8]
    at, by_id = 0, {r.doc_id: r.text for r in odd.collect()}
    for r in got:
        ids = np.array([*whole.encode(by_id[r.doc_id] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32, r.ids) == (at, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        at += len(ids)
    tokens = rans.tokenise(nothing, WORDS)
    rans.write_ids(tokens, str(tmp_path / "b"), rans.frequencies(tokens))
    assert rans.read_ids(spark, str(tmp_path / "b")).count() == 0


def test_token_id_query(spark, sf_dir, texts):
    whole = Tokenizer.from_file(WORDS)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rans.op8_token_ids(spark, sf_dir).collect()}
    at = 0
    for doc in sorted(texts):
        ids = np.array([*whole.encode(texts[doc] or "", add_special_tokens=False).ids, 1], "<u4")
        assert got.pop(doc) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert not got


def test_rows_without_an_id_come_first(spark, odd, tmp_path):
    tokens = rans.tokenise(odd, WORDS)
    rans.write_ids(tokens, str(tmp_path / "a"), rans.frequencies(tokens))
    got = sorted(rans.read_ids(spark, str(tmp_path / "a")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 4, 5, 6, 6, 7, 8]


def test_damage_is_found(spark, odd, tmp_path):
    from pyspark.sql import functions as F

    tokens = rans.tokenise(odd.filter("doc_id = 7"), WORDS)
    rans.write_ids(tokens, str(tmp_path / "a"), rans.frequencies(tokens))
    groups = spark.read.parquet(str(tmp_path / "a/groups")).withColumn("block_crcs", F.transform("block_crcs", lambda x: x + 1))
    groups.write.parquet(str(tmp_path / "b/groups"))
    spark.read.parquet(str(tmp_path / "a/table")).write.parquet(str(tmp_path / "b/table"))
    with pytest.raises(Exception, match="damaged block"):
        rans.read_ids(spark, str(tmp_path / "b")).collect()


def check_packing(rows, ids_of):
    """Each id of each document in one piece, sequences without gaps; returns how full they are."""
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        documents[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= packing.SEQUENCE
    for doc, pieces in documents.items():
        ids, at = ids_of(doc), 0
        for start, length, crc, n in sorted(pieces):
            assert start == at and n == len(ids) and crc == zlib.crc32(ids[at : at + length].tobytes())
            at += length
        assert at == len(ids)
    return sum(r.length for r in rows) / (packing.SEQUENCE * len(sequences)), set(documents)


def test_packing_query(spark, sf_dir, texts):
    whole = Tokenizer.from_file(BYTES)
    full, docs = check_packing(packing.op5_packing(spark, sf_dir).collect(), lambda d: np.array([*whole.encode(texts[d], add_special_tokens=False).ids, 1], "<u4"))
    assert docs == set(texts) and full > 0.97


def test_packing_of_odd_rows(spark, odd, nothing):
    whole = Tokenizer.from_file(BYTES)
    given = odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    by_id = {r.doc_id: r.text or "" for r in given.collect()}
    _, docs = check_packing(packing.pack(given, BYTES).collect(), lambda d: np.array([*whole.encode(by_id[d], add_special_tokens=False).ids, 1], "<u4"))
    assert docs == set(by_id)
    assert packing.pack(odd, BYTES).filter("doc_id = 6").count() == 2
    assert packing.pack(nothing, BYTES).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plans_use_every_piece_once(seed):
    rng = random.Random(seed)
    histogram = {c: rng.randrange(1, 400) for c in range(1, 257) if rng.random() < 0.5}
    plan = packing.plan_patterns(histogram)
    used = defaultdict(int)
    for items, n in plan:
        assert n > 0 and sum(c * k for c, k in items.items()) <= 256
        for c, k in items.items():
            used[c] += n * k
    assert used == histogram
    # first-fit decreasing is never better
    left, ffd = dict(histogram), 0
    while any(left.values()):
        room = 256
        for c in sorted(left, reverse=True):
            k = min(left[c], room // c)
            left[c] -= k
            room -= k * c
        ffd += 1
    assert sum(n for _, n in plan) <= ffd + 2
