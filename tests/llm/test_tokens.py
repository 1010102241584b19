"""Pieces, prefix counts, packing and archives against the tokenizers library and brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rallyframe.llm import packing, rans, token_counts
from rallyframe.llm.pieces import PieceEncoder

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = ["foo", "bar", "'ll", "  ", "\n", "\t", " ", " ", "é", "<|endoftext|>", "<|ENDOFTEXT|>", "0", "12", "!!", "\x02", "\x85", "'s", "á", "Σ", "ΑΣ", " ", "日本", "🙂", "́"]
EDGES = ["", " ", "\n", "  ", "a", " a", "a ", "\na", "a\n", "a \nb", "a\n b", "don't  stop"]


def texts(n, seed=1):
    rng = random.Random(seed)
    return EDGES + ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))) for _ in range(n)]


@pytest.fixture
def docs(spark):
    rng = random.Random(2)
    own = texts(60) + [None, None, " ".join(rng.choice(["the", "of", "strange", "words"]) for _ in range(5000))]
    rows = [(i, t, "x", i, i) for i, t in enumerate(own)] + [(5, "a", "x", 1, 1), (5, "a", "x", 1, 1), (None, "without id", "x", 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, length string, piece int, _rank long").repartition(3)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_ids_are_the_librarys(path):
    library, coder, own = Tokenizer.from_file(path), PieceEncoder(path, limit=500), texts(1500)
    for part in (own, own[::-1]):  # the table is emptied on the way
        ids, counts = coder.encode(pa.array(part))
        ends = np.cumsum(counts)
        for t, e, n in zip(part, ends, counts, strict=True):
            assert ids[e - n : e].tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_profiles_are_exact_at_every_prefix(spark, docs):
    library = Tokenizer.from_file(BYTES)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    small = docs.filter(F.coalesce(F.length("text"), F.lit(0)) < 200)
    rows = token_counts.count_prefixes(small, BYTES, budgets=(3,), profile=True)
    cut = rows.withColumns({"at2": token_counts.tokens_at(F.col("profile"), 2), "fit": token_counts.longest_prefix(F.col("profile"), 3)})
    own = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in small.select("doc_id", "text").collect())
    found = sorted(cut.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"]))
    assert len(own) == len(found)
    for (_, _, t), r in zip(sorted(own, key=lambda x: (x[0], x[1], len(x[2].encode()))), found, strict=True):
        wanted = [count(t[:i]) for i in range(len(t) + 1)]
        assert r["profile"] == wanted, repr(t)
        assert (r["n_bytes"], r["n_tokens"]) == (len(t.encode()), wanted[-1])
        assert r["fit_3"] == r["fit"] == max(i for i, n in enumerate(wanted) if n <= 3)
        assert r["at2"] == wanted[min(2, len(t))]


def test_long_unbroken_texts_are_exact():
    rng = random.Random(4)
    library, counter = Tokenizer.from_file(BYTES), token_counts.PrefixCounter(BYTES)
    signs = ["QmFzZTY0", "abcdefgh", "the", "日本語", "中", "ไทย", "'ll", "'r", "é", "7", "<div>", "==", "\t", "\t\t", "🙂"]
    own = ["".join(rng.choice(signs) for _ in range(200)), "a" * 400, "中文" * 150, " " * 300 + "x", "ab\t  \n" * 80 + "foo  bar", "short " + "語" * 300 + " words <b> " + "x" * 300]
    own += [own[0] + "<|endoftext|>" + own[1], "z"]
    counts, bounds = counter.profiles(pa.array(own))
    for t, a, b in zip(own, bounds, bounds[1:]):
        assert counts[a:b].tolist() == [len(library.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)], repr(t[:20])
    text = "".join(rng.choice(["漢", "字", "日", "本", "語", "の", "文"]) for _ in range(1_000_000))
    counts, bounds = counter.profiles(pa.array([text]))
    assert len(counts) == 1_000_001
    for i in (1, 999, 70_000, 1_000_000):
        assert counts[i] == len(library.encode(text[:i], add_special_tokens=False).ids)


class Counted:
    """A tokenizer that counts the calls it gets."""

    def __init__(self, own):
        self.own, self.calls = own, 0

    def __getattr__(self, name):
        self.calls += 1
        return getattr(self.own, name)


def test_many_words_are_counted_side_by_side(monkeypatch):
    monkeypatch.setattr(token_counts, "PAIR_BITS", 8, raising=False)  # pairs push each other out
    rng = random.Random(8)
    library, counter = Tokenizer.from_file(BYTES), token_counts.PrefixCounter(BYTES)
    counter.merges = Counted(counter.merges)
    parts = ["the", "ing", "qu", "ß", "ü", "ñ", "É", "ion", "x", "Z", "ſ", "Ƿ", "str", "a"]
    words = ["".join(rng.choices(parts, k=rng.randint(1, 9))) + rng.choice(["", "", ",", ".'", "***", "(#)"]) for _ in range(6000)]
    own = [rng.choice(["", " ", "\n"]) + "".join(w + rng.choice([" ", " ", "\n"]) for w in words[i : i + 20]) + "end" for i in range(0, len(words), 20)]
    counts, bounds = counter.profiles(pa.array(own))
    assert counter.merges.calls < 1000  # asked by batches, not word by word or pair by pair
    for t, a, b in zip(own, bounds, bounds[1:]):
        assert b - a == len(t) + 1
        for i in rng.sample(range(len(t) + 1), 60):
            assert counts[a + i] == len(library.encode(t[:i], add_special_tokens=False).ids), repr(t[:i])


def test_counts_of_an_empty_table(spark, docs):
    assert token_counts.count_prefixes(docs.limit(0), BYTES).collect() == []


def test_packing_is_whole_gapless_and_tight(spark, docs):
    library, capacity = Tokenizer.from_file(WORDS), 64
    rows = packing.pack(docs, WORDS, capacity).collect()
    wanted = []
    for r in docs.collect():
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        wanted += [(r["doc_id"], k, k * capacity, len(ids[k * capacity : (k + 1) * capacity]), zlib.crc32(ids[k * capacity : (k + 1) * capacity].tobytes())) for k in range(-(-len(ids) // capacity))]
    key = lambda x: (x[0] is None, *(v or 0 for v in x))
    assert sorted([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows], key=key) == sorted(wanted, key=key)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) <= -(-sum(r["length"] for r in rows) // capacity) + 1
    assert packing.pack(docs.limit(0), WORDS, capacity).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_plans_use_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    lengths, n = np.unique(np.minimum(2048, rng.lognormal(6, 1.2, 4000).astype(int) + 1), return_counts=True)
    plan = packing.plan(dict(zip(lengths.tolist(), n.tolist(), strict=True)))
    used = np.zeros(2049, int)
    for own, times in plan:
        assert sum(own) <= 2048
        for x in own:
            used[x] += times
    assert (used[lengths] == n).all() and used.sum() == n.sum()
    assert sum(times for _, times in plan) <= 1.01 * -(-int((lengths * n).sum()) // 2048) + 1
    assert packing.plan({}) == []


def test_nnls_meets_the_optimum():
    rng = np.random.default_rng(0)
    a, x = rng.random((12, 30)), np.maximum(0, rng.normal(size=30))
    b = a @ x
    assert np.abs(a @ packing.nnls(a, b, 200) - b).max() < 1e-6


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, rans.CHECKPOINT + 3, rans.BLOCK + 5])
def test_segments_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 50_000).astype(np.uint32)
    if not n:
        ids = np.zeros(1, np.uint32)
    data = rans.encode_segment(ids)
    assert (rans.decode_segment(data) == ids).all()
    for at in (0, len(data) // 2, len(data) - 1):
        with pytest.raises(ValueError):
            rans.decode_segment(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])


def test_decoding_may_begin_at_any_checkpoint():
    symbols = np.random.default_rng(1).integers(0, 300, rans.BLOCK)
    freq = rans.frequencies(np.bincount(symbols), 14)
    block = rans.encode_block(symbols, freq, 14)
    assert freq.sum() == 1 << 14 and freq.min() >= 1
    for mark in range(rans.BLOCK // rans.CHECKPOINT):
        assert (rans.decode_block(block, freq, 14, mark) == symbols[mark * rans.CHECKPOINT :]).all()


def test_archives_round_trip(spark, docs):
    library = Tokenizer.from_file(BYTES)
    rows = rans.read_archive(rans.write_archive(docs, BYTES)).collect()
    own = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or ""))
    start, wanted = 0, []
    for r in own:
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        wanted.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == wanted
    assert rans.read_archive(rans.write_archive(docs.limit(0), BYTES)).collect() == []


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_long_pieces_have_the_librarys_ids(path):
    rng = random.Random(6)
    library, coder = Tokenizer.from_file(path), PieceEncoder(path)
    own = ["".join(rng.choices("abcXYZ0123'+/=é", k=300_000)), "a" * 100_000 + "9b", "語" * 70_000]
    ids, counts = coder.encode(pa.array(own))
    ends = np.cumsum(counts)
    for t, e, n in zip(own, ends, counts, strict=True):
        assert ids[e - n : e].tolist() == library.encode(t, add_special_tokens=False).ids


def test_stretches_of_a_segment_are_decoded_alone():
    ids = (np.random.default_rng(3).zipf(1.3, rans.BLOCK + 2 * rans.CHECKPOINT + 5) % 50_000).astype(np.uint32)
    data = rans.encode_segment(ids)
    for a, b in [(0, 1), (5, rans.CHECKPOINT), (rans.CHECKPOINT - 1, rans.CHECKPOINT + 1), (rans.BLOCK - 2, rans.BLOCK + 2), (len(ids) - 3, len(ids)), (7, 7)]:
        assert (rans.decode_segment(data, a, b) == ids[a:b]).all()
    spoilt = bytearray(data)
    spoilt[-99] ^= 1  # among the words of the last stretch but one, as the last has five tokens
    assert (rans.decode_segment(bytes(spoilt), 0, 9) == ids[:9]).all()
    with pytest.raises(ValueError):
        rans.decode_segment(bytes(spoilt), len(ids) - 9, len(ids) - 7)


def test_documents_are_fetched_from_archives(spark, docs):
    library, archive = Tokenizer.from_file(BYTES), rans.write_archive(docs, BYTES)
    rows = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["tokens"]) for r in rans.fetch(archive, spark.createDataFrame([(5,), (70,), (None,), (12345,)], "doc_id long")).collect())
    own = [(r["doc_id"] is not None, r["doc_id"] or 0, [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]) for r in docs.collect() if r["doc_id"] in (5, 70, None)]
    assert rows == sorted(own)
    broken = archive.withColumn("lengths", F.transform("lengths", lambda x: x + 1))
    with pytest.raises(Exception, match="damaged"):
        rans.read_archive(broken).collect()
