"""Best-fit packing against brute force, and in odd cases."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing
from tidemark.llm.common import Scratch

BPE = public_tokenizers.path("byte_bpe_50k.json")


def fullest(pool, capacity):
    """The largest sum of a subset of ``pool`` that fits, by trying every subset."""
    best = 0
    for r in range(len(pool) + 1):
        for c in itertools.combinations(pool, r):
            if best < sum(c) <= capacity:
                best = sum(c)
    return best


@pytest.mark.parametrize("seed", range(12))
def test_each_bin_is_the_fullest_subset_left(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 16, 31])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 13))]
    bins, offsets = packing.min_bin_slack(np.array(lengths, dtype=np.int64), capacity)
    pool = list(range(len(lengths)))
    for b in range(len(set(bins.tolist()))):
        inside = [i for i in pool if bins[i] == b]
        assert sum(lengths[i] for i in inside) == fullest([lengths[i] for i in pool], capacity)
        spans = sorted((offsets[i], offsets[i] + lengths[i]) for i in inside)
        assert spans[0][0] == 0 and all(a[1] == b_[0] for a, b_ in zip(spans, spans[1:]))
        pool = [i for i in pool if bins[i] != b]
    assert not pool


def test_lengths_out_of_range():
    with pytest.raises(ValueError):
        packing.min_bin_slack(np.array([0, 3]), 4)
    assert packing.min_bin_slack(np.array([], dtype=np.int64), 4)[0].size == 0


def test_cut():
    assert packing.cut(1, 4) == [(0, 1)]
    assert packing.cut(4, 4) == [(0, 4)]
    assert packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]
    assert packing.cut(8, 4) == [(0, 4), (4, 4)]


def test_documents_are_packed_whole(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 7)  # several groups
    tok = Tokenizer.from_file(BPE)
    rng = random.Random(3)
    texts = [None, "", "hello world", "<|endoftext|> inside", "x" * 5000, "naïve café " * 700] + [" ".join("ab cd ef gh".split()[: rng.randint(1, 4)] * rng.randint(1, 60)) for _ in range(30)]
    rows = [(i if i != 3 else None, t, "clash", 1) for i, t in enumerate(texts)] + [(7, texts[7], "clash", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, offset int")
    got = packing.pack_documents(docs, BPE, capacity=64, end_id=2, scratch=Scratch(spark, "t")).collect()
    want, seen = {}, {}
    for doc, t, _, _ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        for p, (s, n) in enumerate(packing.cut(len(ids), 64)):
            want.setdefault((doc, p, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())), []).append(ids[s : s + n])
    for r in got:
        seen.setdefault((r.doc_id, r.piece, r.start, r.length, r.ids_crc32), []).append(r.ids)
    assert sorted(seen, key=repr) == sorted(want, key=repr)
    assert all(sorted(v) == sorted(want[k]) for k, v in seen.items())
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:])) and parts[-1][0] + parts[-1][1] <= 64
    total = sum(r.length for r in got)
    assert len(sequences) <= -(-total // 64) + -(-len(got) // 7)  # at most about one bin per group beyond the bound


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(docs, BPE, scratch=Scratch(spark, "t")).count() == 0


def test_fast_encoder_gives_the_ids_of_tokenizers():
    import pyarrow.parquet as pq

    from tidemark.llm import tokens

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0).to_pylist()]
    texts += ["a <|endoftext|>b", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "naïve  \n\n 東京 🎉\r\n\t x", "   ", "it's 'll", ""]
    tok = Tokenizer.from_file(BPE)
    assert tokens.encode_bytes_bpe(BPE, packing.PATTERN, texts) == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    tok.encode_special_tokens = True
    assert tokens.encode_bytes_bpe(BPE, packing.PATTERN, texts, plain_specials=True) == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
