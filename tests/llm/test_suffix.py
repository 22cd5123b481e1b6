"""Repeated strings against counting every window."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import queries
from tidemark.llm.suffix import anchors, dedup_strings, longest_previous, merged


def brute(texts, length):
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        out.append(merged([(i, i + length) for i in range(len(t) - length + 1) if counts[t[i : i + length]] > 1]))
    return out


def some_texts(seed, alphabet):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    shared = [word(rng.randrange(20, 90)) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.4 else word(rng.randrange(1, 60)) for _ in range(rng.randrange(0, 6))]
        texts.append("".join(parts))
    return texts + texts[:4] + ["", "abc" * 60, "x" * 90, "ü" * 40]


def test_longest_previous_factor():
    rng = random.Random(3)
    for turn in range(40):
        n = rng.randrange(30, 150)
        data = bytes(rng.choice(b"ab" if turn % 2 else b"abcd") for _ in range(n))
        depth = rng.choice([8, 11, 20])
        starts = np.array(sorted(rng.sample(range(n - depth + 1), rng.randrange(1, n - depth + 1))))
        lpf, source = longest_previous(np.frombuffer(data, np.uint8), starts, depth)
        for i, s in enumerate(starts.tolist()):
            common = [0]
            for t in starts[:i].tolist():
                k = 0
                while k < depth and data[s + k] == data[t + k]:
                    k += 1
                common.append(k)
            assert lpf[i] == max(common)
            assert lpf[i] == 0 or data[s : s + lpf[i]] == data[source[i] : source[i] + lpf[i]] and source[i] < s


def test_every_string_has_one_anchor_that_it_chooses():
    text = random.Random(1).randbytes(3000)
    _, place, first, last = anchors(text, 40, 16)
    assert first.tolist() == [0, *(last[:-1] + 1).tolist()] and last[-1] == len(text) - 40
    moved = anchors(b"zz" + text[500:1500], 40, 16)
    there = {int(s): int(p) for p, a, b in zip(place, first, last) for s in range(a, b + 1)}
    for p, a, b in zip(*moved[1:]):
        for s in range(max(a, 2), b + 1):
            assert there[s - 2 + 500] == p - 2 + 500


@pytest.mark.parametrize("hot", [4096, 2])
@pytest.mark.parametrize("alphabet", ["ab", "abcdefghijklmnop"])
def test_all_copies_go(spark, hot, alphabet):
    texts = some_texts(11, alphabet)
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, None), (7, texts[7])]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, row int")
    got = dedup_strings(docs, length=24, gram=8, keep_first=False, hot=hot).collect()
    raw = [(t or "").encode() for _, t in rows]
    want = sorted((-1 if i is None else i, len(t), spans) for (i, _), t, spans in zip(rows, raw, brute(raw, 24)))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, [(s["start"], s["end"]) for s in r.spans]) for r in got) == want
    assert {r.doc_id: bytes(r.kept) for r in got}[len(texts) - 3] == b""  # "abc" repeated


def test_first_copies_stay(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage = word(80)
    docs = spark.createDataFrame([(i, f"{word(30)}{i}{passage}{i}{word(30)}") for i in range(5)] + [(9, passage + "-" + passage)], "doc_id long, text string")
    got = dedup_strings(docs, length=24, gram=8).collect()
    left = b"\n".join(bytes(r.kept) for r in got)
    assert left.count(passage.encode()) == 1
    assert sum(r.n_bytes for r in got) - sum(len(r.kept) for r in got) == 6 * 80


def test_query_and_empty_table(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    raw = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    spans = dict(zip(raw, brute(list(raw.values()), 200)))
    for r in queries.QUERIES["op7_suffix_array_dedup"](spark, "/root/testdata/sf0.001").collect():
        gone, text = spans[r.doc_id], raw[r.doc_id]
        edges = [0, *[x for s in gone for x in s], len(text)]
        kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(text), sum(b - a for a, b in gone), len(gone))
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()
    assert dedup_strings(docs.limit(0)).count() == 0
