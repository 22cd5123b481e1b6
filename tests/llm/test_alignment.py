"""Cross-tokenizer alignment against brute force, and in odd cases."""

import hashlib
import random
import time

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import alignment, tokens
from tidemark.llm.common import Scratch

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def slow_tokens(text):
    """(id, start, end) of both tokenizations, or None when either does not spell the space and the text."""
    if not text:
        return None
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    want = (" " + text).encode()
    sides = []
    for ids, table in ((tok.encode(" " + text, add_special_tokens=False).ids, tokens.byte_bpe_bytes(A)), (model.encode(text), tokens.piece_bytes(B))):
        at, spans = 0, []
        for i in ids:
            spans.append((i, at, at + len(table[i])))
            at += len(table[i])
        if b"".join(table[i] for i in ids) != want:
            return None
        sides.append(spans)
    return sides


def slow_align(texts):
    found = [slow_tokens(t) for t in texts]
    links = []
    for f in found:
        links.append([] if f is None else [(a, b) for a, s, e in f[0] for b, s2, e2 in f[1] if s < e2 and s2 < e])
    count = {}
    for ls in links:
        for p in set(ls):
            count[p] = count.get(p, 0) + 1
    top = {}
    for (a, _), c in count.items():
        top[a] = max(top.get(a, 0), c)
    out = []
    for f, ls in zip(found, links):
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        ends_a, ends_b = {e for _, _, e in f[0]}, {e for _, _, e in f[1]}
        cuts = sorted(ends_a & ends_b)
        groups, lo = [], 0
        for c in cuts:
            ga = [str(i) for i, s, e in f[0] if lo < e <= c]
            gb = [str(i) for i, s, e in f[1] if lo < e <= c]
            groups.append(",".join(ga) + "|" + ",".join(gb))
            lo = c
        out.append((len(f[0]), len(f[1]), len(cuts), len(ls), sum(count[p] == top[p[0]] for p in ls), sum(count[p] for p in ls),
                    hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


TEXTS = [None, "", "hello world", "Hello  world\n\nagain <s> and <|endoftext|> too", "naïve café, déjà vu — 東京 🎉", "the the the", "hello world",
         "x" * 3000, "  leading and trailing  ", "tab\tand\r\nlines", "12345 678.9 $%^&*", "ünïcödé wörds ünïcödé"]


def test_alignment_matches_brute_force(spark):
    rows = [(i if i != 4 else None, t, "clash", 1) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, kind int").repartition(3)
    got = alignment.align_texts(docs, A, B, scratch=Scratch(spark, "t")).collect()
    want = dict(zip([r[0] for r in rows], slow_align(TEXTS)))
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == want[r.doc_id], r.doc_id


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align_texts(docs, A, B, scratch=Scratch(spark, "t")).count() == 0


def test_array_work_costs_no_more_than_the_encoders():
    """On long texts; written groups put together token by token in Python took more than twice the encoders' time."""
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(600)) for _ in range(300)]

    def both():
        tokens.encode_bytes_bpe(A, alignment.PATTERN, [" " + t for t in texts], plain_specials=True)
        tokens.piece_model(B).encode(texts, num_threads=1)

    def least(work):
        times = []
        for _ in range(4):
            began = time.process_time()
            work()
            times.append(time.process_time() - began)
        return min(times)

    assert least(lambda: alignment.align_batch(texts, A, B)) < 2.4 * least(both)
