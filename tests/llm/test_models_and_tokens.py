"""Chat formatting, exact search, pieces, the two classifiers and the pipeline."""

import hashlib
import heapq
import random
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import chat, pieces, quality, queries, topk, toxicity, training

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("text", ["", "<|im_end|>", "<\\|x", "a <| b <\\\\| c", "<<||>>", "ok"])
def test_escape_is_reversible_and_leaves_no_control_string(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


def test_conversations_read_back(spark):
    rng = random.Random(2)
    bits = ["<|im_end|>", "<|im_start|>assistant ok", "\n", " héllo", "🙂", "<\\|", "x", None, "", "\r\n "]
    rows = []
    for conv in [0, 5, None]:
        for turn in range(rng.randrange(1, 9)):
            text = rng.choice(bits)
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", None, "a\nb\\", "<|im_end|>"]), text and "".join(filter(None, rng.choices(bits, k=5)))))
    rows += [(7, 1, "assistant", "b"), (7, 1, "assistant", "b"), (7, None, "user", "a")]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, part string").repartition(5)
    for size in (1_000_000, 1):
        got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(turns, part_tokens=size)).collect()}
        assert set(got) == {0, 5, 7, None}
        for conv in got:
            own = sorted(((r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "") for r in rows if r[0] == conv))
            said = [(r[3], r[5]) for r in own]
            learned = "".join(t for role, t in said if role == "assistant")
            assert got[conv].n_turns == len(said) and got[conv].loss_chars == len(learned)
            assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
            assert got[conv].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    assert chat.read_back(chat.format_conversations(turns.limit(0))).count() == 0


def test_reserved_ids_only_where_turns_begin_and_end():
    ids, mask = chat.assemble([("user", "<|im_end|>"), ("assistant", "hi<|im_start|>")], chat.encoding(chat.RANKS))
    assert (ids == chat.START).sum() == (ids == chat.END).sum() == 2 and mask.sum() > 0
    assert chat.unescape(chat.encoding(chat.RANKS).decode(ids[mask == 1].tolist())) == "hi<|im_start|>"


@pytest.mark.parametrize("block", [4096, 3])
def test_top_inner_products(spark, block):
    rng = np.random.default_rng(3)
    vectors = [(i, np.floor(rng.normal(0, 40, 32)).tolist()) for i in range(90)]
    vectors += [(90 + i, vectors[0][1]) for i in range(4)] + [(200, None), (201, [float("nan")] * 32), (202, [None] * 32), (203, [1.0, 2.0]), (None, vectors[1][1]), (10, vectors[3][1])]
    frame = spark.createDataFrame([(*v, 1.0) for v in vectors], "vec_id long, vec array<double>, score double").repartition(4)
    got = topk.top_inner_products(frame, F.col("vec_id") % 5 == 0, k=5, block=block)
    good = [(i, v) for i, v in vectors if i is not None and v and all(x is not None and x == x for x in v)]
    want = set()
    for q in sorted({i for i, _ in good if i % 5 == 0}):
        own = min(v for i, v in good if i == q)
        near = sorted((-int(np.dot(own, v)), i) for i, v in good if i != q and len(v) == len(own))[:5]
        want |= {(q, n, i, -s) for n, (s, i) in enumerate(near, 1)}
    assert {tuple(r) for r in got.collect()} == want
    assert topk.top_inner_products(frame.limit(0), F.col("vec_id") % 5 == 0).count() == 0


def test_too_large_scores_are_refused(spark):
    frame = spark.createDataFrame([(0, [1e9, 1.0]), (1, [1e9, 1.0])], "vec_id long, vec array<double>")
    with pytest.raises(Exception, match="too large"):
        topk.top_inner_products(frame, F.col("vec_id") == 0).collect()


def every(vocabulary, word):
    out, edges = [], vocabulary.edges(word)

    def go(at, ids, score):
        if not at:
            out.append((score, ids))
        for i, j, s, piece in edges:
            if j == at:
                go(i, vocabulary.spell(word, i, piece) + ids, score + s)

    go(len(word), (), 0.0)
    return out


@pytest.mark.parametrize("word", [" hello", " the", " ciónado", "\n", " 😀a▁b", "  x", " aaaa"])
def test_best_segmentations_of_a_word(word):
    v = pieces.vocabulary(pieces.MODEL)
    want = heapq.nlargest(6, every(v, word))
    got = pieces.n_best(v, word, 6)
    assert [s for s, _ in got] == [s for s, _ in want] and len({i for _, i in got}) == len(got)
    ids, score, gap = v.best(word)
    assert score == want[0][0] and (len(want) < 2 or gap == want[0][0] - want[1][0])


def test_best_segmentations_of_a_text():
    v = pieces.vocabulary(pieces.MODEL)
    text = "then aba\n é"
    every_word = [every(v, w) for w in v.words.findall(" " + text)]
    sums = [0.0]
    for word in every_word:
        sums = heapq.nlargest(9, [s + x for s in sums for x, _ in word])
    ids, score, more = pieces.encode(v, text, 9)
    assert [score, *[s for s, _ in more]] == sums
    spelled = [ids.tolist(), *[pieces.with_edits(ids.tolist(), e) for _, e in more]]
    assert len({tuple(s) for s in spelled}) == 9 and all(pieces.decode(v, s) == text for s in spelled)


def test_texts_survive_encoding(spark):
    texts = [None, "", " ", "\n\n", "a▁b  c\t\x00", "日本語😀", " lead", "x" * 5000, "tie tie tie"]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, Score string, decoded int")
    got = {r.doc_id: r for r in pieces.decode_texts(pieces.encode_texts(docs)).collect()}
    assert [got[i].decoded for i in range(len(texts))] == [t or "" for t in texts]
    assert got[1].n_tokens == 0 and got[1].nbest == [] and len(got[8].nbest) == 3
    assert pieces.encode_texts(docs.limit(0)).count() == 0


def test_words_segmented_together_are_those_segmented_alone():
    rng = random.Random(41)
    texts = ["", " ", "\n\n \n", "a" * 64, "a" * 65, "漢" * 70, "x" + "é" * 64, "<0x41>▁ ▁", "\x00 \x01"]
    texts += ["".join(rng.choice("ab e é漢🙂\n\tthing.,  " + chr(rng.randrange(32, 0x3000))) for _ in range(rng.randrange(150))) for _ in range(300)]
    together, alone = pieces.Vocabulary(pieces.MODEL), pieces.Vocabulary(pieces.MODEL)
    one_by_one = []
    together.best = one_by_one.append  # not to be called
    together.known.segment = together.best
    for (ids, score, others), text in zip(pieces.encode_all(together, texts), texts, strict=True):
        by_text = pieces.encode(alone, text)
        assert ids.tolist() == by_text[0].tolist() and (score, others) == by_text[1:]
    assert not one_by_one


def test_few_remembered_words_give_the_same(monkeypatch):
    texts = [f"word{k % 7} other{k} and more, {k * k}" for k in range(200)]
    want = pieces.encode_all(pieces.Vocabulary(pieces.MODEL), texts)
    monkeypatch.setattr(pieces, "CACHED", 20)
    monkeypatch.setattr(pieces, "TOGETHER", 100)
    monkeypatch.setattr(pieces, "BLOCK", 3)
    got = pieces.encode_all(pieces.Vocabulary(pieces.MODEL), texts)
    assert [(a.tolist(), *b) for a, *b in got] == [(a.tolist(), *b) for a, *b in want]


def test_idle_workers_hold_no_words(spark):
    docs = spark.createDataFrame([(k, f"word{k} other{k}") for k in range(400)], "doc_id long, text string").repartition(8)
    assert pieces.encode_texts(docs).filter("n_tokens > 0").count() == 400

    def held(parts):
        for part in parts:
            v = pieces.vocabulary(pieces.MODEL)
            yield pa.record_batch([pa.array([len(v.known) + len(v.known.older) + len(v.ranked)] * part.num_rows, pa.int64())], ["n"])

    assert {r.n for r in spark.range(0, 64, 1, 8).mapInArrow(held, "n long").collect()} == {0}


def test_long_words_are_ranked_without_a_copy_of_the_tail_per_step():
    v = pieces.vocabulary(pieces.MODEL)
    rng = random.Random(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    for word in ["".join(rng.choices(letters, k=90)), "a" * 70 + "é🙂" + "b" * 20, "then" * 20]:
        want, got = pieces.n_best(v, word, 4), v.n_best(word, 4)
        assert [round(s, 6) for s, _ in got] == [round(s, 6) for s, _ in want] and len({i for _, i in got}) == 4
        assert all(b"".join(v.spelled[x] for x in i).decode() == word for _, i in got)
    tracemalloc.start()
    v.n_best("".join(rng.choices(letters, k=8000)), 4)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40e6  # 137 MB of tails before


def test_folding():
    same = {toxicity.fold(t) for t in ("idiot", "1D10T!", "ıdıоt", "ｉｄｉｏｔ", "i​diot", '"Idi0t,"')}
    assert len(same) == 1
    assert toxicity.fold("2024 50% привет") == " 2024 50 привет "


def test_exception_phrases_and_length():
    machine = toxicity.Lexicon({" scum ": 2.0, " scu": 1.0}, [" pond scum "], 1.0, 0.0).automaton()
    assert toxicity.burden(" pond scum ", machine) == 0.0
    assert toxicity.burden(" scum ", machine) > toxicity.burden(" scum " + "x " * 400, machine) > 0
    assert toxicity.burden(" ", toxicity.Lexicon({}, [], 1.0, 0.0).automaton()) == 0.0


def test_toxicity_learns_and_scores_odd_rows(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(80)]
    rows = [(i, " ".join([*rng.choices(words, k=40), *(["vilezz"] * (i % 2))]), i % 2) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (None, "v1lezz!")], "doc_id long, text string").withColumn("label", F.lit("x"))
    lexicon = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (900, None)], "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, lexicon).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, _, y in rows) and got[900] < 0.5 and got[901] < 0.5 and got[None] >= 0.5
    nothing = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(0 <= r.score < 0.5 for r in toxicity.score_toxicity(docs, nothing).collect())


def test_chunks_cover_documents():
    for size in (0, 1, 511, 512, 513, 900, 5000):
        starts = quality.chunk_starts(size)
        covered = set()
        for a in starts:
            covered |= set(range(a, min(a + quality.CHUNK, size)))
        assert covered == set(range(size)) and len(starts) >= 1


def test_max_pooling_reads_whole_documents():
    rng = np.random.default_rng(0)
    net = quality.Network(rng.normal(size=(quality.WIDTH, quality.SYMBOLS, quality.FILTERS)).astype(np.float32), np.zeros(quality.FILTERS, np.float32), np.ones(quality.FILTERS, np.float32), 0.0, np.array([1.0, 0.0, 0.0]))
    net.filters[:, quality.PAD] = 0
    texts = [b"", b"a", rng.integers(0, 256, 1700, np.uint8).tobytes(), b"spam " * 200]
    best, counts = net.maxima([quality.symbols(t) for t in texts])
    at = 0
    for t, n in zip(texts, counts):
        s = np.r_[quality.symbols(t), np.full(quality.WIDTH, quality.PAD)].astype(int)
        for a in quality.chunk_starts(len(t)):
            ends = min(a + quality.CHUNK, max(len(t), 1))
            want = np.max([sum(net.filters[k, s[i + k]] for k in range(quality.WIDTH)) for i in range(a, ends)], axis=0)
            assert np.allclose(best[at], want, atol=1e-4)
            at += 1
    assert at == counts.sum() == len(best)
    together, alone = net.scores([quality.symbols(t) for t in texts]), [net.scores([quality.symbols(t)])[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-5)


def test_quality_learns(spark, monkeypatch):
    monkeypatch.setattr(quality, "STEPS", 120)
    rng = random.Random(1)
    text = lambda good: " ".join("".join(rng.choices("abcdefgh", k=5)) + ("" if good else "%%%") for _ in range(60))
    rows = [(i, text(i % 2), i % 2) for i in range(160)]
    docs = spark.createDataFrame([(i, t, 0) for i, t, _ in rows] + [(900, None, 0), (901, "", 0), (None, "x", 0)], "doc_id long, text string, score int")
    net = quality.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"))
    got = {r.doc_id: r.score for r in quality.score_quality(docs, net).collect()}
    assert len(got) == 163 and sum((got[i] >= 0.5) == bool(y) for i, _, y in rows) >= 155
    kept = quality.keep_good(docs, net, 0.5)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s >= 0.5}
    empty = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert all(0 <= r.score <= 1 for r in quality.score_quality(docs, empty).collect())


def test_held_out_rows_are_never_learned(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    picked = training.sample(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")), "quality", 1000)
    assert picked.filter(training.held_out()).count() == 0 and picked.count() == docs.filter(~training.held_out()).count()
    assert training.sample(docs, docs.select("doc_id", F.lit(1).alias("quality")), "quality", 7).count() == 7


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(repr(tuple(r[i] for i in place)) for r in want.fetchall())


def test_pipeline_stages_do_what_their_operators_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    network = quality.train(docs, labels)
    good = {r.doc_id for r in quality.score_quality(docs, network).collect() if r.score >= 0.3}
    stage = dict(corpus_pipeline.STAGES)
    first = stage["quality"](spark, docs, SF)
    assert {r.doc_id for r in first.collect()} == good and first.columns == docs.columns
    second = stage["line_dedup"](spark, first, SF).cache()
    assert second.columns == docs.columns and second.filter(F.col("n_chars") != F.char_length("text")).count() == 0
    third = stage["near_duplicates"](spark, second, SF).cache()
    ids = {r.doc_id for r in third.collect()}
    from tidemark.llm import simhash

    assert ids == {r.component_id for r in simhash.near_duplicates(second).collect()}
    fourth = stage["decontamination"](spark, third, SF)
    assert fourth.columns == docs.columns and {r.doc_id for r in fourth.collect()} <= ids
    last = corpus_pipeline.run(spark, SF)
    assert last.count() == fourth.count() and last.filter("NOT exact").count() == 0


def test_pipeline_takes_odd_rows(spark):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, "same text", None, None, None), (None, "same text", None, None, None), (3, "same text", "en", "s", 9), (4, "x", "en", "s", 1), (4, "x", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name == "near_duplicates":
            assert sorted(r.doc_id for r in out.collect()) == [1, 3, 4]
        if name == "line_dedup":
            assert out.count() == len(rows)
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_line_dedup_leaves_one_of_documents_that_would_be_emptied(spark):
    rng = random.Random(16)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    texts = [f"please ask the {word()} desk for a free copy of {word()} leaflets today" for _ in range(8)]
    texts += ["\n".join([f"one two three {word()} {word()}", f"this site needs {word()} and scripts to work for all of us", *[" ".join(word() for _ in range(12)) for _ in range(2)]]) for _ in range(9)]
    docs = spark.createDataFrame([(i + 1, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, SF).collect()}
    assert sorted(got) == [1, *range(9, 18)] and got[1] == texts[0]
    assert all("this site" not in got[i] and len(got[i].split("\n")) == 3 for i in range(9, 18))


def test_near_duplicates_keep_one_row_of_each_component_where_ids_clash(spark):
    rng = random.Random(17)
    a, b, c = (" ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(80)) for _ in range(3))
    rows = [(1, a), (1, b), (2, b), (1, b), (None, c), (7, c), (None, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SF).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, a), (1, b), (7, c), (None, "alone")], key=str)
