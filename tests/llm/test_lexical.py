"""Ranked lexical search against brute force, and in odd cases."""

import math
import random
import re

from tidemark.llm import lexical
from tidemark.llm.common import Scratch


def slow_terms(text):
    if text is None:
        return []
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def slow_search(docs, queries, k):
    rows = [(i, d, slow_terms(t)) for i, (d, t) in enumerate(docs)]
    big_n = sum(1 for _, _, t in rows if t)
    big_l = sum(len(t) for _, _, t in rows)
    df = {}
    for _, _, t in rows:
        for term in set(t):
            df[term] = df.get(term, 0) + 1
    out = []
    for item, text in queries:
        scored = []
        for i, d, t in rows:
            if not t:
                continue
            m = 10 + (90 * len(t) * big_n) // big_l
            s = 0
            for term in set(slow_terms(text)):
                tf = t.count(term)
                if tf:
                    s += math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[term] + 1))) * ((10**9 * tf) // (1000 * tf + 8 * m))
            if s > 0:
                scored.append((-s, d if d is not None else float("inf"), i, d, s))
        scored.sort()
        out += [(item, r + 1, d, s) for r, (_, _, _, d, s) in enumerate(scored[:k])]
    return sorted(out, key=repr)


def run(spark, docs, queries, k, scratch=True):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", lexical.F.lit(1)).withColumn("q", lexical.F.lit(2))
    q = spark.createDataFrame(queries, "item_id long, text string").withColumn("term", lexical.F.lit("x"))
    found = lexical.search(d, q, k=k, spark_scratch=Scratch(spark, "t") if scratch else None)
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_search_matches_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["The", "the", "ÄPFEL", "äpfel", "naïve"]
    docs = []
    for i in range(300):
        n = rng.choice([0, 1, 3, 10, 40, 200])
        docs.append((i % 250, " ".join(rng.choice(words[: 5 + i % 45]) for _ in range(n)) + rng.choice(["", ",x9", " Q-1"])))
    docs += [(None, "the w1 w1"), (7, None), (8, ""), (9, "!!! ---")]
    queries = [(1, "the w1"), (2, "W3 w3 w7 äpfel"), (3, None), (4, "nothing here zzz"), (5, "the"), (5, "w0 x9"), (None, "w2")]
    for k in (1, 3, 10):
        assert run(spark, docs, queries, k) == slow_search(docs, queries, k)


def test_search_odd_cases(spark):
    assert run(spark, [], [(1, "a")], 10) == []
    assert run(spark, [(1, "a b")], [], 10) == []
    docs = [(1, "a b"), (1, "a b"), (2, "a b"), (3, "c"), (4, "c d e f g")]
    assert run(spark, docs, [(1, "b")], 10, scratch=False) == slow_search(docs, [(1, "b")], 10)
    long_text = "a " * 200_000 + "b"
    assert run(spark, [(1, long_text), (2, "b c"), (3, "c")], [(9, "b")], 10) == slow_search([(1, long_text), (2, "b c"), (3, "c")], [(9, "b")], 10)


def test_queries_in_blocks_and_products_in_parts_find_the_same(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choice(words[: 3 + i % 28]) for _ in range(rng.choice([1, 5, 60])))) for i in range(200)]
    queries = [(i, " ".join(rng.sample(words, 4))) for i in range(9)]
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 3)
    assert run(spark, docs, queries, 5) == slow_search(docs, queries, 5)


def test_postings_are_written_once_and_not_shuffled(spark, tmp_path):
    """The scores' plan reads the index and sends only each task's best to the ranking."""
    docs = spark.createDataFrame([(i, f"w{i % 7} the w{i % 3}") for i in range(60)], "doc_id long, text string")
    scratch = Scratch(spark, "t")
    found = lexical.search(docs, spark.createDataFrame([(1, "the w1 w2")], "item_id long, text string"), spark_scratch=scratch)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Aggregate" not in plan and "index" in scratch.paths
