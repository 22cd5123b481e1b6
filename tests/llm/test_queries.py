"""Registered queries of the dealt operators on planted tables, as the driver runs them."""

import random

import duckdb
import pandas as pd

from tidemark.llm.queries import ORACLES, QUERIES


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(n))


def folder(tmp_path, docs):
    pd.DataFrame(docs, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64", "n_chars": "Int64"}).to_parquet(tmp_path / "documents.parquet")
    return str(tmp_path)


def test_op3_query_drops_a_line_of_forty_documents_one_copied_four_hundred_times(spark, tmp_path):
    rng = random.Random(21)
    line = words(rng, 8)
    texts = ["\n".join([words(rng, 9), line, words(rng, 9), words(rng, 9)]) for _ in range(40)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(1000 + i, texts[0], "en", "s", len(texts[0])) for i in range(400)]
    got = QUERIES["op3_line_dedup"](spark, folder(tmp_path, rows)).collect()
    assert len(got) == 440 and all(line not in r.text and r.n_dropped == 1 and r.n_lines == 4 for r in got)


def test_op3_query_finds_a_second_template_in_a_leaf(spark, tmp_path):
    rng = random.Random(22)
    forms = ["disk volume {} was mounted read only by host", "user {} signed in from trusted office network again"]
    texts = []
    for i in range(9):
        stamped = [f"2024-01-0{i} 10:0{i} {i} " + f.format(words(rng, 1)) for f in forms]
        texts.append("\n".join([words(rng, 11), stamped[0], words(rng, 11), "1 2 3 the service is up and ready to run now", stamped[1], words(rng, 11)]))
    got = QUERIES["op3_line_dedup"](spark, folder(tmp_path, [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)])).collect()
    for r in got:
        rows = texts[r.doc_id].split("\n")
        assert r.text.split("\n") == [rows[0], rows[2], rows[5]]


def test_op10_query_labels_by_repositories_and_matches_its_sql(spark, tmp_path):
    copied, own = "password=Zq8xT2mLp9Wv4KdR", "api_key: 'Hn3Lq7Vx1Bz9Mk5T'"
    rows = [(i, f"config {copied} end", "en", "one_owner", 30) for i in range(12)] + [(100, f"x {own} y", "en", "other", 20), (101, None, "en", None, None)]
    sf = folder(tmp_path, rows)
    got = {r.doc_id: r for r in QUERIES["op10_secret_scan"](spark, sf).collect()}
    assert all(got[i].n_shared == 1 and got[i].n_live == 0 for i in range(12))  # one owner, twelve repositories
    assert got[100].n_live == 1 and got[101].n_assign == 0
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = {r[0]: r for r in con.sql(ORACLES["op10_secret_scan"]).fetchall()}
    cols = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_shared"]
    assert {k: tuple(getattr(v, c) for c in cols) for k, v in got.items()} == {k: tuple(v) for k, v in want.items()}
