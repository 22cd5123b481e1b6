"""Ranked lexical search over a length-stratified index, in integer arithmetic.

Documents are grouped into strata of equal length normaliser ``m``; inside a
stratum, a term's postings are grouped by their term frequency, so the impact
of a (term, stratum, tf) entry is computed once however many documents share
it. For each query, a floor on its k-th best score comes from single-term
impacts, and each stratum gets a ceiling from its largest frequencies; only
strata whose ceiling reaches the floor are scored exactly. That drops no
document of the top k: one that belongs there scores at least the floor and
at most its stratum's ceiling.

Terms are the maximal runs of ASCII letters and digits and of any character
beyond ASCII; only A-Z are lower-cased. With ``N`` the documents that hold a
term, ``L`` their terms (repeats counted), ``n`` one document's terms, ``df``
the documents holding a term and ``tf`` its count in one:

* ``w = floor(1000 * ln((2N + 2) / (2 df + 1)))`` (doubles),
* ``m = 10 + (90 n N) div L`` (64-bit integers, as all that follows),
* a query's score of a document sums ``w * ((10^9 tf) div (1000 tf + 8 m))``
  over the query's distinct terms.

Defined results: a null text has no terms (nor does a null query); a document
without terms takes no part in ``N`` and ``L`` and scores nothing; repeated
rows are separate documents (each is ranked; equal scores go by ascending
``doc_id``, then by the order rows were read); a query without terms, or whose
terms no document holds, ranks nothing; only scores above 0 are ranked; an
empty table gives no rows. The input may have any other columns; only the id
and text columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, in_batches, texts_of

# Fixed values of the contract: the characters that are not part of a term, and the scale of weights and impacts.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WEIGHT_SCALE, IMPACT_SCALE, TF_SCALE, M_SCALE, M_BASE, M_SPAN = 1000, 1_000_000_000, 1000, 8, 10, 90

QUERY_BLOCK = 1024  # queries that travel to the documents at once; more go in further passes
PRODUCTS = 2_000_000  # products of a posting and a query's weight made at once in a task
ROW_BITS = 40  # a task's number sits above this bit of a document's row key
# Bytes that are part of no term are blanks, A-Z lower-cased; bytes beyond ASCII are letters.
FOLDED = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))


def terms(text: Column) -> Column:
    """The terms of a text, in order, repeats kept; none for null."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), 0), F.array().cast("array<string>"))


def div(a: Column, b: Column) -> Column:
    """Integer division of 64-bit integers, rounding down for the positive values used here."""
    return F.call_function("div", a.cast("long"), b.cast("long"))


def impact(tf: Column, m: Column) -> Column:
    """``(10^9 tf) div (1000 tf + 8 m)`` in 64-bit integers."""
    tf, m = tf.cast("long"), m.cast("long")
    return div(F.lit(IMPACT_SCALE) * tf, F.lit(TF_SCALE) * tf + F.lit(M_SCALE) * m)


def lexical_index(docs: DataFrame, codes: Broadcast, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict]:
    """(row, doc_id, m, term, tf) of every document that holds a term, and the corpus totals N and L.

    ``term`` and ``tf`` are arrays: the codes of the document's terms that
    ``codes`` (UTF-8 bytes to a number) knows, and how often each occurs. ``N``,
    ``L`` and every ``m`` count all terms of all documents. ``row`` tells
    repeated rows apart, in the order they are read. Documents are read once;
    their postings stay together, so none is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, at = codes.value, TaskContext.get().partitionId() << ROW_BITS
        for batch in batches:
            sizes, found = [], []
            for text in texts_of(batch, "text"):
                words = text.translate(FOLDED).split()
                sizes.append(len(words))
                found.append([(known[word], tf) for word, tf in Counter(words).items() if word in known])
            offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            flat = np.array([x for hits in found for x in hits], np.int32).reshape(-1, 2)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(flat[:, i])) for i in (0, 1)]
            rows = pa.array(np.arange(at, at + len(sizes), dtype=np.int64))
            at += len(sizes)
            yield pa.record_batch([rows, batch.column("doc_id"), pa.array(sizes, pa.int64()), *lists], ["row", "doc_id", "n", "term", "tf"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = scratch.keep("index", in_batches(slim, run, "row long, doc_id long, n long, term array<int>, tf array<int>"))
    totals = rows.agg(F.count(F.when(F.col("n") > 0, 1)).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("L")).first()
    big_n, big_l = int(totals["N"]), int(totals["L"])
    m = F.lit(M_BASE) + div(F.lit(M_SPAN) * F.col("n") * F.lit(big_n), F.lit(max(big_l, 1)))
    return rows.filter("n > 0").select("row", "doc_id", m.alias("m"), "term", "tf"), {"N": big_n, "L": big_l}


def weight(df: Column, big_n: int) -> Column:
    """``floor(1000 ln((2N + 2) / (2 df + 1)))``."""
    return F.floor(F.lit(float(WEIGHT_SCALE)) * F.log((F.lit(2.0 * big_n + 2.0)) / (F.lit(2.0) * df.cast("double") + F.lit(1.0)))).cast("long")


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           query_id: str = "item_id", query_text: str = "text", spark_scratch=None) -> DataFrame:
    """(query_id, rank, doc_id, score): each query's ``k`` best documents with score above 0 (all, if fewer).

    Ranks run from 1, highest score first, equal scores by ascending ``doc_id``
    (a null id last). Repeated or null query ids are separate queries.
    ``spark_scratch`` (a ``Scratch``) keeps the queries, the postings and the
    entries in the shared folder. Queries travel in blocks of ``QUERY_BLOCK``;
    each block meets all documents in one pass whose tasks keep ``k`` documents
    a query, so nothing but these is shuffled to be ranked.
    """
    scratch = spark_scratch or Scratch(docs.sparkSession, "lexical")
    asked = queries.select(F.monotonically_increasing_id().alias("q"), F.col(query_id).alias("query"), F.array_distinct(terms(F.col(query_text))).alias("t"))
    asked = scratch.keep("queries", asked)
    parts = max(1, -(-asked.count() // QUERY_BLOCK))
    cut = F.pmod(F.xxhash64("q"), F.lit(parts))
    found = [_search_block(docs, asked.filter(cut == part), k, id_col, text_col, scratch) for part in range(parts)]
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    ranked = reduce(DataFrame.unionAll, found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(asked.select("q", "query"), "q").select(F.col("query").alias(query_id), F.col("rank").cast("int"), F.col("doc_id").cast("long"), F.col("score").cast("long"))


def _search_block(docs: DataFrame, asked: DataFrame, k: int, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """(q, doc_id, row, score): of each task, the ``k`` best documents of every query in ``asked``."""
    spark = docs.sparkSession
    block = sorted((r.q, r.t) for r in asked.select("q", "t").collect())
    codes = {t: i for i, t in enumerate(sorted({t for _, ts in block for t in ts}))}
    pairs = [(at, codes[t]) for at, (_, ts) in enumerate(block) for t in ts]
    wanted = scratch.keep("wanted", spark.createDataFrame(pairs, "q int, term int"))
    docs_with, totals = lexical_index(docs, spark.sparkContext.broadcast({t.encode(): i for t, i in codes.items()}), scratch, id_col, text_col)

    # How many documents share each (term, stratum, tf); impacts are computed once for all of them.
    postings = docs_with.select("m", "tf", F.posexplode("term").alias("at", "term")).select("term", "m", F.get("tf", F.col("at")).alias("tf"))
    entries = scratch.keep("entries", postings.groupBy("term", "m", "tf").agg(F.count(F.lit(1)).alias("docs")))
    df = entries.groupBy("term").agg(F.sum("docs").alias("df"))
    weighted = scratch.keep("weighted", wanted.join(df, "term").select("q", "term", weight(F.col("df"), totals["N"]).alias("w")).filter("w > 0"))

    # Floor: some k documents hold one term with at least this single impact, so the k-th best score is no lower.
    by_impact = Window.partitionBy("term").orderBy(F.desc("imp"), "m", "tf")
    top = entries.withColumn("imp", impact(F.col("tf"), F.col("m"))).withColumn("at", F.row_number().over(by_impact)).filter(F.col("at") <= k)
    reach = top.withColumn("seen", F.sum("docs").over(by_impact.rowsBetween(Window.unboundedPreceding, 0)))
    kth = reach.filter(F.col("seen") >= k).groupBy("term").agg(F.max("imp").alias("kth"))
    floor = weighted.join(kth, "term").groupBy("q").agg(F.max(F.col("w") * F.col("kth")).alias("floor"))

    # Ceiling of each stratum: every term at its largest frequency there.
    most = entries.groupBy("term", "m").agg(F.max("tf").alias("tf"))
    ceiling = weighted.join(most, "term").groupBy("q", "m").agg(F.sum(F.col("w") * impact(F.col("tf"), F.col("m"))).alias("ceiling"))
    visited = ceiling.join(floor, "q", "left").filter(F.col("ceiling") >= F.coalesce("floor", F.lit(0)))
    strata = scratch.keep("strata", visited.groupBy("m").agg(F.collect_list("q").alias("visits")))

    # Exact scores in the strata visited: one row per stratum goes to every task, the weights with the pass.
    by_term = sorted((r.term, r.q, r.w) for r in weighted.collect())
    sent = spark.sparkContext.broadcast((np.array([q for q, _ in block], np.int64), len(codes), np.array(by_term, np.int64).reshape(-1, 3)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, n_terms, table = sent.value
        starts = np.searchsorted(table[:, 0], np.arange(n_terms + 1))
        best = np.zeros((5, 0), np.int64)  # q, score, whether the id is missing, doc_id, row
        floors = np.ones(len(names), np.int64)  # a query's k-th best score so far
        for batch in batches:
            scores = _scores(batch, starts, table, len(names))
            doc, q = np.nonzero(scores >= floors)
            ids = batch.column("doc_id")
            missing = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            new = [q, scores[doc, q], missing[doc], ids.fill_null(0).to_numpy()[doc], batch.column("row").to_numpy()[doc]]
            best = np.hstack([best, np.array(new, np.int64)])
            best = best[:, np.lexsort((best[4], best[3], best[2], -best[1], best[0]))]
            rank = np.arange(best.shape[1]) - np.searchsorted(best[0], best[0])
            full = best[:, rank == k - 1]
            floors[full[0]] = full[1]
            best = best[:, rank < k]
        yield pa.record_batch([pa.array(names[best[0]]), pa.array(best[3], mask=best[2] > 0), pa.array(best[4]), pa.array(best[1])], ["q", "doc_id", "row", "score"])

    return in_batches(docs_with.join(F.broadcast(strata), "m"), run, "q long, doc_id long, row long, score long")


def _scores(batch: pa.RecordBatch, starts: np.ndarray, table: np.ndarray, n_queries: int) -> np.ndarray:
    """Scores of a batch's documents (rows) for the queries (columns) that visit their stratum, 0 for others.

    ``table`` has (term, query, weight) by term, those of a term from ``starts`` on.
    """
    lists = batch.column("term")
    sizes = np.diff(lists.offsets.to_numpy())
    doc, term, tf = np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy(), batch.column("tf").flatten().to_numpy().astype(np.int64)
    m = np.repeat(batch.column("m").to_numpy().astype(np.int64), sizes)
    impacts = IMPACT_SCALE * tf // (TF_SCALE * tf + M_SCALE * m)
    many = starts[term + 1] - starts[term]  # queries that ask for the posting's term
    scores = np.zeros(len(sizes) * n_queries, np.int64)
    upto = np.cumsum(many)
    begin = 0
    while begin < len(many):
        end = max(begin + 1, int(np.searchsorted(upto, upto[begin] - many[begin] + PRODUCTS, "right")))
        part = many[begin:end]
        of = np.repeat(np.arange(begin, end), part)
        at = starts[term[of]] + np.arange(len(of)) - np.repeat(np.cumsum(part) - part, part)
        np.add.at(scores, doc[of] * n_queries + table[at, 1], table[at, 2] * impacts[of])
        begin = end
    scores = scores.reshape(len(sizes), n_queries)
    visits = batch.column("visits")
    visited = np.zeros(scores.shape, bool)
    visited[np.repeat(np.arange(len(sizes)), np.diff(visits.offsets.to_numpy())), visits.flatten().to_numpy()] = True
    return np.where(visited, scores, 0)
