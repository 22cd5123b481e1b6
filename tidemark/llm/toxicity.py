"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import training
from tidemark.llm.common import in_batches, texts_of

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = str.maketrans("аеорсухіјѕԁһкмтвнԛԝαειηκνορτυχıɑɡ", "aeopcyxijsdhkmtbhqwaeinkvoptuxiag")
# Digits and signs written for letters. One and l may both stand for i, so all three are read as i.
SIGNS = str.maketrans("0134578@$!|+€", "oieastbasiite")
ONE = str.maketrans("l", "i")
HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]")
EDGES = "\"'()[]{}.,;:?*&%#=<>_-/\\~`^!|+€…“”„«»"
WORD_SHARE = 3  # a substitution is undone in words that have at least one letter per this many signs

CACHED_WORDS = 400_000
TRAINING_ROWS = 6_000  # labelled rows of each class the lexicon is learned from, at most
TERMS = 400  # entries of a lexicon, at most
STEM_LENGTHS = (4, 5, 6)  # word beginnings that may become entries, besides whole words
ONE_WORD = 0.8  # share of a beginning's documents from which on its word is the entry
LEAST_DOCS = 10  # toxic training documents with an entry, at least
LEAST_RATIO = 12.0  # how many times likelier an entry is in toxic documents, at least
EXCEPTIONS = 100  # exception phrases, at most
PER_WORDS = 200  # words that dilute a match by half


class _Words(dict):
    """Folded forms of words met so far; started anew when full."""

    def __missing__(self, word: str) -> str:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = made = fold_word(word)
        return made


_WORDS = _Words()


def fold_word(word: str) -> str:
    """Lower case, compatible forms and hidden signs resolved, look-alikes and substitutions undone.

    A sign is read as a letter only inside a word that has enough letters;
    numbers stay numbers and words wholly of another script stay theirs.
    Accents are kept, as they tell words apart.
    """
    flat = HIDDEN.sub("", unicodedata.normalize("NFKC", word)).lower().strip(EDGES)
    if not flat.isascii():
        latin = flat.translate(HOMOGLYPHS)
        if latin.isascii() and any("a" <= c <= "z" for c in flat) or any("a" <= c <= "z" or "ß" <= c <= "ɏ" for c in flat):
            flat = latin
    if not flat.isalpha():
        letters = sum(map(str.isalpha, flat))
        if letters * WORD_SHARE >= len(flat) > 0:
            flat = flat.translate(SIGNS)
        flat = " ".join("".join(c if c.isalnum() else " " for c in flat).split())
    return flat.translate(ONE)


def fold(text: str) -> str:
    """Folded words of a text, between single blanks."""
    return f" {' '.join(filter(None, map(_WORDS.__getitem__, text.split())))} "


@dataclass
class Lexicon:
    """Weights of entries, phrases in which an entry does not count, and the scale of the score."""

    weights: dict[str, float]  # " word " or " stem"
    exceptions: list[str]
    slope: float
    intercept: float

    def automaton(self) -> ahocorasick.Automaton:
        machine = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            machine.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            machine.add_word(phrase, (len(phrase), 0.0))
        if len(machine):
            machine.make_automaton()
        return machine


def burden(folded: str, machine: ahocorasick.Automaton) -> float:
    """Weight of all matches, normalised by length; a match inside an exception phrase does not count.

    The heaviest entry that begins at a word counts once per word.
    """
    if not len(machine):
        return 0.0
    best: dict[int, float] = {}
    safe: list[tuple[int, int]] = []
    for end, (length, weight) in machine.iter(folded):
        start = end - length + 1
        if weight:
            best[start] = max(best.get(start, 0.0), weight)
        else:
            safe.append((start, end))
    if safe:
        best = {s: w for s, w in best.items() if not any(a <= s < b for a, b in safe)}
    words = folded.count(" ") - 1
    return sum(best.values()) / (1.0 + words / PER_WORDS) if best else 0.0


def learn(rows: DataFrame, terms: int = TERMS, exceptions: int = EXCEPTIONS) -> Lexicon:
    """A lexicon from (text, label) rows, with counts made by the cluster.

    Entries are words and word beginnings that are far likelier in toxic
    documents; their weight is the log of that ratio. Exception phrases are
    pairs of an entry and a neighbour that are about as likely in clean ones.
    Without rows of both classes nothing is learned and every score is low.
    """
    folded = rows.groupBy("text").agg(F.min("label").alias("label"))  # copies count once

    def grams(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            terms_, marks = [], []
            for text, label in zip(texts_of(part, "text"), part.column("label").to_pylist()):
                seen = set()
                for word in set(fold(text.decode("utf-8", "replace")).split()):
                    seen.add(f" {word} ")
                    seen.update(f" {word[:n]}" for n in STEM_LENGTHS if len(word) > n)
                terms_ += seen
                marks += [label] * len(seen)
            yield pa.record_batch([pa.array(terms_, pa.string()), pa.array(marks, pa.int32())], ["term", "label"])

    sizes = {r.label: r["count"] for r in folded.groupBy("label").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Lexicon({}, [], 1.0, -2.0)
    counted = in_batches(folded, grams, "term string, label int").groupBy("term").agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good"))
    ratio = (F.col("bad") / F.lit(float(sizes[1]))) / ((F.col("good") + 0.5) / F.lit(float(sizes[0])))
    strong = counted.filter((F.col("bad") >= LEAST_DOCS) & (ratio >= LEAST_RATIO)).withColumn("ratio", ratio)
    best = strong.orderBy(F.desc(F.col("bad") * F.log("ratio")), "term").limit(terms).collect()
    weights: dict[str, float] = {}
    words = [(r.term, r.bad) for r in best if r.term.endswith(" ")]
    for r in best:  # a word is no entry of its own if its beginning is as strong a one, and a beginning none if it is mostly one word
        if not r.term.endswith(" ") and any(w.startswith(r.term) and n >= ONE_WORD * r.bad for w, n in words):
            continue
        stem = next((f" {r.term.strip()[:n]}" for n in STEM_LENGTHS if f" {r.term.strip()[:n]}" in weights and weights[f" {r.term.strip()[:n]}"] >= 0.8 * math.log(r.ratio)), None)
        if stem is None:
            weights[r.term] = math.log(r.ratio)
    machine = Lexicon(weights, [], 1.0, 0.0).automaton()

    def pairs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            phrases, marks = [], []
            for text, label in zip(texts_of(part, "text"), part.column("label").to_pylist()):
                line, seen = fold(text.decode("utf-8", "replace")), set()
                for end, (length, _) in machine.iter(line) if len(machine) else ():
                    start = end - length + 1
                    stop = line.find(" ", start + 1)
                    ahead, after = line.rfind(" ", 0, start), line.find(" ", stop + 1)
                    if ahead >= 0:
                        seen.add(line[ahead : stop + 1])
                    if after > 0:
                        seen.add(line[start : after + 1])
                phrases += seen
                marks += [label] * len(seen)
            yield pa.record_batch([pa.array(phrases, pa.string()), pa.array(marks, pa.int32())], ["term", "label"])

    both = in_batches(folded, pairs, "term string, label int").groupBy("term").agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good"))
    harmless = both.filter((F.col("good") >= LEAST_DOCS) & (F.col("good") / sizes[0] > F.col("bad") / sizes[1])).orderBy(F.desc("good"), "term").limit(exceptions)
    lexicon = Lexicon(weights, [r.term for r in harmless.collect()], 1.0, 0.0)
    return calibrate(lexicon, folded)


def calibrate(lexicon: Lexicon, rows: DataFrame) -> Lexicon:
    """Fit score = 1 / (1 + exp(-(slope * log(1 + burden) + intercept))) to the training rows."""
    pairs = burdens(rows.withColumn("doc_id", F.col("label").cast("long")), lexicon).select("doc_id", F.round("burden", 2).alias("burden")).groupBy("doc_id", "burden").count().collect()
    x = np.log1p([r.burden for r in pairs])
    y = np.array([r.doc_id for r in pairs], float)
    n = np.array([r["count"] for r in pairs], float)
    n[y == 1] *= n[y == 0].sum() / max(n[y == 1].sum(), 1.0)
    design, theta = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ theta))
        grad = design.T @ (n * (p - y)) + 1e-2 * n.sum() * theta * [1, 0]
        hess = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-2 * n.sum() * np.diag([1.0, 1e-4])
        theta = theta - np.linalg.solve(hess, grad)
    return Lexicon(lexicon.weights, lexicon.exceptions, float(max(theta[0], 0.0)), float(theta[1]))


def burdens(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, burden) of every row of (doc_id, text)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.automaton()
        for part in parts:
            loads = [burden(fold(t.decode("utf-8", "replace")), machine) for t in texts_of(part, "text")]
            yield pa.record_batch([part.column("doc_id"), pa.array(loads, pa.float64())], ["doc_id", "burden"])

    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, burden double")


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): likelihood of toxicity, 0 to 1, one row per input row.

    Null and empty texts carry no match and get the score of a clean text.
    Whole texts are read; ids may be null or repeat; other columns are ignored.
    """
    loads = burdens(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), lexicon)
    return loads.select("doc_id", (1 / (1 + F.exp(-(F.log1p("burden") * F.lit(lexicon.slope) + F.lit(lexicon.intercept))))).alias("score"))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Lexicon:
    """A lexicon from at most ``rows`` labelled documents of each class, none of them held out."""
    return learn(training.sample(docs, labels, "toxic", rows).select("text", F.col("label").cast("int").alias("label")))
