"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, let, row_key

SHINGLE = 5
CONTAINED = 0.8  # share of an item's shingles that a contaminated document holds
BROADCAST_ROWS = 200_000  # sketch rows (16 bytes each) that travel to every task; more are joined by shuffle


def words(text: Column) -> Column:
    """Lower-case words: runs of letters, marks and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{M}\\p{N}]+", -1), lambda w: w != "")


def shingles(tokens: Column, width: Column) -> Column:
    """Distinct shingles of an array of words, as text."""
    made = lambda t: F.transform(F.sequence(F.lit(1), F.size(t) - width + 1), lambda i: F.array_join(F.slice(t, i, width), " "))
    return let(tokens, lambda t: F.when(F.size(t) >= width, F.array_distinct(made(t))).otherwise(F.array().cast("array<string>")))


def _hashed(tokens: Column, width: int) -> Column:
    """Hashes of the shingles, repeats included; the hash of a shingle is made of its words' hashes."""
    marks = F.transform(tokens, lambda w: F.xxhash64(w))
    made = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(width)]))
    return let(marks, lambda h: F.when(F.size(h) >= width, made(h)).otherwise(F.array().cast("array<bigint>")))


def sketches(items: DataFrame, scratch: Scratch, shingle: int, contained: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(item_id, shingles, width, need) of all items with words, and (item_id, width, size, need, hash) of their sketches.

    An item of m shingles is contained if at least ``need`` of them are in a
    document. Then one of any m - need + 1 is, so these many smallest hashes of
    the item are a MinHash sketch that misses no document. Its length follows
    from the item's size, and so does the largest hash that can matter.
    """
    read = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("tokens")).filter("size(tokens) > 0")
    read = read.withColumn("width", F.least(F.size("tokens"), F.lit(shingle)))
    held = read.select("item_id", "width", "tokens", shingles(F.col("tokens"), F.col("width")).alias("shingles"))
    held = held.withColumn("need", F.ceil(F.size("shingles") * F.lit(contained) - F.lit(1e-9)).cast("int")).withColumn("need", F.greatest("need", F.lit(1)))
    held = scratch.keep("items", held)
    by_width = F.lit(None).cast("array<bigint>")
    for width in range(1, shingle + 1):
        by_width = F.when(F.col("width") == width, F.array_distinct(_hashed(F.col("tokens"), width))).otherwise(by_width)
    lowest = F.slice(F.sort_array(by_width), F.lit(1), F.size("shingles") - F.col("need") + 1)
    sketch = held.select("item_id", "width", F.floor(F.log2(F.size("shingles"))).cast("int").alias("size"), "need", F.explode(lowest).alias("hash"))
    return held.select("item_id", "shingles", "width", "need"), scratch.keep("sketch", sketch)


def _probes(width: int, bounds: list) -> Column:
    """The document's shingle hashes that may be in a sketch of this width."""
    fits = [F.when(F.size("tokens") - width + 1 >= b.least, F.lit(b.top)) for b in bounds if b.width == width]
    top = F.greatest(*fits) if len(fits) > 1 else fits[0]
    low = lambda most: F.filter(_hashed(F.col("tokens"), width), lambda h: h <= most)
    named = F.transform(let(top, low), lambda h: F.struct(F.lit(width).alias("width"), h.alias("hash")))
    return F.when(top.isNotNull(), named).otherwise(F.array().cast("array<struct<width:int,hash:bigint>>"))


def candidates(docs: DataFrame, sketch: DataFrame, text_col: str) -> DataFrame:
    """(row, item_id): documents that hold a shingle of an item's sketch and are long enough for the item.

    Items are partitioned by width and size. A document meets the partitions
    whose smallest item it could hold, and of its shingles only those whose
    hash is not above the largest one in these partitions' sketches are looked up.
    """
    bounds = sketch.groupBy("width", "size").agg(F.max("hash").alias("top"), F.min("need").alias("least")).orderBy("width", "size").collect()
    parts = [_probes(width, bounds) for width in sorted({b.width for b in bounds})]
    slim = docs.select("row", F.explode(F.array(words(F.col(text_col)))).alias("tokens"))  # the explode makes the words once
    probes = slim.select("row", F.size("tokens").alias("n_words"), F.explode(F.flatten(F.array(*parts))).alias("it")).select("row", "n_words", "it.*")
    known = F.broadcast(sketch) if sketch.count() <= BROADCAST_ROWS else sketch
    met = probes.join(known, ["width", "hash"]).filter(F.col("n_words") - F.col("width") + 1 >= F.col("need"))
    return met.select("row", "item_id").distinct()


def contained_items(
    docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, contained: float = CONTAINED, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", scratch: Scratch | None = None,
) -> DataFrame:
    """(row, doc_id, item_id, matched, shingles, containment) of documents that hold a benchmark item.

    An item is held if at least ``contained`` of its distinct ``shingle``-word
    shingles are in the document; an item with fewer words is one shingle.
    Items and documents without words (null, empty) take no part. Candidates
    come from the sketches, which miss none, and are verified on the shingles'
    text. A repeated row of ``docs`` or ``items`` is reported as often as it
    came; empty tables give an empty result; other columns are ignored.
    Documents are read whole, and only those with candidates a second time.
    """
    scratch = scratch or Scratch(docs.sparkSession, "decontaminate")
    slim = docs.select(row_key(id_col, text_col).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    renamed = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("item_text"))
    held, sketch = sketches(renamed, scratch, shingle, contained, "item_id", "item_text")
    if not sketch.limit(1).count():
        return slim.limit(0).join(held.limit(0).select("item_id"), F.lit(True)).select("row", "doc_id", "item_id", F.lit(0).alias("matched"), F.lit(0).alias("shingles"), F.lit(0.0).alias("containment"))
    met = scratch.keep("candidates", candidates(slim, sketch, "text"))
    pairs = slim.join(met.hint("merge"), "row").join(held, "item_id")
    counted = pairs.select("row", "doc_id", "item_id", "need", F.size("shingles").alias("shingles"), F.size(F.array_intersect("shingles", shingles(words(F.col("text")), F.col("width")))).alias("matched"))
    return counted.filter("matched >= need").select("row", "doc_id", "item_id", "matched", "shingles", (F.col("matched") / F.col("shingles")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns; see ``contained_items``."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    found = contained_items(docs, items, id_col=id_col, text_col=text_col, scratch=scratch, **options)
    bad = scratch.keep("contaminated", found.select(F.col("row").alias("__row")).distinct())
    return docs.withColumn("__row", row_key(id_col, text_col)).join(bad.hint("merge"), "__row", "left_anti").drop("__row")
