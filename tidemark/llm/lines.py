"""Line dedup by a tree of log templates, in DataFrame functions only."""

from __future__ import annotations

from itertools import combinations
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, let, row_key
from tidemark.llm.components import components

LEAD = 3  # leading tokens on the way to a leaf, below the token count
SEGMENTS = 6  # positions at which the rest of a line is compared with its leaf's template
SIMILAR = 0.6  # share of equal segments at which a line takes its leaf's template
MIN_DOCS = 5  # different documents in which a dropped template occurs
WORDS = 3  # consecutive words of a document that its sketch hashes together
SKETCH = 64  # least hashes of a document
PROBES = 12  # of these, how many look for near copies
NEAR = 0.5  # estimated share of common word runs from which two documents are near copies
VARIABLE = "<*>"


def masked(text: Column) -> Column:
    """A tidied text in which each token with a digit is a variable field; tokens end at blanks and line ends."""
    return F.when(text.rlike("[0-9]"), F.regexp_replace(text, "(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*", VARIABLE)).otherwise(text)


def squeezed(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with single blanks in column ``name`` for its runs of blanks, tabs and returns; line ends may still have one on either side.

    Texts are searched before anything is replaced, as a replacement compares
    at every byte. Each step is a projection of its own, made once.
    """
    text = F.col(name)
    for c in "\t\r":
        docs = docs.withColumn(name, F.when(F.contains(text, F.lit(c)), F.replace(text, F.lit(c), F.lit(" "))).otherwise(text))
    return docs.withColumn(name, F.when(F.contains(text, F.lit("  ")), F.regexp_replace(text, "  +", " ")).otherwise(text))


def word_runs(words: Column, *later: Column) -> Column:
    """Hashes of the runs of ``WORDS`` words that begin at each of the hashed ``words``; the last runs reach over the end.

    Of fewer words than a run has, the first run holds all. The words that
    follow are looked up in arrays moved up by one each: an index added up at
    each word, or a written column, takes longer.
    """
    if len(later) == WORDS - 1:
        return F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(after, i) for after in later]))
    return let(F.slice(words, len(later) + 2, F.size(words)), lambda after: word_runs(words, *later, after))


def sketches(docs: DataFrame, text_col: str, key: Column, *others: Column) -> DataFrame:
    """(row, others, tidy, sketch): the squeezed and masked text and the least hashes of its runs of words, null for a blank document.

    No filter on what is made here: Spark would put it below the projections
    and make the words a second time for it.
    """
    # Each step is a projection of its own: inside a lambda a text would be tidied word by word, and again for every use.
    tidy = squeezed(docs.select(key.alias("row"), *others, F.col(text_col).alias("tidy")), "tidy")
    names = [c for c in tidy.columns if c != "tidy"]
    tidy = tidy.withColumn("tidy", masked(F.col("tidy")))
    hashes = F.transform(F.split(F.replace(F.col("tidy"), F.lit("\n"), F.lit(" ")), " "), lambda w: F.xxhash64(w))
    hashes = F.array_remove(hashes, F.xxhash64(F.lit("")))  # without what stands at a line end
    runs = let(hashes, lambda own: word_runs(own))
    hashed = tidy.select(*names, "tidy", runs.alias("runs"))
    hashed = hashed.select(*names, "tidy", F.sort_array(F.slice("runs", 1, F.greatest(F.size("runs") - WORDS + 1, F.lit(1)))).alias("runs"))
    # The least ones are mostly all different, and then the others need not be compared.
    hashed = hashed.select(*names, "tidy", "runs", F.array_distinct(F.slice("runs", 1, SKETCH)).alias("least"))
    full = (F.size("least") == SKETCH) | (F.size("runs") <= SKETCH)
    sketch = F.when(full, F.col("least")).otherwise(F.slice(F.array_distinct("runs"), 1, SKETCH))
    return hashed.select(*names, "tidy", F.when(F.size("runs") > 0, sketch).alias("sketch"))


def line_rows(docs: DataFrame, id_col: str, text_col: str, key: Column) -> DataFrame:
    """(row, id, own, pos, line, leaf, rest0, …, sketch) of every line that is not blank; ``own`` is how many the row has.

    ``line`` identifies the masked line, ``leaf`` its token count and leading
    tokens, ``rest0`` and on the hashed segments of its other tokens. The first
    line that is not blank has the row's sketch, so that texts are read, tidied
    and masked once for both.
    """
    made = sketches(docs, text_col, key, F.col(id_col).alias("id"))
    per_doc = made.select("row", "id", "sketch", F.transform(F.split("tidy", "\n", -1), lambda m: F.trim(m)).alias("lines"))
    full = F.transform("lines", lambda m: m != "")
    per_doc = per_doc.select("row", "id", "sketch", "lines", F.transform("lines", lambda m: F.md5(m.cast("binary"))).alias("hashes"), full.alias("full"))
    own, first = F.size(F.filter("full", lambda x: x)), F.array_position("full", True) - 1
    per_doc = per_doc.select("row", "id", "sketch", own.alias("own"), first.alias("first"), F.arrays_zip("lines", "hashes").alias("its"))
    # The outer form, as Spark filters the input of the other one by what it explodes, and makes that twice.
    rows = per_doc.select("row", "id", "sketch", "own", "first", F.posexplode_outer("its").alias("pos", "it")).filter("it.lines <> ''")
    tokens = F.split(F.col("it.lines"), " ")
    sketch = F.when(F.col("pos") == F.col("first"), F.col("sketch"))
    rows = rows.select("row", "id", "own", "pos", F.unhex("it.hashes").alias("line"), tokens.alias("tokens"), sketch.alias("sketch"))
    count = F.size("tokens")
    tail = F.greatest(count - LEAD, F.lit(0))
    segments = []
    for i in range(SEGMENTS):
        begin, end = F.floor(tail * i / SEGMENTS).cast("int"), F.floor(tail * (i + 1) / SEGMENTS).cast("int")
        segments.append(F.when(end > begin, F.hash(F.array_join(F.slice("tokens", begin + LEAD + 1, end - begin), " "))).alias(f"rest{i}"))
    leaf = F.xxhash64(count, F.array_join(F.slice("tokens", 1, LEAD), " "))
    return rows.select("row", "id", "own", "pos", "line", leaf.alias("leaf"), *segments, "sketch")


def templates(lines: DataFrame, seeds: DataFrame) -> DataFrame:
    """(line, n, template): the most frequent line of a leaf generalises to those that are similar to it; others stand for themselves."""
    equal = F.aggregate(F.zip_with("rest", "seed.rest", lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(0), lambda x, y: x + y)
    there = F.size(F.filter("rest", lambda x: x.isNotNull()))
    like = (there > 0) & (equal >= there * F.lit(SIMILAR))
    return lines.join(seeds, "leaf", "left").select("line", "n", F.when(like, F.col("seed.line")).otherwise(F.col("line")).alias("template"))


def leaf_templates(lines: DataFrame, seeds: DataFrame, scratch: Scratch) -> DataFrame:
    """(line, n, template): the templates with wildcards that a line fits, of those that more than one line fits.

    Lines of a leaf that agree in the same segments, as many as make them
    similar, fit the template with wildcards in the others. A line stands under
    each such choice of segments, so no line has to be a leaf's most frequent
    one to have a template, and no pair of lines is looked at.
    """
    rest = F.filter("rest", lambda x: x.isNotNull())
    choices = F.array().cast("array<bigint>")
    for there in range(1, SEGMENTS + 1):
        need = ceil(there * SIMILAR - 1e-9)
        if need < there:
            fit = [F.xxhash64("leaf", F.lit(k), *[F.get("there", i) for i in chosen]) for k, chosen in enumerate(combinations(range(there), need))]
            choices = F.when(F.size("there") == there, F.array(*fit)).otherwise(choices)
    fits = lines.join(seeds.select("leaf").hint("merge"), "leaf", "left_semi").select("line", "n", "leaf", rest.alias("there"))
    fits = scratch.keep("fits", fits.select("line", "n", F.explode(choices).alias("choice")))
    common = scratch.keep("common", fits.groupBy("choice").agg(F.count("*").alias("lines")).filter("lines > 1").select("choice"))
    return fits.join(common.hint("merge"), "choice", "left_semi").select("line", "n", F.unhex(F.lpad(F.hex("choice"), 16, "0")).alias("template"))


def candidates(rows: DataFrame, min_docs: int, scratch: Scratch) -> DataFrame:
    """(line, template): every template that a line fits and that has ``min_docs`` occurrences; fewer cannot be in as many documents."""
    # Segments are columns of their own, which hash aggregation can hold; the rows of a line all have the same.
    parts = [F.max(f"rest{i}").alias(f"rest{i}") for i in range(SEGMENTS)]
    lines = rows.groupBy("leaf", "line").agg(F.count("*").alias("n"), *parts)
    lines = scratch.keep("lines", lines.select("leaf", "line", "n", F.array(*[f"rest{i}" for i in range(SEGMENTS)]).alias("rest")))
    seed = F.min_by(F.struct("line", "rest"), F.struct(-F.col("n"), "line"))
    seeds = scratch.keep("seeds", lines.groupBy("leaf").agg(F.count("*").alias("lines"), seed.alias("seed")).filter("lines > 1").select("leaf", "seed"))
    of = scratch.keep("all_templates", templates(lines, seeds).unionByName(leaf_templates(lines, seeds, scratch)))
    often = of.groupBy("template").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs).select("template")
    out = scratch.keep("templates", of.join(scratch.keep("often", often).hint("merge"), "template", "left_semi").select("line", "template"))
    scratch.drop("lines", "seeds", "fits", "common", "all_templates", "often")
    return out


def families(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, doc) of the sketches in ``rows``: documents that are near copies of each other, also by way of others, share ``doc``.

    Sketches that have one of their least hashes in common meet the first
    sketch with it, and are linked to it if enough of the least hashes of both
    together are in both. What few lines share is not enough, whichever they
    are, so documents with the same boilerplate stay apart.
    """
    made = rows.filter("sketch is not null").select("row", "sketch", F.xxhash64("sketch").alias("doc"))
    texts = scratch.keep("texts", made.groupBy("doc").agg(F.first("sketch").alias("sketch")))
    probed = texts.select("doc", F.explode(F.slice("sketch", 1, PROBES)).alias("probe"))
    # Each probe has two meeting points, so that one document does not decide for all with a common line.
    first = scratch.keep("first", probed.groupBy("probe").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low <> high"))
    met = probed.join(first.hint("merge"), "probe").select("doc", F.explode(F.array("low", "high")).alias("other")).filter("doc <> other")
    met = scratch.keep("met", met.distinct())
    pairs = met.join(texts.hint("merge"), "doc").join(texts.select(F.col("doc").alias("other"), F.col("sketch").alias("its")).hint("merge"), "other")
    # Enough of the larger of the two have to be in the other: quicker to see, and few pairs are left.
    some = F.size(F.array_intersect("sketch", "its")) >= F.greatest(F.size("sketch"), F.size("its")) * F.lit(NEAR)
    both = F.slice(F.sort_array(F.array_union("sketch", "its")), 1, SKETCH)
    shared = F.size(F.array_intersect(F.array_intersect(both, F.col("sketch")), F.col("its")))
    links = pairs.filter(some).filter(shared >= F.size(both) * F.lit(NEAR)).select(F.col("doc").alias("u"), F.col("other").alias("v"))
    linked = components(scratch.keep("near", links), scratch)
    named = made.select("row", "doc").distinct().join(linked, F.col("doc") == F.col("node"), "left")
    out = scratch.keep("families", named.select("row", F.coalesce("component", "doc").alias("doc")))
    scratch.drop("texts", "first", "met", "near")
    return out


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, scratch: Scratch | None = None
) -> DataFrame:
    """The rows of ``docs`` with ``text_col`` cleaned, and ``n_lines`` and ``n_dropped`` beside it.

    A line goes down a tree of fixed depth: token count, then its first tokens;
    tokens with digits are variable fields. Lines in a leaf that are similar to
    its most frequent one share that one's template, and lines that agree in
    the same share of segments have one of their own (``leaf_templates``). The
    lines of a template that recurs in ``min_docs`` different documents are
    dropped everywhere. Copies and near
    copies of a document (``families``) count once, so that what only they
    share is left to document dedup. Of documents that would lose all their
    lines, those with the same templates, the one with the smallest id (a
    missing one last) keeps its text.

    Blank lines are kept, null texts stay null, empty ones empty. Repeated rows
    come back as often as they came and count once. All other columns are
    passed through untouched, except ones named n_lines or n_dropped, which
    are replaced. An empty table gives an empty one.
    """
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    docs = docs.drop("n_lines", "n_dropped")
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])  # no column of the input can clash with the ones made here
    found = _dedup(inner, f"c{names.index(id_col)}", f"c{names.index(text_col)}", min_docs, scratch)
    return found.toDF(*names, "n_lines", "n_dropped")


def _dedup(docs: DataFrame, id_col: str, text_col: str, min_docs: int, scratch: Scratch) -> DataFrame:
    key = row_key(id_col, text_col)
    rows = scratch.keep("rows", line_rows(docs, id_col, text_col, key))
    of = candidates(rows, min_docs, scratch)
    held = rows.select("line", "row").join(of, "line").select("template", "row").distinct()
    held = held.join(families(rows, scratch).hint("merge"), "row")
    counts = held.groupBy("template").agg(F.count_distinct("doc").alias("docs"))
    frequent = counts.filter(F.col("docs") >= min_docs)
    widest = F.max_by("template", F.struct("docs", "template"))  # of those that a line fits
    bad = scratch.keep("bad", of.join(scratch.keep("frequent", frequent), "template").groupBy("line").agg(widest.alias("template")))
    gone = rows.select("row", "id", "own", "pos", "line").join(bad.hint("merge"), "line").groupBy("row")
    gone = gone.agg(F.collect_set("pos").alias("gone"), F.xxhash64(F.array_sort(F.collect_set("template"))).alias("form"), F.first("own").alias("own"), F.first("id").alias("id"))
    gone = scratch.keep("gone", gone)
    emptied = gone.filter(F.size("gone") == F.col("own")).groupBy("form").agg(F.min(F.struct(F.col("id").isNull(), "id", "row"))["row"].alias("row"))
    gone = gone.join(scratch.keep("stay", emptied.select("row")).hint("merge"), "row", "left_anti")
    gone = gone.select("row", "gone")
    scratch.drop("rows", "templates", "frequent", "bad", "families")
    # Joined by shuffle at any size: what is gone grows with the documents.
    lines = F.split(F.col(text_col), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone")
    kept = let(lines, lambda own: F.array_join(F.transform(left, lambda i: F.get(own, i)), "\n"))
    marked = docs.withColumn("__row", key).join(gone.withColumnRenamed("row", "__row").hint("merge"), "__row", "left")
    changed = F.when(F.col("gone").isNull(), F.col(text_col)).otherwise(kept)
    sizes = [F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped")]
    return marked.select(*[changed.alias(c) if c == text_col else F.col(c) for c in docs.columns], *sizes)
