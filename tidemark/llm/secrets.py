"""Secret scans with corpus-wide ownership frequencies, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, row_key

# Kind -> (pattern, group that holds the credential, least characters of that group), in the order of the report.
# A least length inside a pattern finds the same runs as filtering afterwards, as the runs are maximal.
KINDS: dict[str, tuple[str, int, int]] = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
    "issued": (r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{20,}|sk_live_[A-Za-z0-9]{16,})", 0, 20),
    "jwt": (r"\beyJ[A-Za-z0-9_-]{10,}[.]eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}", 0, 30),
    "private": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----", 0, 60),
}
BASE = ("assign", "access", "hex")
SHARED_OWNERS = 3  # a credential that this many owners hold is a copied example
SHARED_REPOS = 10  # and one in this many repositories, whoever owns them
LIVE_LENGTH, LIVE_SYMBOLS = 16, 8  # least length and different characters of a live-looking one

_HIT = "array<struct<kind:int,at:int,gap:int,len:int,secret:string>>"


def _hits(text: Column, number: int, pattern: str, group: int) -> Column:
    """Matches of a pattern with the lengths of the gap before each: splitting at a pattern gives the gaps between its matches."""
    found = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("secret"),
        F.split(text, pattern, -1).alias("gap"),
    )
    rows = F.transform(
        F.filter(found, lambda x: x["hit"].isNotNull()),
        lambda x, i: F.struct(F.lit(number).alias("kind"), i.alias("at"), F.char_length(x["gap"]).alias("gap"), F.char_length(x["hit"]).alias("len"), x["secret"].alias("secret")),
    )
    return F.when(text.rlike(pattern), rows.cast(_HIT)).otherwise(F.array().cast(_HIT))


def secret_hits(docs: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str) -> DataFrame:
    """(row, repo, owner, kind, at, gap, len, secret) of all matches in all rows; ``at`` numbers those of a kind in a row."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"))
    text = F.coalesce(F.col("text"), F.lit(""))
    all_hits = F.flatten(F.array(*[_hits(text, i, p, g) for i, (p, g, _) in enumerate(KINDS.values())]))
    rows = slim.select(row_key("id", "text").alias("row"), F.coalesce("repo", F.lit("")).alias("repo"), F.coalesce("owner", F.lit("")).alias("owner"), F.explode(all_hits).alias("hit"))
    return rows.select("row", "repo", "owner", "hit.*").withColumn("secret_hash", F.sha2("secret", 256))


def _long_enough() -> Column:
    return F.char_length("secret") >= F.element_at(F.array(*[F.lit(n) for _, _, n in KINDS.values()]), F.col("kind") + 1)


def secret_spans(hits: DataFrame) -> DataFrame:
    """(row, kind, start, end, secret, secret_hash) of all candidates; equal rows count once."""
    once = hits.groupBy("row", "kind", "at").agg(*[F.first(c).alias(c) for c in ("gap", "len", "secret", "secret_hash")])
    before = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("len")).over(before)
    placed = once.withColumn("end", end).withColumn("start", F.col("end") - F.col("len"))
    return placed.filter(_long_enough()).select("row", "kind", "start", "end", "secret", "secret_hash")


def ownership(hits: DataFrame) -> DataFrame:
    """(secret_hash, repos, owners): in how many distinct repositories and with how many owners a credential occurs, over all rows."""
    return hits.filter(_long_enough()).groupBy("secret_hash").agg(F.count_distinct("repo").alias("repos"), F.count_distinct("owner").alias("owners"))


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", shared_owners: int = SHARED_OWNERS,
    shared_repos: int | None = SHARED_REPOS,
) -> DataFrame:
    """(doc_id, spans, owned, repos, owners): all credential spans of every row, and how each is held over the corpus.

    ``spans`` are structs (start, kind, end) in code points, end exclusive, in
    the order of ``KINDS``; ``owned`` has, in the same order, ``shared`` for a
    credential with ``shared_owners`` owners or more or in ``shared_repos``
    repositories or more (None leaves it to the owners), else ``live`` if it
    looks random enough, else ``weak``; ``repos`` and ``owners`` have those
    numbers. Every row counts for them, also one equal in id and text to
    another. Spans of different kinds may overlap. Null
    and empty texts have no spans; null repositories or owners count as one.
    Repeated rows come back as often as they came. Texts are read whole and
    never shuffled; only candidates are.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    hits = scratch.keep("hits", secret_hits(docs, id_col, text_col, repo_col, owner_col))
    spans = scratch.keep("spans", secret_spans(hits))
    held = scratch.keep("held", ownership(hits))
    looks_live = (F.char_length("secret") >= LIVE_LENGTH) & (F.size(F.array_distinct(F.split("secret", ""))) >= LIVE_SYMBOLS)
    shared = F.col("owners") >= shared_owners
    if shared_repos is not None:
        shared = shared | (F.col("repos") >= shared_repos)
    label = F.when(shared, "shared").when(looks_live, "live").otherwise("weak")
    marked = spans.join(held, "secret_hash").select("row", F.struct("start", "kind", "end", label.alias("label"), "repos", "owners").alias("span"))
    grouped = scratch.keep("grouped", marked.groupBy("row").agg(F.sort_array(F.collect_list("span")).alias("all")))
    scratch.drop("hits", "spans", "held")
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).select(F.col("id").alias("doc_id"), row_key("id", "text").alias("row"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,label:string,repos:bigint,owners:bigint>>")
    out = keyed.join(grouped, "row", "left").withColumn("all", F.coalesce("all", none))
    return out.select(
        "doc_id",
        F.transform("all", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))).alias("spans"),
        F.transform("all", lambda s: s["label"]).alias("owned"),
        F.transform("all", lambda s: s["repos"]).alias("repos"),
        F.transform("all", lambda s: s["owners"]).alias("owners"),
    )


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
