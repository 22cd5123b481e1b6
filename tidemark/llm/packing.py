"""Best-fit packing of tokenized documents into sequences, by minimum bin slack.

Each document becomes its token ids and an end id. A document longer than the
capacity is cut into capacity-long pieces, the first one taking the remainder,
so only the first may be shorter. Pieces are then packed bin by bin: for each
new bin, a subset-sum over the lengths still free (a bitset of reachable sums,
one shift per copy of a length, largest lengths first) finds the fullest
combination that fits; its pieces fill the bin and leave the pool. A bin that
reaches the capacity ends the search at once.

At scale the pool is cut into groups of about ``GROUP_PIECES`` pieces by a hash
of each piece's own row, so a document or source with a third of all rows is
spread like any other; each group is packed in one task. Grouping costs at
most about one bin per group against packing everything together.

Defined results: a null text is empty and becomes the end id alone (one
piece of length 1); a null id stays null; repeated rows are separate
documents; an empty table gives no rows; only the id and text columns are read,
so other columns of any name do not matter. Very long texts are cut as above.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import tokens
from tidemark.llm.common import Scratch

# Fixed value: the split of texts before the merges of GPT-2-style byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

GROUP_PIECES = 200_000  # pieces packed together in one task
SHIFT = 32  # a group's number sits above this bit of a sequence id

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: the first takes the remainder, all others the capacity."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def ids_crc32(ids: np.ndarray) -> int:
    """CRC-32 of the ids as unsigned little-endian 32-bit integers."""
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


def piece_table(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = True,
                id_col: str = "doc_id", text_col: str = "text", pattern: str = PATTERN) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids): the pieces of every document; ``ids`` is null unless ``with_ids``.

    Ids are those of the byte-level BPE file ``tokenizer`` without added
    tokens around a text (special strings inside it are special tokens);
    ``pattern`` is its split before the merges.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            ids_of = tokens.encode_bytes_bpe(tokenizer, pattern, texts)
            out = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": [], "ids": []}
            for doc, ids in zip(batch.column(0).to_pylist(), ids_of):
                ids = np.asarray([*ids, end_id], dtype=np.int64)
                for p, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + length]
                    out["doc_id"].append(doc)
                    out["piece"].append(p)
                    out["start"].append(start)
                    out["length"].append(length)
                    out["ids_crc32"].append(ids_crc32(part))
                    out["ids"].append(part.astype(np.int32).tolist() if with_ids else None)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
                ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, PIECES)


def min_bin_slack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, bins filled one at a time with the fullest subset that fits.

    Items of equal length are taken in the order given. Every length must lie
    in 1..capacity.
    """
    lengths = np.asarray(lengths, dtype=np.int64)
    if len(lengths) and (lengths.min() < 1 or lengths.max() > capacity):
        raise ValueError("every length must lie between 1 and the capacity")
    order = np.argsort(lengths, kind="stable")
    free = {int(l): list(order[lengths[order] == l][::-1]) for l in np.unique(lengths)}  # stacks: next item at the end
    counts = np.bincount(lengths, minlength=capacity + 1)
    bin_of, offset_of = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    mask, full, left, b = (1 << (capacity + 1)) - 1, 1 << capacity, len(lengths), 0
    while left:
        reach, steps = 1, []
        for l in np.nonzero(counts)[0][::-1].tolist():
            for _ in range(min(int(counts[l]), capacity // l)):
                grown = (reach | (reach << l)) & mask
                if grown == reach:
                    break
                steps.append((l, reach))
                reach = grown
                if reach & full:
                    break
            if reach & full:
                break
        total = reach.bit_length() - 1
        chosen = []
        for l, before in reversed(steps):
            if total and not (before >> total) & 1:
                chosen.append(l)
                total -= l
        at = 0
        for l in sorted(chosen, reverse=True):
            item = free[l].pop()
            counts[l] -= 1
            bin_of[item], offset_of[item] = b, at
            at += l
        left -= len(chosen)
        b += 1
    return bin_of, offset_of


def pack_pieces(pieces: DataFrame, capacity: int = 1024, scratch: Scratch | None = None) -> DataFrame:
    """The pieces with sequence_id (distinct per sequence) and offset (gapless from 0 in each).

    Pieces go to groups by a hash of their row in the written table, which is
    read back the same way when a task is recomputed.
    """
    spark = pieces.sparkSession
    scratch = scratch or Scratch(spark, "packing")
    written = scratch.keep("pieces", pieces)
    groups = max(1, -(-written.count() // GROUP_PIECES))
    keyed = written.withColumn("__item", F.monotonically_increasing_id())
    slim = keyed.select("__item", F.pmod(F.xxhash64("__item"), F.lit(groups)).alias("__group"), "length")

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("__item", kind="stable")
        bins, offsets = min_bin_slack(group["length"].to_numpy(), capacity)
        seq = (group["__group"].to_numpy().astype(np.int64) << SHIFT) + bins
        return pd.DataFrame({"__item": group["__item"].to_numpy(), "sequence_id": seq, "offset": offsets})

    placed = slim.groupBy("__group").applyInPandas(fill, "__item long, sequence_id long, offset long")
    return keyed.join(placed, "__item").drop("__item")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = True,
                   id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset) for every piece of every document."""
    return pack_pieces(piece_table(docs, tokenizer, capacity, end_id, with_ids, id_col, text_col, pattern), capacity, scratch)
