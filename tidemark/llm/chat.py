"""Chat formatting on tokens: segments are encoded apart and reserved ids spliced between them."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import in_batches

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the word pattern this public vocabulary was made with.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
START, END = 50_257, 50_258  # reserved ids beyond the vocabulary
PART_TOKENS = 1_000_000  # a longer conversation is cut between turns


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def escape(text: str) -> str:
    """``<|`` gets a backslash, and one more if it has some, so no control string is left."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _plain_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def assemble(turns: list[tuple[str, str]], enc: tiktoken.Encoding) -> tuple[np.ndarray, np.ndarray]:
    """Token ids and loss mask of consecutive turns.

    Every turn is START, role, newline, text, END, newline. Only an assistant's
    text is learned: the mask is the prefix sum of +1 where such a segment
    begins and -1 where it ends.
    """
    ids: list[int] = []
    marks: list[tuple[int, int]] = []
    line = enc.encode_ordinary("\n")
    for role, text in turns:
        ids.append(START)
        ids += enc.encode_ordinary(_role(role))
        ids += line
        begin = len(ids)
        ids += enc.encode_ordinary(escape(text))
        if role == "assistant":
            marks += [(begin, 1), (len(ids), -1)]
        ids.append(END)
        ids += line
    steps = np.zeros(len(ids) + 1, np.int64)
    for at, by in marks:
        steps[at] += by
    return np.array(ids, np.int32), np.cumsum(steps)[:-1].astype(np.int8)


def format_conversations(turns: DataFrame, tokenizer: str = RANKS, part_tokens: int = PART_TOKENS) -> DataFrame:
    """(conv_id, part, n_turns, input_ids, loss_mask) of conversations given as (conv_id, turn, role, text).

    Turns go by (turn, role, text), nulls first; a null role or text is empty,
    a null conv_id is a conversation of its own. Repeated rows are turns each.
    A conversation of more than ``part_tokens`` tokens continues in further
    parts, cut between turns, so that memory is bounded by a part and a turn.
    An empty table gives an empty one; further columns are ignored.
    """
    slim = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    by_conv = slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(tokenizer)
        out: list[tuple] = []
        state = {"conv": None, "begun": False, "part": 0, "turns": 0, "size": 0, "ids": [], "mask": []}

        def close() -> None:
            if state["turns"]:
                out.append((state["conv"], state["part"], state["turns"], np.concatenate(state["ids"]), np.concatenate(state["mask"])))
                state.update(part=state["part"] + 1, turns=0, size=0, ids=[], mask=[])

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out))
            lists = [pa.array(columns[3], pa.list_(pa.int32())), pa.array(columns[4], pa.list_(pa.int8()))]
            batch = pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), *lists], ["conv_id", "part", "n_turns", "input_ids", "loss_mask"])
            out.clear()
            return batch

        for batch in parts:
            convs = batch.column("conv_id").to_pylist()
            roles = batch.column("role").to_pylist()
            texts = batch.column("text").to_pylist()
            for conv, role, text in zip(convs, roles, texts):
                if not state["begun"] or conv != state["conv"]:
                    close()
                    state.update(conv=conv, begun=True, part=0)
                ids, mask = assemble([(role or "", text or "")], enc)
                if state["size"] + len(ids) > part_tokens:
                    close()
                state["ids"].append(ids)
                state["mask"].append(mask)
                state["size"] += len(ids)
                state["turns"] += 1
            if out:
                yield flush()
        close()
        if out:
            yield flush()

    return in_batches(by_conv, run, "conv_id long, part int, n_turns long, input_ids array<int>, loss_mask array<byte>")


def split_turns(ids: np.ndarray, mask: np.ndarray, enc: tiktoken.Encoding) -> Iterator[tuple[str, str, str, int]]:
    """(role, text, learned text, formatted characters) of every turn in a part."""
    ends = np.flatnonzero(ids == END)
    line = len(enc.encode_ordinary("\n"))
    for begin, end in zip(np.flatnonzero(ids == START), ends):
        body = enc.decode_bytes(ids[begin + 1 : end].tolist()).decode("utf-8")
        role, _, text = body.partition("\n")
        learned = enc.decode_bytes(ids[begin:end][mask[begin:end] == 1].tolist()).decode("utf-8")
        tail = len(enc.decode_bytes(ids[end + 1 : end + 1 + line].tolist()).decode("utf-8"))
        yield _plain_role(role), unescape(text), unescape(learned), len("<|im_start|>") + len(body) + len("<|im_end|>") + tail


def read_back(formatted: DataFrame, tokenizer: str = RANKS) -> DataFrame:
    """Digests of conversations, read back from ``format_conversations``' own output.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars):
    the turns digest is over role, newline, text, newline of each turn; the loss
    digest over the text under the mask, unescaped. The parts of a conversation
    follow each other, so the digests run along without gathering it.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(tokenizer)
        now: dict | None = None
        for batch in parts:
            out: list[tuple] = []
            for i, (conv, part) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("part").to_pylist())):
                if part == 0:
                    if now is not None:
                        out.append(_row(now))
                    now = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "size": 0}
                ids = batch.column("input_ids")[i].values.to_numpy()
                mask = batch.column("loss_mask")[i].values.to_numpy()
                for role, text, learned, size in split_turns(ids, mask, enc):
                    now["n"] += 1
                    now["turns"].update(f"{role}\n{text}\n".encode())
                    now["loss"].update(learned.encode())
                    now["chars"] += len(learned)
                    now["size"] += size
            if out:
                yield _batch(out)
        if now is not None:
            yield _batch([_row(now)])

    return in_batches(formatted, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _row(now: dict) -> tuple:
    return now["conv"], now["n"], now["turns"].hexdigest(), now["chars"], now["loss"].hexdigest(), now["size"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
