"""Public tokenizers, loaded once per Python worker, and the bytes each of their tokens stands for."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one core per task, as Spark counts them


@functools.lru_cache(maxsize=4)
def byte_bpe(path: str, plain_specials: bool = False):
    """A ``tokenizers`` tokenizer; with ``plain_specials`` the strings of special tokens in a text are ordinary text."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = plain_specials
    return tok


@functools.lru_cache(maxsize=4)
def byte_bpe_encoder(path: str, pattern: str):
    """The vocabulary of a byte-level BPE file as a ``tiktoken`` encoding: the same ids, several times faster.

    A token's rank is its id, which is the order of the merges in these
    vocabularies; ``pattern`` is the split before the merges. Tests compare the
    ids with those of ``tokenizers``.
    """
    import tiktoken

    tok = byte_bpe(path)
    alphabet = byte_level_alphabet()
    specials = {t.content: i for i, t in tok.get_added_tokens_decoder().items()}
    ranks = {bytes(alphabet[c] for c in token): i for token, i in tok.get_vocab(with_added_tokens=False).items() if token not in specials}
    return tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens=specials)


def encode_bytes_bpe(path: str, pattern: str, texts: list[str], plain_specials: bool = False) -> list[list[int]]:
    """Ids of each text without added tokens around it; the strings of special tokens are those tokens unless ``plain_specials``."""
    enc = byte_bpe_encoder(path, pattern)
    if plain_specials:
        return [enc.encode_ordinary(t) for t in texts]
    return [enc.encode(t, allowed_special="all") for t in texts]


@functools.lru_cache(maxsize=4)
def piece_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def byte_level_alphabet() -> dict[str, int]:
    """The printable character that byte-level BPE writes for each byte value.

    Bytes that print as themselves (``!`` to ``~``, ``¡`` to ``¬``, ``®`` to
    ``ÿ``) keep their code point; the others, in increasing order, take code
    points from 256 upwards.
    """
    kept = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    shown, extra = {}, 0
    for b in range(256):
        if b in kept:
            shown[chr(b)] = b
        else:
            shown[chr(256 + extra)] = b
            extra += 1
    return shown


@functools.lru_cache(maxsize=4)
def byte_bpe_bytes(path: str) -> list[bytes]:
    """Bytes of every id of a byte-level BPE vocabulary; added tokens stand for their own UTF-8."""
    tok = byte_bpe(path)
    alphabet = byte_level_alphabet()
    size = tok.get_vocab_size(with_added_tokens=True)
    out = [b""] * size
    specials = {t.content for t in tok.get_added_tokens_decoder().values()}
    for token, i in tok.get_vocab(with_added_tokens=True).items():
        out[i] = token.encode() if token in specials else bytes(alphabet[c] for c in token)
    return out


@functools.lru_cache(maxsize=4)
def piece_bytes(path: str) -> list[bytes]:
    """Bytes of every piece: UTF-8 with U+2581 as a space, ``<0xHH>`` as byte HH."""
    model = piece_model(path)
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            out.append(bytes([int(piece[3:5], 16)]))
        else:
            out.append(piece.replace("▁", " ").encode())
    return out


@functools.lru_cache(maxsize=8)
def byte_sizes(entries: Callable[[str], list[bytes]], path: str) -> np.ndarray:
    """How many bytes each id stands for, by ``byte_bpe_bytes`` or ``piece_bytes``."""
    return np.array([len(x) for x in entries(path)], np.int64)
