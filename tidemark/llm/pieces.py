"""N-best encoding with a SentencePiece vocabulary, and decoding."""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from tidemark.llm.common import in_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BEST = 4  # segmentations of a text
CACHED = 300_000  # words whose segmentation a task remembers, and as many older ones
TOGETHER = 1_000_000  # characters of texts whose new words are segmented together
BLOCK = 16_384  # words of similar length in one pass
NORMAL, BYTE = 1, 6  # kinds of pieces in the model file
SPACE = "▁"  # how the vocabulary writes a blank
UNUSED = -1e8  # pieces below this score are there for decoding
LEAST = float("-inf")
LONG = 64  # characters above which a word's segmentations are ranked from chains and not remembered
BELOW = 10.0  # a character without a piece scores this much less than the worst single character


class _Known(dict):
    """Segmentations of words met lately. When full, it becomes the older half; what is met again there comes back."""

    def __init__(self, segment):
        super().__init__()
        self.segment, self.older = segment, {}

    def __missing__(self, word: str) -> tuple[bytes, float, float]:
        hit = self.older.get(word)
        if hit is None:
            hit = self.segment(word)
        if len(self) >= CACHED:
            self.age()
        self[word] = hit
        return hit

    def age(self) -> None:
        self.older = dict(self)
        self.clear()

    def new(self, words: set[str]) -> list[str]:
        """Those of the words that are not known; the others are among the younger half afterwards."""
        if len(self) >= CACHED:
            self.age()
        fresh, older = [], self.older
        for word in words.difference(self):
            hit = older.get(word)
            if hit is None:
                fresh.append(word)
            else:
                self[word] = hit
        return fresh


class Vocabulary:
    """Pieces with ids and scores; a blank is written as itself, so the sign SPACE in a text is a character like any other."""

    def __init__(self, path: str):
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        self.ids: dict[str, tuple[int, float]] = {}
        self.spelled: list[bytes] = []
        self.bytes: dict[int, int] = {}
        for i, p in enumerate(model.pieces):
            spelled = b""
            if p.type == NORMAL:
                text = p.piece.replace(SPACE, " ")
                self.ids[text] = (i, float(p.score))
                spelled = text.encode()
            elif p.type == BYTE:
                value = int(p.piece[1:-1], 16)
                self.bytes[value] = i
                spelled = bytes([value])
            self.spelled.append(spelled)
        singles = [x for t, (_, x) in self.ids.items() if len(t) == 1 and x > UNUSED]
        self.unknown = min(singles) - BELOW
        # A tree of characters, so that a walk along a text ends where no piece goes on: [next characters, id or -1, score].
        self.tree: dict[str, list] = {}
        for text, (i, score) in self.ids.items():
            down = self.tree
            for char in text[:-1]:
                down = down.setdefault(char, [{}, -1, 0.0])[0]
            node = down.setdefault(text[-1], [{}, -1, 0.0])
            node[1], node[2] = i, score
        self.joined = {t[k : k + 2] for t in self.ids for k in range(len(t) - 1)}
        # Words are cut before blanks and around line ends, unless a piece reaches across.
        crosses = any(" " in t.lstrip(" ") or ("\n" in t and len(t) > 1) for t in self.ids)
        self.words = re.compile(r"(?s).+" if crosses else r" *[^ \n]+| +|\n")
        self._flatten()
        self.known = _Known(self.best)
        self.ranked: dict[tuple[str, int], list[tuple[float, tuple[int, ...]]]] = {}

    def _flatten(self) -> None:
        """The tree as sorted arrays: a node and a character lead to the place of (next node, piece, its score)."""
        letters = sorted({c for t in self.ids for c in t})
        self.letter = np.zeros(ord(letters[-1]) + 2, np.int64)  # 0 is any other character
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        keys, pieces, scores, queue = [], [], [], [(0, self.tree)]
        for at, down in queue:  # grows as it is read
            for char, (below, piece, score) in down.items():
                keys.append(at * self.width + int(self.letter[ord(char)]))
                pieces.append(piece)
                scores.append(score)
                queue.append((len(keys), below))
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[order]
        self.next = order + 1
        self.piece = np.array(pieces, np.int32)[order]
        self.score = np.array(scores, np.float64)[order]
        pairs = np.array([ord(p[0]) << 32 | ord(p[1]) for p in self.joined], np.int64)
        self.pairs = np.sort(pairs)

    def edges(self, word: str) -> list[tuple[int, int, float, int]]:
        """The piece lattice: (start, end, score, id) in order of starts; id -1 is a character spelled in bytes."""
        out, n = [], len(word)
        for i in range(n):
            down, single = self.tree, False
            for j in range(i, n):
                node = down.get(word[j])
                if node is None:
                    break
                down, piece, s = node
                if piece >= 0:
                    out.append((i, j + 1, s, piece))
                    single = single or j == i
            if not single:
                out.append((i, i + 1, self.unknown, -1))
        return out

    def spell(self, word: str, i: int, piece: int) -> tuple[int, ...]:
        return (piece,) if piece >= 0 else tuple(self.bytes[b] for b in word[i].encode())

    def parts(self, word: str) -> list[str]:
        """The word, cut between characters that no piece holds next to each other: every segmentation is cut there."""
        joined, out, at = self.joined, [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in joined:
                out.append(word[at:i])
                at = i
        out.append(word[at:])
        return out

    def best(self, word: str) -> tuple[bytes, float, float]:
        """Ids (as bytes), score, and how much worse the second segmentation is, of one word."""
        parts = self.parts(word)
        if len(parts) == 1:
            return self.two_best(word)
        spelled, scores, gaps = zip(*[self.known[p] for p in parts])
        return b"".join(spelled), sum(scores), min(gaps)

    def two_best(self, word: str) -> tuple[bytes, float, float]:
        """What ``best`` returns, by a forward pass that keeps the two best scores of every prefix."""
        tree, n = self.tree, len(word)
        alpha, second, back = [0.0] + [LEAST] * n, [LEAST] * (n + 1), [None] * (n + 1)
        for i in range(n):
            a, b = alpha[i], second[i]
            down, single, j = tree, False, i
            for char in word[i:]:
                node = down.get(char)
                if node is None:
                    break
                down, piece, s = node
                j += 1
                if piece >= 0:
                    if j == i + 1:
                        single = True
                    score = a + s
                    if score > alpha[j]:
                        second[j] = max(alpha[j], b + s)
                        alpha[j] = score
                        back[j] = (i, piece)
                    elif score > second[j]:
                        second[j] = score
            if not single:
                j, score = i + 1, a + self.unknown
                if score > alpha[j]:
                    second[j] = max(alpha[j], b + self.unknown)
                    alpha[j] = score
                    back[j] = (i, -1)
                elif score > second[j]:
                    second[j] = score
        ids: list[int] = []
        at = n
        while at:
            i, piece = back[at]
            if piece >= 0:
                ids.append(piece)
            else:
                ids += self.spell(word, i, piece)[::-1]
            at = i
        ids.reverse()
        return array("i", ids).tobytes(), alpha[n], alpha[n] - second[n]

    def learn(self, words: set[str]) -> None:
        """Makes ``known`` hold what ``best`` returns of these words; all new ones are segmented together."""
        known = self.known
        fresh = known.new(words)
        if not fresh:
            return
        whole, cut = [], []
        for word, parts in zip(fresh, self.all_parts(fresh)):
            if parts is None:
                whole.append(word)
            else:
                cut.append((word, parts))
        self._segment(whole)
        self._segment([p for p in {p for _, parts in cut for p in parts} if p not in known])
        for word, parts in cut:
            spelled, scores, gaps = zip(*[known[p] for p in parts])
            known[word] = b"".join(spelled), sum(scores), min(gaps)

    def forget(self) -> None:
        """A worker that waits for its next task holds no words."""
        self.known.clear()
        self.known.older = {}
        self.ranked.clear()

    def all_parts(self, words: list[str]) -> list[list[str] | None]:
        """``parts`` of every word, None for one that is not cut."""
        codes, ends = _codes(words)
        pairs = codes[:-1] << 32 | codes[1:]
        cuts = np.ones(len(codes), bool)
        if len(self.pairs):
            cuts[1:] = self.pairs[np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)] != pairs
        cuts[np.r_[0, ends[:-1]]] = False
        at = np.flatnonzero(cuts)
        owner = np.searchsorted(ends, at, "right")
        out: list[list[str] | None] = [None] * len(words)
        starts, last = ends - np.diff(ends, prepend=0), {}
        for k, i in zip(owner.tolist(), (at - starts[owner]).tolist()):
            if out[k] is None:
                out[k] = []
            out[k].append(words[k][last.get(k, 0) : i])
            last[k] = i
        for k, i in last.items():
            out[k].append(words[k][i:])
        return out

    def _segment(self, words: list[str]) -> None:
        known = self.known
        words = sorted(words, key=len)
        for at in range(0, len(words), BLOCK):
            block = words[at : at + BLOCK]
            long = [w for w in block if len(w) > LONG]
            for word in long:
                known[word] = self.two_best(word)
            if len(long) < len(block):
                block = block[: len(block) - len(long)]
                known.update(zip(block, self.two_best_of_all(block)))

    def two_best_of_all(self, words: list[str]) -> Iterator[tuple[bytes, float, float]]:
        """What ``two_best`` returns, of words in the order of their lengths: its pass with one step for all words at a place."""
        flat, ends = _codes(words)
        sizes = np.diff(ends, prepend=0)
        many, longest = len(words), int(sizes[-1])
        rows = np.arange(many)
        chars = np.zeros((longest, many), np.int64)
        within = np.arange(len(flat)) - np.repeat(ends - sizes, sizes)
        chars[within, np.repeat(rows, sizes)] = self.letter[np.minimum(flat, len(self.letter) - 1)]
        alpha, second = np.full((longest + 1, many), LEAST), np.full((longest + 1, many), LEAST)
        alpha[0] = 0.0
        back, piece = np.zeros((longest + 1, many), np.int32), np.full((longest + 1, many), -1, np.int32)

        def offer(j: int, i: int, at: np.ndarray, a: np.ndarray, b: np.ndarray, s: np.ndarray | float, by: np.ndarray | int) -> None:
            score, was, next_best = a + s, alpha[j][at], second[j][at]
            better = score > was
            second[j][at] = np.where(better, np.maximum(was, b + s), np.maximum(next_best, score))
            alpha[j][at] = np.where(better, score, was)
            at = at[better]
            back[j][at] = i
            piece[j][at] = by[better] if isinstance(by, np.ndarray) else by

        for i in range(longest):
            begun = int(np.searchsorted(sizes, i, "right"))  # words that go on here are the last ones
            at, node, j = rows[begun:], np.zeros(many - begun, np.int64), i
            lone = np.ones(many, bool)
            while len(at):
                wanted = node * self.width + chars[j][at]
                place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
                there = self.keys[place] == wanted
                at, place = at[there], place[there]
                j += 1
                ids = self.piece[place]
                whole = ids >= 0
                ended, ids = at[whole], ids[whole]
                if len(ended):
                    if j == i + 1:
                        lone[ended] = False
                    offer(j, i, ended, alpha[i][ended], second[i][ended], self.score[place[whole]], ids)
                node = self.next[place]
                if j == longest:
                    break
                goes_on = sizes[at] > j
                at, node = at[goes_on], node[goes_on]
            unknown = begun + np.flatnonzero(lone[begun:])
            if len(unknown):
                offer(i + 1, i, unknown, alpha[i][unknown], second[i][unknown], self.unknown, -1)
        best = alpha[sizes, rows]
        gaps = best - second[sizes, rows]
        # From the ends: the ids of a word are the last ones of its row.
        line, at, column, in_bytes = np.zeros((many, longest), np.int32), sizes.copy(), longest, np.zeros(many, bool)
        left, first = rows, np.zeros(many, np.int64)
        while len(left):
            column -= 1
            ids = piece[at[left], left]
            line[left, column] = ids
            first[left] = column
            in_bytes[left[ids < 0]] = True
            at[left] = back[at[left], left]
            left = left[at[left] > 0]
        spelled = line.tobytes()
        for word, begin, end, odd, score, gap in zip(words, (4 * (rows * longest + first)).tolist(), (4 * (rows + 1) * longest).tolist(), in_bytes.tolist(), best.tolist(), gaps.tolist()):
            yield self.two_best(word) if odd else (spelled[begin:end], score, gap)

    def n_best(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        if len(word) > LONG:
            return n_best_of_long(self, word, n)
        hit = self.ranked.get((word, n))
        if hit is None:
            if len(self.ranked) >= CACHED // 10:
                self.ranked.clear()
            hit = self.ranked[word, n] = n_best(self, word, n)
        return hit


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, and where each word ends."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    return codes, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))


def forward(edges: list[tuple[int, int, float, int]], n: int) -> tuple[list[float], list]:
    """Viterbi: the best score of every prefix, and its last edge; of equal ones the longer piece."""
    alpha, back = [0.0] + [LEAST] * n, [None] * (n + 1)
    for edge in edges:
        i, j, s, _ = edge
        s += alpha[i]
        if s > alpha[j]:
            alpha[j] = s
            back[j] = edge
    return alpha, back


def n_best(vocabulary: Vocabulary, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The ``n`` best segmentations of a word: (score, ids), best first.

    A-star from the end: a partial segmentation is ranked by its score plus the
    forward score of what is left, which is exact, so segmentations are
    completed in their order. Of equal ones the first by ids from the end.
    """
    edges = vocabulary.edges(word)
    alpha, _ = forward(edges, len(word))
    into: list[list] = [[] for _ in range(len(word) + 1)]
    for i, j, s, piece in edges:
        into[j].append((i, s, vocabulary.spell(word, i, piece)[::-1]))
    queue = [(-alpha[-1], (), len(word), 0.0)]
    done: list[tuple[float, tuple[int, ...]]] = []
    while queue and len(done) < n:
        _, tail, at, score = heapq.heappop(queue)
        if at == 0:
            done.append((score, tail[::-1]))
            continue
        for i, s, own in into[at]:
            heapq.heappush(queue, (-(alpha[i] + s + score), tail + own, i, s + score))
    return done


class _Tail:
    """The last piece added to a segmentation from the end, and what was there before it.

    ``jump`` leads further back, so that the place where two chains part is
    found in steps that grow with the logarithm of their length.
    """

    __slots__ = ("score", "own", "up", "depth", "jump")

    def __init__(self, score: float, own: tuple[int, ...], up: _Tail | None):
        self.score, self.own, self.up = score, own, up
        if up is None:
            self.depth, self.jump = 0, self
        else:
            self.depth = up.depth + 1
            far = up.jump
            self.jump = far.jump if up.depth - far.depth == far.depth - far.jump.depth else up

    def __lt__(self, other: _Tail) -> bool:
        """Higher scores first, of equal ones the first by ids from the end."""
        if self.score != other.score:
            return self.score > other.score
        a, b = self._at(other.depth), other._at(self.depth)
        if a is b:
            return self.depth < other.depth
        while a.up is not b.up:
            a, b = (a.jump, b.jump) if a.jump is not b.jump else (a.up, b.up)
        return a.own < b.own

    def _at(self, depth: int) -> _Tail:
        at = self
        while at.depth > depth:
            at = at.jump if at.jump.depth >= depth else at.up
        return at

    def ids(self) -> tuple[int, ...]:
        out, at = [], self
        while at.up is not None:
            out += at.own[::-1]
            at = at.up
        return tuple(out)


def n_best_of_long(vocabulary: Vocabulary, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """What ``n_best`` returns, with the ``n`` best tails of every place as chains: memory grows with the word's length, not its square."""
    size = len(word)
    best: list[list[_Tail]] = [[] for _ in range(size)] + [[_Tail(0.0, (), None)]]
    for i in range(size - 1, -1, -1):
        found, single, down = [], False, vocabulary.tree
        for j in range(i, size):
            node = down.get(word[j])
            if node is None:
                break
            down, piece, s = node
            if piece >= 0:
                single = single or j == i
                found += [_Tail(s + tail.score, (piece,), tail) for tail in best[j + 1]]
        if not single:
            own = vocabulary.spell(word, i, -1)[::-1]
            found += [_Tail(vocabulary.unknown + tail.score, own, tail) for tail in best[i + 1]]
        best[i] = heapq.nsmallest(n, found)
    return [(tail.score, tail.ids()) for tail in best[0]]


def encode_all(vocabulary: Vocabulary, texts: list[str], n: int = BEST) -> list[tuple[np.ndarray, float, list[tuple[float, list[tuple[int, int, tuple[int, ...]]]]]]]:
    """``encode`` of every text; new words of about TOGETHER characters of text are segmented together."""
    out, words, size = [], [], 0
    for at, text in enumerate(texts, 1):
        words.append(vocabulary.words.findall(" " + text) if text else [])
        size += len(text)
        if size >= TOGETHER or at == len(texts):
            vocabulary.learn(set().union(*words))
            out += [_encode(vocabulary, w, n) for w in words]
            words, size = [], 0
    return out


def encode(vocabulary: Vocabulary, text: str, n: int = BEST) -> tuple[np.ndarray, float, list[tuple[float, list[tuple[int, int, tuple[int, ...]]]]]]:
    """Best ids and score of a whole text, and its next ``n - 1`` segmentations as edits of the best.

    Pieces do not reach across words, so segmentations of a text are chosen
    word by word. Only the ``n - 1`` words whose second choice costs least can
    differ in the ``n`` best, as each of them alone is a better change than any
    other word. An edit is (first token, tokens it replaces, new ids).
    """
    return _encode(vocabulary, vocabulary.words.findall(" " + text) if text else [], n)


def _encode(vocabulary: Vocabulary, words: list[str], n: int) -> tuple[np.ndarray, float, list[tuple[float, list[tuple[int, int, tuple[int, ...]]]]]]:
    if not words:
        return np.zeros(0, np.int32), 0.0, []
    spelled, scores, gaps = zip(*map(vocabulary.known.__getitem__, words))
    ids, score = np.frombuffer(b"".join(spelled), np.int32), float(sum(scores))
    if n < 2:
        return ids, score, []
    gaps = np.array(gaps)
    near = _least(gaps, min(n - 1, len(gaps)))
    kept: list[tuple[float, list]] = [(0.0, [])]
    for at in sorted(near[np.isfinite(gaps[near])].tolist()):
        start = sum(map(len, spelled[:at])) // 4
        choices = vocabulary.n_best(words[at], n)
        first = tuple(np.frombuffer(spelled[at], np.int32).tolist())
        others = [(s - scores[at], c) for s, c in choices if c != first]
        grown = list(kept)
        for cost, edits in kept:
            grown += [(cost + by, [*edits, (start, len(first), c)]) for by, c in others]
        grown.sort(key=lambda x: (-x[0], x[1]))
        kept = grown[:n]
    return ids, score, [(score + cost, edits) for cost, edits in kept[1:]]


def _least(gaps: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` smallest, of equal ones the first."""
    bound = np.partition(gaps, k - 1)[k - 1]
    at = np.flatnonzero(gaps <= bound)
    return at[np.argsort(gaps[at], kind="stable")[:k]]


def decode(vocabulary: Vocabulary, ids: list[int]) -> str:
    """The text of ids; bytes that are no UTF-8 become replacement signs. Control pieces are silent."""
    spelled = vocabulary.spelled
    return b"".join([spelled[i] for i in ids])[1:].decode("utf-8", "replace")


def with_edits(ids: list[int], edits: list[tuple[int, int, list[int]]]) -> list[int]:
    """A further segmentation's ids: the best ones with its edits, which are in order of their place."""
    out, at = [], 0
    for start, drop, new in edits:
        out += [*ids[at:start], *new]
        at = start + drop
    return [*out, *ids[at:]]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


ENCODED = "input_ids array<int>, n_tokens long, score double, nbest array<struct<score:double,edits:array<struct<start:int,drop:int,ids:array<int>>>>>"


def _lists(counts: list[int], values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.array(counts, np.int64))].astype(np.int32)), values)


def _alternatives(texts: list[list[tuple[float, list[tuple[int, int, tuple[int, ...]]]]]]) -> pa.ListArray:
    """The nbest column of a batch."""
    ranked = [a for t in texts for a in t]
    edits = [e for _, es in ranked for e in es]
    ids = _lists([len(e[2]) for e in edits], pa.array([i for e in edits for i in e[2]], pa.int32()))
    places = [pa.array([e[k] for e in edits], pa.int32()) for k in (0, 1)]
    changes = _lists([len(es) for _, es in ranked], pa.StructArray.from_arrays([*places, ids], ["start", "drop", "ids"]))
    scored = pa.StructArray.from_arrays([pa.array([s for s, _ in ranked], pa.float64()), changes], ["score", "edits"])
    return _lists([len(t) for t in texts], scored)


def encode_texts(docs: DataFrame, model: str = MODEL, n: int = BEST, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with input_ids, n_tokens, score and nbest added (columns of these names are replaced).

    ``input_ids`` is the best segmentation of the whole text, ``nbest`` the
    following ``n - 1`` with their scores, as edits of the best; short texts
    may have fewer. A null or empty text has no tokens and no alternatives.
    Characters without a piece are spelled in bytes, so decoding is exact.
    """
    added = {"input_ids", "n_tokens", "score", "nbest"}
    slim = docs.select([c for c in docs.columns if c.lower() not in added])
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in slim.schema)}, {ENCODED}"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        v.forget()  # of a task that was not read to its end
        for part in parts:
            got = encode_all(v, [t or "" for t in part.column(text_col).to_pylist()], n)
            sizes = np.array([len(g[0]) for g in got], np.int64)
            flat = np.concatenate([g[0] for g in got]) if got else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat, pa.int32()))
            columns = [*part.columns, lists, pa.array(sizes), pa.array([g[1] for g in got], pa.float64()), _alternatives([g[2] for g in got])]
            yield pa.record_batch(columns, [*part.schema.names, "input_ids", "n_tokens", "score", "nbest"])
        v.forget()

    return in_batches(slim, run, schema)


def decode_texts(encoded: DataFrame, model: str = MODEL, ids_col: str = "input_ids") -> DataFrame:
    """The rows of ``encoded`` with ``decoded``: the text that ``ids_col`` spells; null ids give null."""
    slim = encoded.select([c for c in encoded.columns if c.lower() != "decoded"])
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in slim.schema)}, decoded string"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        sizes = np.array([len(b) for b in v.spelled], np.int64)
        for part in parts:
            lists = part.column(ids_col)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            line = b"".join(map(v.spelled.__getitem__, flat.tolist()))
            ends = np.r_[0, np.cumsum(sizes[flat])][np.cumsum(lists.value_lengths().fill_null(0).to_numpy())]
            starts = np.r_[0, ends[:-1]]
            texts = [line[a + 1 : b].decode("utf-8", "replace") if known else None for a, b, known in zip(starts.tolist(), ends.tolist(), lists.is_valid().to_pylist())]
            yield pa.record_batch([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])

    return in_batches(slim, run, schema)
