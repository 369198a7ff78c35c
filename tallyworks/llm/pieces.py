"""Encoding to and decoding from SentencePiece vocabularies, with the N best segmentations.

A text's lattice has an edge for every vocabulary piece at every place. Forward Viterbi scores are the exact cost of
the best way to reach a place, so they serve as the heuristic of a backward A-star search from the end of the text,
which then reaches the start once for each of the N best segmentations, best first, and looks at nothing else.

No piece of such a vocabulary runs past the end of a word into the space that follows, so the lattice falls apart at
the spaces. The forward scores of the different words of some hundred texts are taken together, in arrays, along with
what each word's second choice costs; the search then runs on the few words of each text whose second choice is
cheapest, and the N best of the text are put together from those. This is a narrow projection; nothing is shuffled.
"""

from __future__ import annotations

import heapq
import math
import re
from dataclasses import dataclass
from functools import cached_property
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyworks.llm.common import with_arrow_column

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 3
#: Scores are whole multiples of one over this, so that sums are exact and equal segmentations tie exactly; round-off
#: would make the search of a long run of one character try ever more of them.
GRAIN = 1 << 20
#: Score of a byte that stands for part of a character without a piece.
BYTE_SCORE = -25.0
#: Characters of text that are worked on together, and the longest word whose forward scores are taken in arrays.
SLICE, SHORT = 1 << 21, 32
#: Searched words a task remembers before it starts over.
REMEMBERED = 50_000
SPACE = "▁"
#: Words with the spaces before them, and the same with line feeds apart, for a vocabulary in which no piece has one.
WORDS, WORDS_OF_LINES = re.compile(r" *[^ ]+| +"), re.compile(r" *[^ \n]+| +|\n")

NBEST = T.ArrayType(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def spelled(surface: list[bytes], ids) -> str:
    """What pieces spell, without the space that encoding puts first."""
    return b"".join([surface[i] for i in ids]).decode("utf-8", "surrogatepass")[1:]


@dataclass
class Vocabulary:
    """Pieces with ids and scores, and the ids of the 256 bytes."""

    ids: dict[str, int]
    scores: dict[str, float]
    bytes_from: int
    surface: list[bytes]

    @staticmethod
    def load(path: str = MODEL) -> Vocabulary:
        """Read a model file on the driver. Byte-pair pieces, ranked by merge, get the Zipf score -log(rank + 2)."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        ids, scores, surface, bytes_from = {}, {}, [], None
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                bytes_from = i if bytes_from is None else bytes_from
                surface.append(bytes([i - bytes_from]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                surface.append(b"")
            else:
                if re.search(f"[^{SPACE}]{SPACE}", piece):
                    raise ValueError(f"piece {i} runs past the end of a word")
                ids[piece] = i
                scores[piece] = -round(math.log(2 - model.get_score(i)) * GRAIN) / GRAIN
                surface.append(piece.replace(SPACE, " ").encode())
        if bytes_from is None:
            raise ValueError("the vocabulary has no byte pieces")
        return Vocabulary(ids, scores, bytes_from, surface)

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.ids), default=1)

    @cached_property
    def units(self) -> re.Pattern[str]:
        """What a text is cut into; no piece reaches over a cut."""
        return WORDS if any("\n" in p for p in self.ids) else WORDS_OF_LINES

    @cached_property
    def entries(self) -> dict[str, tuple[float, int]]:
        return {p: (self.scores[p], i) for p, i in self.ids.items()}

    def lattice(self, unit: str) -> tuple[list[float], list[list[tuple[int, float, tuple[int, ...]]]]]:
        """(best score to each place, edges that end at each place as (start, score, ids))."""
        # a literal U+2581 isn't a space, so only bytes may stand for it
        key = unit.replace(SPACE, "￿").replace(" ", SPACE)
        entries, longest = self.entries, self.longest
        best, edges = [0.0], [[]]
        for j in range(1, len(key) + 1):
            into = []
            top = -math.inf
            for i in range(max(0, j - longest), j):
                found = entries.get(key[i:j])
                if found:
                    into.append((i, found[0], (found[1],)))
                    if best[i] + found[0] > top:
                        top = best[i] + found[0]
            if not into or into[-1][0] != j - 1:  # this character has no piece
                raw = unit[j - 1].encode("utf-8", "surrogatepass")
                score = BYTE_SCORE * len(raw)
                into.append((j - 1, score, tuple(self.bytes_from + b for b in raw)))
                top = max(top, best[j - 1] + score)
            best.append(top)
            edges.append(into)
        return best, edges

    def n_best(self, unit: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """Up to n segmentations of a unit, best first, by backward A-star over its lattice."""
        best, edges = self.lattice(unit)
        order = count()
        heap = [(-best[-1], 0, len(unit), 0.0, None)]
        out = []
        while heap and len(out) < n:
            _, _, at, after, chain = heapq.heappop(heap)
            if at == 0:
                ids = []
                while chain:
                    ids += chain[0]
                    chain = chain[1]
                out.append((after, tuple(ids)))
                continue
            for i, score, ids in edges[at]:
                heapq.heappush(heap, (-(best[i] + score + after), -next(order), i, score + after, (ids, chain)))
        return out


@dataclass
class Trie:
    """The pieces as a trie in arrays: edges sorted by (node, character), and each node's piece, if any."""

    keys: np.ndarray
    child: np.ndarray
    piece: np.ndarray
    score: np.ndarray

    @staticmethod
    def of(vocabulary: Vocabulary) -> Trie:
        edges: dict[int, int] = {}
        piece, score = [-1], [0.0]
        for text, i in vocabulary.ids.items():
            node = 0
            for ch in text:
                key = node << 21 | ord(ch)
                if key not in edges:
                    edges[key] = len(piece)
                    piece.append(-1)
                    score.append(0.0)
                node = edges[key]
            piece[node], score[node] = i, vocabulary.scores[text]
        keys = np.array(sorted(edges), np.int64)
        return Trie(keys, np.array([edges[k] for k in keys.tolist()], np.int64), np.array(piece, np.int32), np.array(score))

    def forward(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Forward scores of equally long units: (best, second best, pieces of the best in columns, their number).

        A unit with a character that is no piece has the best score -inf.
        """
        n, length = len(units), len(units[0])
        codes = np.array(units, f"U{length}").view(np.uint32).reshape(n, length).T.astype(np.int64)
        codes = np.where(codes == ord(SPACE), 0xFFFF, np.where(codes == 32, ord(SPACE), codes))
        best, second = np.full((2, length + 1, n), -np.inf)
        best[0] = 0
        back_piece, back_from = np.zeros((2, length + 1, n), np.int32)
        plain = np.ones(n, bool)
        for i in range(length):
            rows, node = np.arange(n), np.zeros(n, np.int64)
            for j in range(i + 1, length + 1):
                key = node << 21 | codes[j - 1, rows]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                on = self.keys[at] == key
                rows, node = rows[on], self.child[at[on]]
                whole = self.piece[node] >= 0
                r, end = rows[whole], node[whole]
                if j == i + 1:
                    single = np.zeros(n, bool)
                    single[r] = True
                    plain &= single
                if not len(rows):
                    break
                first, other, old = best[i, r] + self.score[end], second[i, r] + self.score[end], best[j, r]
                second[j, r] = np.maximum(np.maximum(np.minimum(old, first), second[j, r]), other)
                better = first > old
                best[j, r[better]] = first[better]
                back_piece[j, r[better]] = self.piece[end[better]]
                back_from[j, r[better]] = i
        at, every = np.full(n, length), np.arange(n)
        steps, count_of = [], np.zeros(n, np.int64)
        while (at > 0).any():
            steps.append(back_piece[at, every])
            count_of += at > 0
            at = back_from[at, every]
        return np.where(plain, best[length], -np.inf), second[length], np.array(steps), count_of


class Encoder:
    """Encodes texts, remembering the words it has searched."""

    def __init__(self, vocabulary: Vocabulary, n: int = N_BEST) -> None:
        self.vocabulary, self.n, self.known = vocabulary, n, {}
        self.trie = Trie.of(vocabulary)

    def search(self, unit: str) -> list[tuple[float, tuple[int, ...]]]:
        found = self.known.get(unit)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.known[unit] = self.vocabulary.n_best(unit, self.n)
        return found

    def viterbi(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(score, cost of the second choice, number of pieces, all pieces one after another) of each unit's best."""
        score, cost, number = np.zeros(len(units)), np.full(len(units), np.inf), np.zeros(len(units), np.int64)
        lengths = np.array([len(u) for u in units])
        ids: list[np.ndarray] = [np.zeros(0, np.int32)] * len(units)
        hard = np.flatnonzero(lengths > SHORT).tolist()
        for length in np.unique(lengths[lengths <= SHORT]):
            of = np.flatnonzero(lengths == length)
            best, second, steps, count_of = self.trie.forward([units[k] for k in of])
            hard += of[np.isinf(best)].tolist()
            score[of], number[of] = best, count_of
            cost[of] = np.where(np.isinf(second) | np.isinf(best), np.inf, np.where(np.isinf(best), 0, best) - second)
            for c, k in enumerate(of):
                ids[k] = steps[: count_of[c], c][::-1]
        for k in hard:
            found = self.search(units[k])
            score[k], ids[k] = found[0][0], np.array(found[0][1], np.int32)
            number[k], cost[k] = len(ids[k]), found[0][0] - found[1][0] if len(found) > 1 else np.inf
        return score, cost, number, np.concatenate(ids)

    def encode_all(self, texts: list[str | None]) -> list[list[tuple[float, np.ndarray]]]:
        """Up to n segmentations of each text, best first; null and empty texts have one without pieces."""
        out, first, size = [], 0, 0
        for i, t in enumerate(texts):
            if size and size + len(t or "") > SLICE:
                out += self._encode(texts[first:i])
                first, size = i, 0
            size += len(t or "")
        return out + self._encode(texts[first:])

    def _encode(self, texts: list[str | None]) -> list[list[tuple[float, np.ndarray]]]:
        index: dict[str, int] = {}
        rows = [np.array([index.setdefault(u, len(index)) for u in self.vocabulary.units.findall(" " + t)]) if t else None for t in texts]
        if not index:
            return [[(0.0, np.zeros(0, np.int32))] for _ in texts]
        words = list(index)
        score, cost, number, flat = self.viterbi(words)
        start = np.cumsum(number) - number
        out = []
        for units in rows:
            if units is None:
                out.append([(0.0, np.zeros(0, np.int32))])
                continue
            counts = number[units]
            upto = np.cumsum(counts)
            best = flat[np.arange(upto[-1]) + np.repeat(start[units] - upto + counts, counts)]
            out.append(self._combine(units, words, score, cost[units], best, upto))
        return out

    def _combine(self, units, words, score, cost, best, upto) -> list[tuple[float, np.ndarray]]:
        """The text's N best. Its k-th best differs from its best only in words among the k - 1 cheapest to change."""
        some = min(self.n - 1, len(units))
        places = np.argsort(cost, kind="stable")[:some] if some == len(units) else np.argpartition(cost, some)[:some]
        places = sorted(p for p in places.tolist() if cost[p] < np.inf)
        choices = [self.search(words[units[p]]) for p in places]
        top = math.fsum(score[units])
        start = (0,) * len(places)
        heap, seen, out = [(-top, start)], {start}, []
        while heap and len(out) < self.n:
            total, picks = heapq.heappop(heap)
            parts, at = [], 0
            for p, own, k in zip(places, choices, picks, strict=True):
                if k:
                    parts += [best[at : upto[p - 1] if p else 0], np.array(own[k][1], np.int32)]
                    at = upto[p]
            out.append((-total, np.concatenate([*parts, best[at:]])))
            for c, own in enumerate(choices):
                new = (*picks[:c], picks[c] + 1, *picks[c + 1 :])
                if new[c] < len(own) and new not in seen:
                    seen.add(new)
                    heapq.heappush(heap, (total + own[picks[c]][0] - own[new[c]][0], new))
        return out

    def encode(self, text: str | None) -> list[tuple[float, np.ndarray]]:
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        """The text of which ``ids`` are a segmentation, to the character."""
        return spelled(self.vocabulary.surface, ids)


def with_pieces(docs: DataFrame, text: str = "text", out: str = "nbest", model: str = MODEL, n: int = N_BEST) -> DataFrame:
    """Add the N best segmentations of every whole text: an array of (score, ids), best first.

    Null and empty texts have one segmentation without pieces. Every character is kept: one that no piece covers
    becomes its UTF-8 bytes. Of equally good segmentations any may come first, the same one every time. An existing
    column called ``out`` is replaced, all others stay.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))  # a vocabulary, whatever the corpus

    def work():
        encoder = Encoder(vocabulary.value, n)

        def encode(texts: list[str | None]) -> pa.Array:
            found = encoder.encode_all(texts)
            every = [x for f in found for x in f]
            ids = pa.ListArray.from_arrays(_offsets(i for _, i in every), pa.array(np.concatenate([i for _, i in every]), pa.int32()))
            pairs = pa.StructArray.from_arrays([pa.array([s for s, _ in every], pa.float64()), ids], ["score", "ids"])
            return pa.ListArray.from_arrays(_offsets(found), pairs)

        return encode

    return with_arrow_column(docs, text, out, NBEST, work)


def _offsets(parts) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum([len(p) for p in parts])]), pa.int32())


def with_text(docs: DataFrame, ids: str = "ids", out: str = "decoded", model: str = MODEL) -> DataFrame:
    """Add the text that an array of piece ids spells; a null array gives null, an empty one the empty text."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    def work():
        surface = vocabulary.value.surface
        length = np.array([len(s) for s in surface])
        start, flat = np.cumsum(length) - length, np.frombuffer(b"".join(surface), np.uint8)
        return lambda rows: _spelled_all(flat, start, length, rows)

    return with_arrow_column(docs, ids, out, T.StringType(), work, weight=1 << 18, as_list=False)


def _spelled_all(flat: np.ndarray, start: np.ndarray, length: np.ndarray, rows: pa.Array) -> pa.Array:
    """``spelled`` of many rows at once; piece i is ``length[i]`` bytes of ``flat`` from ``start[i]``."""
    ids = rows.flatten().to_numpy(zero_copy_only=False)
    upto = np.cumsum(rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    size = length[ids]
    ends = np.concatenate([[0], np.cumsum(size)])
    whole = flat[np.arange(ends[-1]) + np.repeat(start[ids] - ends[:-1], size)]
    offsets = pa.array(ends[np.concatenate([[0], upto])], pa.int32(), mask=np.append(rows.is_null().to_numpy(zero_copy_only=False), False))
    parts = pa.ListArray.from_arrays(offsets, pa.array(whole, pa.uint8()))
    raw = pa.Array.from_buffers(pa.binary(), len(rows), [parts.buffers()[0], parts.buffers()[1], pa.py_buffer(whole)])
    return pc.utf8_slice_codeunits(raw.cast(pa.string()), 1)
