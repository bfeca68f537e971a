"""N-best segmentation of texts into the pieces of a given SentencePiece vocabulary.

A chunk of the text (a run of spaces and the letters, or the other characters, after
it) is a lattice of pieces; no piece of the vocabulary crosses a chunk's border (where
one mixes letters with others, chunks reach to the next space), so a text's lattice is
the chain of its chunks'. A forward Viterbi pass gives every position its best score
from the left; a backward one gives each chunk the loss of its second best. Both run
over the lattices of all new chunks of a batch at once. For the whole text the N best
are made from the chunks' alternatives: only the N - 1 places whose second best loses
least can take part. In these the forward scores are the exact heuristics of an A-star
search that starts at the end: the hypotheses leave the queue in the order of their
whole scores (kept as the loss against the best), so the first N complete ones are the
N best. All N are given with their ids. Characters without a piece fall back to the
pieces of their bytes.

Defined results: a null text counts as empty; an empty text has one segmentation,
without pieces, of score 0; very long texts and chunks are segmented whole, in time in
proportion to their length; ties are ordered by the search (the same for the same
text); repeated rows are segmented alike; an empty table gives an empty one; other
columns are ignored. ``decode(encode(t)) == t`` for every text.
"""

from __future__ import annotations

import re
import zlib
from bisect import insort
from collections.abc import Iterator
from heapq import heappop, heappush
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import ship

VOCABULARY = "piece_bpe_32k.model"
N_BEST = 4
#: Loss of a character without a piece below the worst piece.
UNKNOWN = 10.0
#: Chunks, and bytes of chunks and ids, that a worker remembers at most; beyond that it starts anew.
REMEMBERED = 500_000
HELD = 64 << 20
#: Characters of a chunk that is solved together with others.
SHORT = 64
_CHUNK = re.compile(r" +[^ ]*|[^ ]+")
#: Finer chunks, for vocabularies without a piece that mixes letters with other characters.
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0370-\u03ff\u0400-\u04ff"
_WORDS = re.compile(f" *[{_LETTER}]+| *[^ {_LETTER}]+| +")
_MIXED = re.compile(f"[{_LETTER}][^{_LETTER}]|[^ {_LETTER}][{_LETTER}]|[^ ] ")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Lattices:
    """Forward and backward best scores of many chunks at once, by arrays over all their lattices."""

    def __init__(self, pieces: dict[str, tuple[float, int]], unknown: float):
        chars = sorted({c for piece in pieces for c in piece})
        self.width = len(chars) + 1
        self.number = np.zeros(0x110000, np.int32)
        self.number[[ord(c) for c in chars]] = np.arange(1, self.width)
        number = dict(zip(chars, range(1, self.width), strict=True))
        nodes: dict[int, int] = {}  # node * width + character to node
        ids, scores = [-1], [0.0]
        for piece, (score, i) in pieces.items():
            at = 0
            for c in piece:
                key = at * self.width + number[c]
                at = nodes.setdefault(key, len(ids))
                if at == len(ids):
                    ids.append(-1)
                    scores.append(0.0)
            ids[at], scores[at] = i, score
        order = sorted(nodes)
        self.keys, self.to = np.array(order, np.int64), np.array([nodes[k] for k in order], np.int64)
        self.ids, self.scores, self.unknown = np.array(ids, np.int64), np.array(scores), unknown

    def edges(self, chunks: list[str], n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Start, length, score and id (-1: a character without a piece) of every piece that lies in a chunk; starts count characters of all chunks."""
        chars = self.number[np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4")]
        end = np.repeat(np.cumsum(n), n)
        at, node, out = np.arange(len(chars)), np.zeros(len(chars), np.int64), []
        for depth in range(int(n.max(initial=0))):
            inside = at + depth < end[at]
            at, node = at[inside], node[inside]
            key = node * self.width + chars[at + depth]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[place] == key
            before, at, node = at, at[hit], self.to[place[hit]]
            whole = self.ids[node] >= 0
            out.append((at[whole], np.full(int(whole.sum()), depth + 1), self.scores[node[whole]], self.ids[node[whole]]))
            if not depth:  # characters that are no piece
                lone = np.ones(len(chars), bool)
                lone[at[whole]] = False
                lone = before[lone[before]]
                out.append((lone, np.ones(len(lone), np.int64), np.full(len(lone), self.unknown), np.full(len(lone), -1)))
            if not len(at):
                break
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def solve(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best score, loss of the second best (infinite if there is none), pieces of the best, their ids one chunk after another."""
        n = np.fromiter(map(len, chunks), np.int64, len(chunks))
        first = np.cumsum(n) - n
        start, length, score, ids = self.edges(chunks, n)
        owner = np.repeat(np.arange(len(n)), n)[start]
        place = start - first[owner]
        start = start + owner  # now states: one more than characters for each chunk
        end = start + length
        states = int(n.sum()) + len(n)
        ahead = np.zeros(states)
        back = np.zeros(states, np.int64)
        order = np.lexsort((start, end, place + length))
        for group in _groups(order, (place + length)[order]):
            value = ahead[start[group]] + score[group]
            cut = _firsts(end[group])
            top = np.maximum.reduceat(value, cut)
            ahead[end[group[cut]]] = top
            best = np.where(value == np.repeat(top, np.diff(np.append(cut, len(group)))), np.arange(len(group)), len(group))
            back[end[group[cut]]] = group[np.minimum.reduceat(best, cut)]  # the earliest start on ties
        behind = np.zeros(states)
        order = np.lexsort((start, -place))
        for group in _groups(order, place[order]):
            cut = _firsts(start[group])
            behind[start[group[cut]]] = np.maximum.reduceat(score[group] + behind[end[group]], cut)
        home, at = first + np.arange(len(n)), first + np.arange(len(n)) + n
        best = ahead[at]
        taken = np.zeros(len(start), bool)
        open_ = np.flatnonzero(at > home)
        while len(open_):
            edge = back[at[open_]]
            taken[edge] = True
            at[open_] = start[edge]
            open_ = open_[at[open_] > home[open_]]
        # another segmentation has an edge that the best one hasn't; the best through it is the best ahead and behind
        second = np.full(len(n), -np.inf)
        rest = ~taken
        np.maximum.at(second, owner[rest], (ahead[start] + score + behind[end])[rest])
        path = np.flatnonzero(taken)
        path = path[np.argsort(start[path])]
        return best, np.maximum(best - second, 0), np.bincount(owner[path], minlength=len(n)), ids[path]


def _firsts(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))


def _groups(order: np.ndarray, values: np.ndarray) -> list[np.ndarray]:
    return np.split(order, _firsts(values)[1:]) if len(order) else []


class Segmenter:
    """Best segmentations of the chunks that a worker has met, kept under a number each."""

    def __init__(self, path: str, n_best: int = N_BEST):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n_best = n_best
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.table: list[bytes] = []
        self.bytes: dict[int, int] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.table.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.table.append(b"")
            else:
                piece = piece.replace("▁", " ")
                self.scores[piece], self.ids[piece] = model.get_score(i), i
                self.table.append(piece.encode())
        self.trie: dict = {}
        for piece, score in self.scores.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = score
        self.cut = _WORDS if not any(_MIXED.search(p) for p in self.scores) else _CHUNK
        self.unknown = min((s for s in self.scores.values() if s > -1e8), default=0.0) - UNKNOWN
        self.lattices = Lattices({p: (s, self.ids[p]) for p, s in self.scores.items()}, self.unknown)
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.best, self.count, self.loss = np.zeros(0), np.zeros(0, np.int64), np.zeros(0)
        self.coded: list[bytes] = []
        self.held = 0
        self.found: dict[str, list[tuple[float, bytes]]] = {}

    def search(self, chunk: str, n_best: int) -> list[tuple[float, tuple[int, ...]]]:
        """The best segmentations of one chunk: (score, borders from the left)."""
        n, trie, unknown = len(chunk), self.trie, self.unknown
        best = [0.0] + [-1e300] * n
        into: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            here, node, j = best[i], trie, i
            while j < n:
                node = node.get(chunk[j])
                j += 1
                if node is None:
                    break
                s = node.get("")
                if s is not None:
                    into[j].append((i, s))
                    if here + s > best[j]:
                        best[j] = here + s
            first = trie.get(chunk[i])
            if first is None or "" not in first:  # no piece is this character
                into[i + 1].append((i, unknown))
                best[i + 1] = max(best[i + 1], here + unknown)
        found: list[tuple[float, tuple[int, ...]]] = []
        queue: list[tuple] = [(0.0, 0, n, None)]
        made, least = 0, []  # the losses of the n_best best hypotheses known
        while queue and len(found) < n_best:
            # what is left of ``at`` follows the Viterbi path at no loss; every other edge waits in the queue
            loss, _, at, right = heappop(queue)  # right: (border, what is right of it)
            right = (at, right)
            while at:
                top_, on = best[at], -1
                for i, s in into[at]:
                    if on < 0 and best[i] + s == top_:
                        on = i
                        continue
                    more = loss + max(0.0, top_ - s - best[i])
                    if len(least) < n_best:
                        insort(least, more)
                    elif more < least[-1]:
                        least.pop()
                        insort(least, more)
                    else:
                        continue
                    made += 1
                    heappush(queue, (more, made, i, right))
                at = on
                right = (at, right)
            borders = []
            while right:
                borders.append(right[0])
                right = right[1]
            found.append((best[n] - loss, tuple(borders)))
        return found

    def encode_chunk(self, chunk: str, borders: tuple[int, ...]) -> list[int]:
        out: list[int] = []
        for a, b in zip(borders, borders[1:], strict=False):
            i = self.ids.get(chunk[a:b])
            out += [i] if i is not None else [self.bytes[x] for x in chunk[a:b].encode()]
        return out

    def learn(self, chunks: list[str]) -> None:
        """Keep the best segmentations of new chunks; long ones are searched one by one, so that time stays linear in their length."""
        short = [c for c in chunks if len(c) <= SHORT]
        best, loss, count, ids = self.lattices.solve(short) if short else (np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
        raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(count)).tolist()
        coded = [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        for k in np.unique(np.searchsorted(np.cumsum(count), np.flatnonzero(ids < 0), "right")).tolist():  # with characters that have no piece
            coded[k] = self.alternatives(short[k])[0][1]
            count[k] = len(coded[k]) // 4
        long = [c for c in chunks if len(c) > SHORT]
        for c in long:
            found = self.alternatives(c)
            coded.append(found[0][1])
            best, count = np.append(best, found[0][0]), np.append(count, len(found[0][1]) // 4)
            loss = np.append(loss, found[0][0] - found[1][0] if len(found) > 1 else np.inf)
        self.numbers.update(zip([*short, *long], range(len(self.coded), len(self.coded) + len(chunks)), strict=True))
        self.coded += coded
        self.held += sum(map(len, coded)) + sum(map(len, chunks))
        self.best, self.count, self.loss = (np.concatenate(x) for x in ((self.best, best), (self.count, count), (self.loss, loss)))

    def alternatives(self, chunk: str) -> list[tuple[float, bytes]]:
        """Scores and ids of the N best segmentations of a chunk, kept once searched."""
        found = self.found.get(chunk)
        if found is None:
            found = [(s, np.array(self.encode_chunk(chunk, b), "<u4").tobytes()) for s, b in self.search(chunk, self.n_best)]
            self.found[chunk] = found
            self.held += sum(len(x) for _, x in found) + len(chunk)
        return found

    def segments(self, texts: list[str | None]) -> list[tuple[list[bytes], int, list[float]]]:
        """For each text the ids of its N best segmentations (little-endian, 32 bits), the number of the best one's, the N scores."""
        if len(self.numbers) > REMEMBERED or self.held > HELD:
            self.forget()
        lists = [self.cut.findall(" " + t) if t else [] for t in texts]
        known = self.numbers
        new = [c for c in set().union(*lists) if c not in known]
        if new:
            self.learn(sorted(new))
        return [self._whole(chunks) if chunks else ([b""], 0, [0.0]) for chunks in lists]

    def _whole(self, chunks: list[str]) -> tuple[list[bytes], int, list[float]]:
        """The N best of a text: only the N - 1 places whose second best loses least can take part."""
        numbers = itemgetter(*chunks)(self.numbers) if len(chunks) > 1 else (self.numbers[chunks[0]],)
        at = np.array(numbers)
        score, loss = float(self.best[at].sum()), self.loss[at]
        k = min(self.n_best - 1, len(at))
        open_ = (np.argpartition(loss, k - 1)[:k] if 0 < k < len(at) else np.arange(len(at))).tolist()
        options = [self.alternatives(chunks[i]) for i in open_ if loss[i] < np.inf]
        open_ = [i for i in open_ if loss[i] < np.inf]
        some: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
        for found in options:
            top = found[0][0]
            some = sorted([(x + top - s, (*c, rank)) for x, c in some for rank, (s, _) in enumerate(found)])[: self.n_best]
        parts = list(itemgetter(*numbers)(self.coded)) if len(numbers) > 1 else [self.coded[numbers[0]]]
        ids = [b"".join(parts)]
        for _, c in some[1:]:
            for i, rank, found in zip(open_, c, options, strict=True):
                parts[i] = found[rank][1]
            ids.append(b"".join(parts))
        return ids, int(self.count[at].sum()), [score - x for x, _ in some]

    def segment(self, text: str | None) -> tuple[bytes, int, list[float]]:
        """Ids of the best segmentation, their number, the N best scores."""
        ((ids, n, scores),) = self.segments([text])
        return ids[0], n, scores

    def n_best_ids(self, text: str) -> list[tuple[float, list[int]]]:
        """The N best segmentations of a whole text, with their ids."""
        chunks = self.cut.findall(" " + text) if text else []
        done: list[tuple[float, list[int]]] = [(0.0, [])]
        for chunk in chunks:
            found = [(s, self.encode_chunk(chunk, b)) for s, b in self.search(chunk, self.n_best)]
            done = sorted(((a + s, x + y) for a, x in done for s, y in found), key=lambda r: -r[0])[: self.n_best]
        return done

    def decode(self, ids: bytes) -> str:
        table = self.table
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")[1:]


_segmenters: dict[tuple[str, int], Segmenter] = {}


def segmenter(path: str, n_best: int = N_BEST) -> Segmenter:
    """One segmenter for each vocabulary and Python worker."""
    if (path, n_best) not in _segmenters:
        _segmenters[path, n_best] = Segmenter(path, n_best)
    return _segmenters[path, n_best]


def encode(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, n_best: int = N_BEST) -> DataFrame:
    """doc_id, ids (binary), n_pieces, scores (the N best), decodes (the ids give the text back), alternatives (the ids of the 2nd to Nth)."""
    ship(spark)
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = segmenter(path, n_best)
        for whole in batches:
            for cut in range(0, whole.num_rows, 1024):
                batch = whole.slice(cut, 1024)
                texts = batch.column(1).to_pylist()
                found = coder.segments(texts)
                back = [coder.decode(ids[0]) == (t or "") for t, (ids, _, _) in zip(texts, found, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([x[0] for x, _, _ in found], pa.binary()), pa.array([n for _, n, _ in found], pa.int64()), pa.array([s for _, _, s in found], pa.list_(pa.float64())), pa.array(back), pa.array([x[1:] for x, _, _ in found], pa.list_(pa.binary()))],
                    ["doc_id", "ids", "n_pieces", "scores", "decodes", "alternatives"],
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), text).mapInArrow(run, f"doc_id {kind}, ids binary, n_pieces long, scores array<double>, decodes boolean, alternatives array<binary>")


def decode(spark: SparkSession, coded: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """``coded`` with the ids' text in ``decoded``; null ids give a null text."""
    ship(spark)
    path = path or vocabulary_path()
    from pyspark.sql.types import StringType, StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = segmenter(path)
        for batch in batches:
            texts = [None if x is None else coder.decode(x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return coded.mapInArrow(run, StructType([*coded.schema.fields]).add("decoded", StringType()))


def report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, best score, scores of the N best, decodes, and ids_crc32_k of each further rank (null where there is none)."""
    done = encode(spark, docs)
    others = [F.crc32(F.get("alternatives", F.lit(k))).alias(f"ids_crc32_{k + 2}") for k in range(N_BEST - 1)]
    return done.select("doc_id", "n_pieces", F.crc32("ids").alias("ids_crc32"), F.get("scores", F.lit(0)).alias("score"), "scores", "decodes", *others)


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())
