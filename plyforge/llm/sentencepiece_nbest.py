"""N-best segmentation and decoding over a SentencePiece vocabulary.

A text's pieces form a lattice. Forward Viterbi gives the best score from the
start to every place; a backward A* search from the end uses these scores as its
heuristic. They are exact, so each path comes out of the heap in the order of its
score and nothing but parts of the N best paths is opened (Nagata, 1994).

No piece reaches from a letter into the next blank, nor from letters into characters
that the vocabulary keeps apart from them, such as full stops: the lattice of a text is
a chain of units (blanks with the run of either kind after them). Units are searched once and
kept; the N best of the whole text follow exactly from the units': only the N - 1
units whose second-best path costs least can differ from their best path.

Texts are taken in groups: their units are cut, told apart and put together again in
arrays, so that only a group's distinct units are looked up one by one.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship

BLANK = "▁"
_NONE, _NEVER = float("inf"), float("-inf")
#: How much below the worst piece a character scores that only bytes can spell.
UNKNOWN = 10.0

#: Units of more characters are searched each time: what is kept is bounded in bytes.
LONGEST = 64
#: Texts are taken together up to about so many characters; longer ones by themselves.
GROUP = 1 << 20
#: So many units are searched at once.
ABREAST = 1 << 13

Path = tuple[float, tuple[int, ...]]


class Vocabulary:
    """Pieces, scores and byte pieces of a .model file, with the searches."""

    def __init__(self, pieces: list[tuple[str, float]], byte_ids: dict[int, int], skip: set[int], most: int = 450_000):
        # blanks are kept as such inside: most texts then need one byte a character
        pieces = [(p.replace(BLANK, " "), s) for p, s in pieces]
        self.raw = [p.encode("utf-8", "surrogatepass") for p, _ in pieces]
        for value, i in byte_ids.items():
            self.raw[i] = bytes([value])
        for i in skip:
            self.raw[i] = b""
        self.byte_ids = byte_ids
        # a trie: each node has its children and, where a piece ends, (ids, score)
        self.root: dict = {}
        own = set(byte_ids.values()) | skip
        for i, (piece, score) in enumerate(pieces):
            if i not in own and piece:
                node: list = [self.root, None]
                for c in piece:
                    node = node[0].setdefault(c, [{}, None])
                node[1] = ((i,), float(score))
        self.worst = min((float(s) for i, (_, s) in enumerate(pieces) if i not in own), default=0.0) - UNKNOWN
        self.cost_of = np.array([s for _, s in pieces], dtype=float)
        for value, i in byte_ids.items():  # a character's bytes: the first one bears its score
            self.cost_of[i] = 0.0 if 0x80 <= value < 0xC0 else self.worst
        if any(" " in p.lstrip(" ") for i, (p, _) in enumerate(pieces) if i not in own):
            raise ValueError("a piece has a blank after a letter: texts can't be cut into units")
        #: Of each character: 0 for the blank, 2 for those kept apart, 1 for all others.
        self.kinds = np.ones(0x110000, np.uint8)
        self.kinds[[ord(c) for c in self._apart([p for i, (p, _) in enumerate(pieces) if i not in own])]] = 2
        self.kinds[ord(" ")] = 0
        self.most = most
        #: The rows of units that are kept. Row r of the table: the ids of the unit's best
        #: path, flat[stops[r]:stops[r + 1]], and what its second-best path costs.
        self.pairs: dict[str, int] = {}
        self.flat, self.stops, self.costs = np.empty(0, np.uint32), np.zeros(1, np.int64), np.empty(0)
        self._lay_out()

    def _lay_out(self) -> None:
        """The trie in arrays. A node has a number, 0 is the root; the piece that ends
        there, or -1, stands in ``ending``. Of each character ``letter`` has a number, 0
        if no piece holds it. A hash table has the key of each step, node * letters +
        letter, and the node that it leads to."""
        nodes, steps, ending = [self.root], [], [-1]
        for at, children in enumerate(nodes):
            for c, (below, found) in children.items():
                steps.append((at, ord(c)))
                ending.append(found[0][0] if found else -1)
                nodes.append(below)
        at, codes = np.array(steps, np.int64).reshape(-1, 2).T
        self.ending = np.array(ending, np.int32)
        self.letter = np.zeros(0x110000, np.int32)
        used = np.unique(codes)
        self.letter[used] = np.arange(1, len(used) + 1)
        self.letters = len(used) + 1
        keys = at * self.letters + self.letter[codes]
        bits = (4 * len(keys) + 1).bit_length()
        self.shift, taken = 64 - bits, np.full(1 << bits, -1, np.int64)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[taken[slot[left]] < 0]
            taken[slot[free]] = free
            left = left[taken[slot[left]] != left]
            slot[left] = (slot[left] + 1) % len(taken)
        self.step_key = np.full(len(taken), -1, np.int64)
        self.step_key[slot] = keys
        self.step_to = np.zeros(len(taken), np.int32)
        self.step_to[slot] = np.arange(1, len(keys) + 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(self.shift)).astype(np.int64)

    def _child(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The nodes that the letters lead to; 0 for none."""
        keys = node.astype(np.int64) * self.letters + letter
        slot = self._slot(keys)
        there = self.step_key[slot]
        out = np.where(there == keys, self.step_to[slot], 0)
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) % len(self.step_key)
            there = self.step_key[slot[left]]
            met = left[there == keys[left]]
            out[met] = self.step_to[slot[met]]
            left = left[(there != keys[left]) & (there >= 0)]
        return out

    @staticmethod
    def _apart(pieces: list[str]) -> set[str]:
        """The characters that no piece holds beside another one but their like."""
        pairs = {(a, b) for p in pieces for a, b in zip(p, p[1:], strict=False) if " " not in (a, b)}
        used = {c for p in pieces for c in p}
        apart = {c for c in used if c != " " and not c.isalpha()} | (set(map(chr, range(128))) - used - {" "})
        while drop := {x for pair in pairs for x in pair if x in apart and not apart.issuperset(pair)}:
            apart -= drop
        return apart

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        byte_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        skip = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        return cls([(sp.id_to_piece(i), sp.get_score(i)) for i in range(n)], byte_ids, skip)

    def _score(self, ids) -> float:
        """The sum of the pieces' scores; the bytes of one character count once."""
        return float(sum(self.cost_of[ids].tolist()))

    def _spelt(self, c: str) -> tuple[int, ...] | None:
        """The byte pieces of a character that no piece spells."""
        raw = c.encode("utf-8", "surrogatepass")
        return tuple(self.byte_ids[b] for b in raw) if all(b in self.byte_ids for b in raw) else None

    def lattice(self, unit: str) -> tuple[list[list[tuple]], list[float]]:
        """For each place the (start, ids, score) of what may end there, and the best
        score from the start to it (forward Viterbi)."""
        n = len(unit)
        ends: list = [[] for _ in range(n + 1)]
        best = [0.0] + [_NEVER] * n
        for i in range(n):
            here, children, single = best[i], self.root, False
            for j in range(i, n):
                node = children.get(unit[j])
                if node is None:
                    break
                children, found = node
                if found is not None:
                    ids, score = found
                    ends[j + 1].append((i, ids, score))
                    if here + score > best[j + 1]:
                        best[j + 1] = here + score
                    if j == i:
                        single = True
            if not single and (ids := self._spelt(unit[i])):
                ends[i + 1].append((i, ids, self.worst))
                best[i + 1] = max(best[i + 1], here + self.worst)
        return ends, best

    def nbest(self, unit: str, n: int) -> list[Path]:
        """The n best (score, ids) of one unit, best first; fewer if there are no
        more. Equal scores come in the order in which the search meets them."""
        ends, best = self.lattice(unit)
        if best[-1] == _NEVER:
            return []
        out: list[Path] = []
        count = 0
        # (-(score so far + best way to here), place, order, score so far, ids from here as a linked list);
        # of equal scores the one nearest to the start goes on, so ties don't fan out
        heap: list = [(-best[-1], len(unit), 0, 0.0, None)]
        push, pop = heapq.heappush, heapq.heappop
        while heap:
            _, place, _, gone, tail = pop(heap)
            if place == 0:
                ids: list[int] = []
                while tail is not None:
                    ids += tail[0]
                    tail = tail[1]
                out.append((gone, tuple(ids)))
                if len(out) == n:
                    break
                continue
            for i, piece, score in ends[place]:
                count += 1
                score += gone
                push(heap, (-(score + best[i]), i, count, score, (piece, tail)))
        return out

    def _pair(self, unit: str) -> tuple[list[tuple], float]:
        """The ids of a unit's best path, piece by piece, and what its second-best path
        costs: Viterbi with the two best scores of each place."""
        n, root = len(unit), self.root
        best, second, back = [0.0] + [_NEVER] * n, [_NEVER] * (n + 1), [None] * (n + 1)
        for i in range(n):
            here, below, children, single = best[i], second[i], root, False
            for j in range(i, n):
                node = children.get(unit[j])
                if node is None:
                    break
                children, found = node
                if found is not None:
                    ids, score = found
                    k, x = j + 1, here + score
                    if x > best[k]:
                        second[k] = max(best[k], below + score)
                        best[k], back[k] = x, (i, ids)
                    elif x > second[k]:
                        second[k] = x
                    if j == i:
                        single = True
            if not single and (ids := self._spelt(unit[i])):
                k, x = i + 1, here + self.worst
                if x > best[k]:
                    second[k] = max(best[k], below + self.worst)
                    best[k], back[k] = x, (i, ids)
                elif x > second[k]:
                    second[k] = x
        if best[n] == _NEVER:
            return [], _NONE
        parts, k = [], n
        while k:
            k, ids = back[k]
            parts.append(ids)
        parts.reverse()
        return parts, best[n] - second[n]

    def _pairs(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What ``_pair`` finds, for many units at once: the ids of all best paths, how
        many there are for each unit, and the costs. One step of the search is taken in
        all units, from the places as far from the beginning."""
        sizes = np.fromiter(map(len, units), np.int64, len(units)) + 1
        last = np.cumsum(sizes) - 1
        codes = np.frombuffer("\0".join([*units, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
        letters = self.letter[codes]
        letters[last] = 0
        owner = np.repeat(np.arange(len(units)), sizes)
        off = np.arange(len(codes)) - np.repeat(last + 1 - sizes, sizes)
        inside = np.ones(len(codes), bool)
        inside[last] = False
        # edges of the lattices: (from, to, id), or -1 - code for a character in bytes
        start = to = np.flatnonzero(inside)
        node = np.zeros(len(start), np.int32)
        edges = []
        while len(start):
            node = self._child(node, letters[to])
            live = node > 0
            start, to, node = start[live], to[live] + 1, node[live]
            ids = self.ending[node]
            hit = ids >= 0
            edges.append((start[hit], to[hit], ids[hit]))
            if len(edges) == 1:
                inside[start[hit]] = False
        alone = np.flatnonzero(inside)
        spelt = {c: self._spelt(chr(c)) for c in np.unique(codes[alone]).tolist()}
        alone = alone[np.isin(codes[alone], [c for c, ids in spelt.items() if ids])]
        edges.append((alone, alone + 1, -1 - codes[alone].astype(np.int32)))
        start, to, ids = map(np.concatenate, zip(*edges, strict=True))
        order = np.argsort(off[start].astype(np.uint8 if len(off) and off.max() < 256 else np.int64), kind="stable")
        start, to, ids = start[order], to[order], ids[order]
        scores = np.where(ids < 0, self.worst, self.cost_of[np.maximum(ids, 0)])
        best, second, back = np.full(len(codes), _NEVER), np.full(len(codes), _NEVER), np.zeros(len(codes), np.int64)
        best[off == 0] = 0.0
        for a, b in pairwise([0, *np.cumsum(np.bincount(off[start])).tolist()]):
            f, t, score = start[a:b], to[a:b], scores[a:b]
            x, old = best[f] + score, best[t]
            better = x > old
            second[t] = np.where(better, np.maximum(old, second[f] + score), np.maximum(second[t], x))
            best[t] = np.where(better, x, old)
            back[t[better]] = np.flatnonzero(better) + a
        reached = best[last] > _NEVER
        costs = np.full(len(units), _NONE)
        costs[reached] = best[last[reached]] - second[last[reached]]
        on = np.zeros(len(codes), bool)
        at = last[reached]
        while len(at):
            on[at] = True
            at = start[back[at]]
            at = at[off[at] > 0]
        places = np.flatnonzero(on)
        path = ids[back[places]]
        odd = np.flatnonzero(path < 0)
        widths = np.ones(len(path), np.int64)
        own = [spelt[-1 - i] for i in path[odd].tolist()]
        widths[odd] = [len(i) for i in own]
        out = np.repeat(path, widths).astype(np.uint32)
        for begin, i in zip((np.cumsum(widths) - widths)[odd].tolist(), own, strict=True):
            out[begin : begin + len(i)] = i
        return out, np.bincount(owner[places], widths, len(units)).astype(np.int64), costs

    def units(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct units of the texts, the place there of each unit in turn, and
        where each text's units begin, with the end of the last. Blanks are written as
        such, one stands before each text; '' has no unit."""
        marked = [" " + t.replace(BLANK, " ") if t else "" for t in texts]
        joined = "".join(marked)
        raw = joined.encode("utf-32-le", "surrogatepass")
        begins = np.cumsum([0, *map(len, marked)])
        kind = self.kinds[np.frombuffer(raw, "<u4")]
        # a unit begins where a run of a kind ends, but not after its blanks
        first = np.ones(len(kind) + 1, bool)
        first[1:-1] = (kind[1:] != kind[:-1]) & (kind[:-1] != 0)
        first[begins] = True
        at = np.flatnonzero(first)
        cells = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at * 4), pa.py_buffer(raw)])
        which = cells.dictionary_encode().indices.to_numpy()
        # units are numbered as they first occur
        new = np.flatnonzero(np.diff(np.maximum.accumulate(which), prepend=-1) > 0)
        distinct = [joined[a:b] for a, b in zip(at[new].tolist(), at[new + 1].tolist(), strict=True)]
        return distinct, which, np.searchsorted(at, begins)

    def _rows(self, distinct: list[str]) -> np.ndarray:
        """The rows of units in the table. Those that aren't kept stay there until the
        next call only."""
        pairs = self.pairs
        if len(pairs) >= self.most:
            pairs.clear()
        rows = np.array([pairs.get(u, -1) for u in distinct], np.int64)
        new = np.flatnonzero(rows < 0).tolist()
        if new:
            known = len(pairs)
            new.sort(key=lambda i: len(distinct[i]) > LONGEST)
            rows[new] = np.arange(known, known + len(new))
            short = [distinct[i] for i in new if len(distinct[i]) <= LONGEST]
            found = [self._pairs(short[i : i + ABREAST]) for i in range(0, len(short), ABREAST)]
            for i in new[len(short) :]:
                parts, cost = self._pair(distinct[i])
                ids = np.array([*chain.from_iterable(parts)], np.uint32)
                found.append((ids, [len(ids)], [cost]))
            flat, sizes, costs = map(np.concatenate, zip(*found, strict=True))
            self.flat = np.concatenate([self.flat[: self.stops[known]], flat])
            self.stops = np.concatenate([self.stops[: known + 1], self.stops[known] + np.cumsum(sizes)])
            self.costs = np.concatenate([self.costs[:known], costs])
            pairs.update(zip(short[: self.most - known], range(known, self.most)))
        return rows

    def encode(self, text: str | None, n: int = 1) -> list[Path]:
        """The n best segmentations of a whole text, best first. Null and empty
        texts have the one empty segmentation."""
        return next(self.encode_all([text], n))

    def encode_all(self, texts: Iterable[str | None], n: int = 1) -> Iterator[list[Path]]:
        """``encode`` for each text."""
        for total, best, others in self.ranked(texts, n):
            head = best.tolist()
            out: list[Path] = [(total, tuple(head))]
            for cost, changed in others:
                ids: list[int] = []
                at = 0
                for start, stop, own in changed:
                    ids.extend(head[at:start])
                    ids.extend(own)
                    at = stop
                ids.extend(head[at:])
                out.append((total - cost, tuple(ids)))
            yield out

    def ranked(self, texts: Iterable[str | None], n: int) -> Iterator[tuple[float, np.ndarray, list[tuple]]]:
        """For each text (score, ids) of the best segmentation, and for each of the next
        n - 1 what it costs and, in order, the (start, stop, ids) by which it differs from
        the best."""
        group: list[str] = []
        size = 0
        for text in texts:
            group.append(text or "")
            size += len(group[-1])
            if size >= GROUP:
                yield from self._ranked(group, n)
                group, size = [], 0
        yield from self._ranked(group, n)

    def _ranked(self, texts: list[str], n: int) -> Iterator[tuple[float, np.ndarray, list[tuple]]]:
        distinct, which, begins = self.units(texts)
        rows = self._rows(distinct)[which]
        lengths = self.stops[rows + 1] - self.stops[rows]
        stops = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.flat[np.arange(stops[-1]) + np.repeat(self.stops[rows] - stops[:-1], lengths)]
        costs = self.costs[rows]
        for a, b in pairwise(begins.tolist()):
            head = ids[stops[a] : stops[b]]
            others = self._others(head, stops[a : b + 1] - stops[a], costs[a:b], lambda i, a=a: distinct[which[a + i]], n) if n > 1 and a < b else []
            yield self._score(head), head, others

    def _others(self, head: np.ndarray, stops: np.ndarray, costs: np.ndarray, unit, n: int) -> list[tuple]:
        """The next n - 1 segmentations of a text whose i-th unit has the ids
        head[stops[i]:stops[i + 1]] and the text unit(i)."""
        near = np.flatnonzero(costs <= np.partition(costs, n - 2)[n - 2]) if len(costs) >= n else np.arange(len(costs))
        # choices: (cost, places and ranks of what isn't the best path of its unit)
        choices: list[tuple[float, tuple]] = [(0.0, ())]
        alternatives: dict[int, list[Path]] = {}
        for place in near[np.argsort(costs[near], kind="stable")[: n - 1]].tolist():
            if costs[place] == _NONE:
                break
            # the best path of a unit stays the one that stands in the head
            own = head[stops[place] : stops[place + 1]]
            best = tuple(own.tolist())
            paths = [(self._score(own), best), *(p for p in self.nbest(unit(place), n) if p[1] != best)][:n]
            alternatives[place] = paths
            more = [
                (c + paths[0][0] - p[0], (*done, (place, rank)) if rank else done)
                for c, done in choices
                for rank, p in enumerate(paths)
            ]
            choices = heapq.nsmallest(n, more)
        spans = lambda changed: [(int(stops[i]), int(stops[i + 1]), alternatives[i][rank][1]) for i, rank in sorted(changed)]
        return [(cost, spans(changed)) for cost, changed in choices[1:]]

    def spell(self, ids) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))

    def decode(self, ids) -> str:
        """The text of ids; bytes that aren't UTF-8 become the replacement mark."""
        return self.read(self.spell(ids))

    @staticmethod
    def read(spelt: bytes) -> str:
        text = spelt.decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if text.startswith(" ") else text


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One per Python worker: units stay known from task to task."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary.load(path)
    return _LOADED[path]


def segment(docs: DataFrame, model: str, n: int = 4) -> DataFrame:
    """(doc_id, text, best): the n best segmentations of each row's whole text as
    array<struct<score, ids>>. One row per row, repeats included; null texts count as
    empty; an empty table gives no rows."""
    ship(docs.sparkSession)

    def run(batches):
        for pdf in batches:
            vocab = vocabulary(model)
            best = [[{"score": s, "ids": list(ids)} for s, ids in paths] for paths in vocab.encode_all(pdf["text"], n)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "text": pdf["text"], "best": best})

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInPandas(run, "doc_id long, text string, best array<struct<score:double,ids:array<int>>>")


def digest(docs: DataFrame, model: str, n: int = 4) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, score, n_best, best_crc32, last_score,
    round_trip) of each row's whole text: the best segmentation's length, the CRC of
    its ids as little-endian 32-bit numbers and its score; how many segmentations
    there are (n at most), the CRC of all their ids and the score of the last; and
    whether each of them decodes to the text with blank marks read as blanks. Null
    texts count as empty: no piece, score 0, one segmentation. Rows are taken one by
    one, whole, however long: repeated rows and null ids give rows of their own, an
    empty table gives none. Of segmentations with equal scores the search's order
    decides, the same for equal texts."""
    ship(docs.sparkSession)

    def one(vocab: Vocabulary, text: str | None, total: float, head: np.ndarray, others: list[tuple]) -> tuple:
        raw = memoryview(head.astype("<u4").tobytes())
        own = crc = zlib.crc32(raw)
        same = vocab.read(vocab.spell(head.tolist())) == (text or "").replace(BLANK, " ")
        for _, changed in others:
            # all else is the best one's: it has been read already
            at = 0
            for start, stop, ids in changed:
                crc = zlib.crc32(array("I", ids).tobytes(), zlib.crc32(raw[4 * at : 4 * start], crc))
                same = same and vocab.spell(ids) == vocab.spell(head[start:stop].tolist())
                at = stop
            crc = zlib.crc32(raw[4 * at :], crc)
        return len(head), own, total, 1 + len(others), crc, total - others[-1][0] if others else total, same

    names = ["n_pieces", "ids_crc32", "score", "n_best", "best_crc32", "last_score", "round_trip"]

    def run(batches):
        for pdf in batches:
            vocab = vocabulary(model)
            texts = pdf["text"]
            out = pd.DataFrame([one(vocab, t, *found) for t, found in zip(texts, vocab.ranked(texts, n), strict=True)], columns=names)
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64"))
            yield out

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInPandas(
        run,
        "doc_id long, n_pieces long, ids_crc32 long, score double, n_best int, best_crc32 long, last_score double, round_trip boolean",
    )


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_path())


QUERIES = {"op9_sentencepiece_nbest": op9_sentencepiece_nbest}
#: SQL has no lattice search: tested against brute force and by round trips.
ORACLE_SQL: dict[str, str] = {}
