"""N-best segmentation with a SentencePiece vocabulary: forward Viterbi, then backward A-star.

A text becomes one space in front of it, spaces as U+2581. The lattice over it has an edge for each vocabulary
piece that stands in it, with the piece's score; a character that no piece equals has its UTF-8 bytes as one edge.
A forward Viterbi pass gives each position the best score from the start. A backward search from the end then
extends partial hypotheses by the sum of their score and that forward score, which is exact, so complete
hypotheses come out in falling order of score: the N best segmentations.

No piece joins certain neighbours (a letter and a punctuation mark, or anything and a following space), so a text's
lattice falls apart at such places. Parts are solved once each and remembered; the text's N best follow from the
parts' N best. Only the parts whose second best is nearest to their best can differ among the text's N best, so the
forward pass keeps two scores a position and the A-star search runs for those parts alone. The forward passes of a run of texts' new
parts go position by position through all of them at once, over arrays of their edges. The cut is checked against the whole
vocabulary when it is loaded.

The hypotheses that wait in the search have no complete segmentation in common, and each one's score is that of its best one, so only
the N best that wait can matter: ties, as in a long ruler of dashes, neither multiply them nor fill memory.
"""

from __future__ import annotations

import bisect
import gc
import heapq
import os
from pathlib import Path
import re
from array import array
from collections.abc import Iterator, MutableSequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import map_texts

DEFAULT_MODEL = os.environ.get("RANKMILL_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
SPACE = "▁"
#: Segmentations kept of each text.
N_BEST = 4
#: Score of a character spelled in bytes: below every piece's.
BYTES_SCORE = -100_000.0
#: Parts a Python worker remembers; beyond it, those before the present run of texts go.
REMEMBER = 120_000
#: A part that is longer is solved but not remembered.
LONG = 64
#: Characters of the parts whose forward passes run at once, about; each has as many edges as pieces end there.
SOLVED_AT_ONCE = 1 << 16
#: Characters of a part from which its forward pass is held in arrays.
ARRAYS = 4096


class Numbers(dict):
    """Parts and their numbers; a part that is not there gets the next one."""

    def __init__(self) -> None:
        super().__init__()
        self.parts: list[str] = []

    def __missing__(self, part: str) -> int:
        number = self[part] = len(self.parts)
        self.parts.append(part)
        return number


class Pieces:
    """A vocabulary: pieces with ids and scores, and the ids of single bytes."""

    def __init__(self, model_bytes: bytes):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes)
        self.ids: dict[str, tuple[int, float]] = {}
        self.bytes = [0] * 256
        self.text: list[bytes] = [b""] * model.get_piece_size()
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                shown = piece.replace(SPACE, " ")
                self.ids[shown] = (i, model.get_score(i))
                self.text[i] = shown.encode()
        # Trie: character -> (node below, id of the piece that ends here or -1, its score).
        self.trie: dict = {}
        for p in sorted(self.ids, key=len):
            node = self.trie
            for c in p[:-1]:
                node = node.setdefault(c, ({}, -1, 0.0))[0]
            node[p[-1]] = (node.get(p[-1], ({},))[0], *self.ids[p])
        self.longest = max(map(len, self.ids), default=1)
        self._tabulate()
        # A part: spaces, then letters or then other characters; or spaces at the end. Numerals that are no digits
        # (superscripts, fractions) count as other characters, as they do in the pieces.
        odd = "".join(sorted({c for p in self.ids for c in p if re.match(r"[^\W\d_]", c) and not c.isalpha()}))
        self.part = re.compile(rf" *[^\W\d_{odd}]+| *(?:[^\w ]|[\d_{odd}])+| +")
        self.whole = not all(m is not None and m.end() == len(p) for p in self.ids for m in [self.part.match(p)])
        self._clear()
        self.lists: dict[tuple[str, int], list[tuple[float, bytes]]] = {}

    def _tabulate(self) -> None:
        """The trie as arrays: sorted keys (node * letters + letter) and for each the node below, the piece that ends there or -1, and its score."""
        letters = sorted({c for p in self.ids for c in p})
        number = {c: k for k, c in enumerate(letters)}
        self.letter = np.full(max(map(ord, letters), default=0) + 2, -1, np.int64)  # the last: any other character
        single = [c in self.ids for c in letters]
        self.letter[[ord(c) for c, s in zip(letters, single, strict=True) if s]] = [number[c] for c, s in zip(letters, single, strict=True) if s]
        keys, below, piece, gain = [], [], [], []
        waiting, made = [(0, self.trie)], 1
        while waiting:
            node, entries = waiting.pop()
            for c, (children, k, score) in entries.items():
                keys.append(node * len(letters) + number[c])
                below.append(made if children else -1)
                piece.append(k)
                gain.append(score)
                if children:
                    waiting.append((made, children))
                    made += 1
        kind = np.int32 if made * len(letters) < np.iinfo(np.int32).max else np.int64
        order = np.argsort(np.array(keys, kind))
        self.keys = np.append(np.array(keys, kind)[order], np.iinfo(kind).max)
        self.letter = self.letter.astype(kind)
        self.below, self.piece = np.array(below, kind)[order], np.array(piece, np.int32)[order]
        self.gain, self.letters = np.array(gain, np.float64)[order], len(letters)

    def solve(self, parts: list[str]) -> list[tuple[float, float, bytes]]:
        """best() of each part, none empty: the forward passes of all parts at once, by the same sums in the same order.

        Parts with a character that no piece equals, and longer ones than LONG, have a pass of their own.
        """
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = self.letter[np.minimum(points, len(self.letter) - 1)]
        begin = np.cumsum(size) - size
        plain = size <= LONG
        plain[np.repeat(np.arange(len(parts)), size)[letter < 0]] = False
        out: list[tuple[float, float, bytes]] = [(0.0, 0.0, b"")] * len(parts)
        for k in np.flatnonzero(~plain).tolist():
            out[k] = self.best(parts[k])
        which = np.flatnonzero(plain)
        if not len(which):
            return out
        # Positions of the plain parts, and where they end; then all edges, by the length of the piece.
        begin, size = begin[which], size[which]
        at = np.repeat(begin, size) + (own := np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
        end = np.repeat(begin + size, size)
        node, depth = np.zeros(len(at), self.keys.dtype), 0
        edges: list[tuple[np.ndarray, ...]] = []
        while len(at):
            key = node * self.keys.dtype.type(self.letters) + letter[at + depth]
            entry = np.searchsorted(self.keys, key)
            found = self.keys[entry] == key
            at, own, end, entry = at[found], own[found], end[found], entry[found]
            depth += 1
            ends = self.piece[entry] >= 0
            edges.append((own[ends], at[ends], np.full(int(ends.sum()), depth), entry[ends]))
            node = self.below[entry]
            more = (node >= 0) & (at + depth < end)
            at, own, end, node = at[more], own[more], end[more], node[more]
        offset, start, length, entry = (np.concatenate(x) for x in zip(*edges, strict=True))
        order = np.argsort(offset.astype(np.int16), kind="stable")
        cuts = np.searchsorted(offset[order], np.arange(int(size.max()) + 1))
        # A part's k-th position is number k after its begin, in arrays with one place more for each part.
        shift = np.zeros(len(points) + 1, np.int64)
        shift[begin] = np.diff(which, prepend=0)
        shift = np.cumsum(shift)  # parts before
        first = np.full(len(points) + len(parts), -np.inf)
        second = first.copy()
        start_of, piece_of = np.zeros(len(first), np.int64), np.zeros(len(first), np.int32)
        begin = begin + which
        first[begin] = 0.0
        start, entry, length = (start + shift[start])[order], entry[order], length[order]
        for low, high in zip(cuts, cuts[1:], strict=False):  # the edges from one place in all parts: no two end at one position
            i, e = start[low:high], entry[low:high]
            j, gain = i + length[low:high], self.gain[e]
            score, other, was = first[i] + gain, second[i] + gain, first[j]
            better = score > was
            second[j] = np.where(better, np.maximum(was, other), np.maximum(second[j], score))
            i, j, e = i[better], j[better], e[better]
            first[j], start_of[j], piece_of[j] = score[better], i, self.piece[e]
        last = begin + size
        scores, gaps = first[last], first[last] - second[last]
        # Back from the ends, a piece of each part at a time.
        part, where, taken = np.arange(len(which)), last, []
        while len(part):
            taken.append((part, piece_of[where]))
            where = start_of[where]
            more = where > begin[part]
            part, where = part[more], where[more]
        part, ids = (np.concatenate(x) for x in zip(*reversed(taken), strict=True))
        ids = ids[np.argsort(part, kind="stable")].tobytes()
        stops = (4 * np.cumsum(np.bincount(part, minlength=len(which)))).tolist()
        found = list(zip(scores.tolist(), gaps.tolist(), [ids[low:high] for low, high in zip([0, *stops], stops, strict=False)], strict=True))
        if len(found) == len(parts):
            return found
        for k, one in zip(which.tolist(), found, strict=True):
            out[k] = one
        return out

    def _clear(self) -> None:
        """Forgets the parts: their numbers, and by number best score, gap to the second best, and where in ids the best one's stand."""
        self.known = Numbers()
        self.scores, self.gaps, self.ids_of, self.stops = np.zeros(0), np.zeros(0), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def numbered(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of each text's parts. New parts are solved, those of all texts together."""
        if len(self.known.parts) >= REMEMBER or len(self.ids_of) >= 16 * REMEMBER:
            self._clear()
        number = self.known.__getitem__
        out = [np.fromiter(map(number, parts), np.int64, len(parts)) for parts in map(self.parts, texts)]
        new = self.known.parts[len(self.scores) :]
        if not new:
            return out
        cuts = np.cumsum(np.fromiter(map(len, new), np.int64, len(new))) // SOLVED_AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(cuts)) + 1).tolist(), len(new)]
        solved = [one for low, high in zip(cuts, cuts[1:], strict=False) for one in self.solve(new[low:high])]
        scores, gaps, ids = zip(*solved, strict=True)
        self.stops = np.concatenate((self.stops, self.stops[-1] + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)))
        self.ids_of = np.concatenate((self.ids_of, np.frombuffer(b"".join(ids), np.int32)))
        self.scores, self.gaps = np.concatenate((self.scores, scores)), np.concatenate((self.gaps, gaps))
        for part in new:
            if len(part) > LONG:  # stays by its number only, until the numbers go
                del self.known[part]
        return out

    def edges(self, part: str, at: int) -> list[tuple[int, float, int | str]]:
        """(start, score, piece id or character spelled in bytes) of what can end at a position."""
        ids = self.ids
        out: list[tuple[int, float, int | str]] = []
        for start in range(max(0, at - self.longest), at):
            found = ids.get(part[start:at])
            if found is not None:
                out.append((start, found[1], found[0]))
        if part[at - 1] not in ids:
            out.append((at - 1, BYTES_SCORE, part[at - 1]))
        return out

    def n_best(self, part: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """Up to n segmentations of a part, best first, ties by longer last pieces: (score, ids)."""
        size = len(part)
        best = self.forward(part)[0]
        # Hypotheses that wait, at most n, best last: (forward + own, -position, order, own score, (piece, rest)).
        agenda: list = [(best[size], -size, 0, 0.0, None)]
        made = 0
        out: list[tuple[float, tuple[int, ...]]] = []
        while agenda:
            total, at, _, own, tail = agenda.pop()
            if at == 0:
                spelled: list[int] = []
                while tail is not None:
                    piece, tail = tail
                    if isinstance(piece, str):
                        spelled += [self.bytes[b] for b in piece.encode("utf-8", "surrogateescape")]
                    else:
                        spelled.append(piece)
                out.append((total, tuple(spelled)))
                continue
            for start, score, piece in self.edges(part, -at):
                made += 1
                bisect.insort(agenda, (best[start] + score + own, -start, made, own + score, (piece, tail)))
            del agenda[: max(0, len(agenda) - (n - len(out)))]
        return out

    def parts(self, text: str) -> list[str]:
        """The text, a space in front, cut where no piece can join."""
        return [" " + text] if self.whole else self.part.findall(" " + text)

    def forward(self, part: str) -> tuple[MutableSequence[float], MutableSequence[float], MutableSequence[int], MutableSequence[int]]:
        """For each position the best and second-best score from the start, and where the best one's last piece starts and its id (-1: bytes)."""
        size = len(part)
        trie, singles, longest, bottom = self.trie, self.ids, self.longest, -np.inf
        first: MutableSequence[float] = [bottom] * (size + 1)
        second: MutableSequence[float] = [bottom] * (size + 1)
        start_of: MutableSequence[int] = [0] * (size + 1)
        piece_of: MutableSequence[int] = [0] * (size + 1)
        if size > ARRAYS:  # numbers, not objects
            first, second, start_of, piece_of = array("d", first), array("d", second), array("q", start_of), array("i", piece_of)
        first[0] = 0.0
        for i in range(size):
            one, two = first[i], second[i]
            node, end = trie, i
            for c in part[i : i + longest]:
                entry = node.get(c)
                if entry is None:
                    break  # no piece begins like this
                node, piece, gain = entry
                end += 1
                if piece >= 0:
                    score = one + gain
                    if score > first[end]:
                        other = two + gain
                        second[end] = first[end] if first[end] > other else other
                        first[end] = score
                        start_of[end] = i
                        piece_of[end] = piece
                    elif score > second[end]:
                        second[end] = score
            if part[i] not in singles:
                end, score = i + 1, one + BYTES_SCORE
                if score > first[end]:
                    second[end] = max(first[end], two + BYTES_SCORE)
                    first[end] = score
                    start_of[end] = i
                    piece_of[end] = -1
        return first, second, start_of, piece_of

    def best(self, part: str) -> tuple[float, float, bytes]:
        """(best score, gap to the second best, ids of the best as int32): the forward pass alone."""
        first, second, start_of, piece_of = self.forward(part)
        ids: list[int] = []
        at = size = len(part)
        while at:
            start, piece = start_of[at], piece_of[at]
            if piece >= 0:
                ids.append(piece)
            else:
                ids += [self.bytes[b] for b in reversed(part[start].encode("utf-8", "surrogateescape"))]
            at = start
        ids.reverse()
        return first[size], first[size] - second[size], array("i", ids).tobytes()

    def ranked(self, part: str, n: int) -> list[tuple[float, bytes]]:
        """n_best with the forward pass's own best in front of others that score as much."""
        if (found := self.lists.get((part, n))) is None:
            score, _, ids = self.best(part)
            rest = [(s, x) for s, x in ((s, array("i", x).tobytes()) for s, x in self.n_best(part, n)) if x != ids]
            found = [(score, ids), *rest[: n - 1]]
            if len(part) <= LONG:
                if len(self.lists) >= REMEMBER // 16:
                    self.lists.clear()
                self.lists[part, n] = found
        return found

    def encode(self, text: str, n: int = N_BEST) -> tuple[np.ndarray, list[float], list[list[tuple[int, np.ndarray]]]]:
        """(ids of the best, scores of the n best, for each of these its parts that differ from the best: (part, ids)).

        The empty text has one segmentation, that of the leading space. U+2581 in a text is spelled in bytes.
        Among the text's n best, at most n - 1 parts differ from their best: those whose second best is nearest.
        """
        return next(self.encode_run([text], n))

    def encode_run(self, texts: list[str], n: int = N_BEST) -> Iterator[tuple[np.ndarray, list[float], list[list[tuple[int, np.ndarray]]]]]:
        """encode() of each of a run of texts; the forward passes of their new parts go together."""
        for numbers in self.numbered(texts):
            total, gap = sum(self.scores[numbers].tolist()), self.gaps[numbers]
            low = self.stops[numbers]
            size = self.stops[numbers + 1] - low
            ids = self.ids_of[np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())]
            near = np.argsort(gap, kind="stable")[: n - 1] if len(gap) <= 64 or n < 2 else _smallest(gap, n - 1)
            mixed: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
            lists = {k: self.ranked(self.known.parts[numbers[k]], n) for k in sorted(near.tolist()) if gap[k] < np.inf}
            for k, options in lists.items():
                grown = [(loss + options[0][0] - score, (*edits, (k, rank)) if rank else edits) for loss, edits in mixed for rank, (score, _) in enumerate(options)]
                mixed = heapq.nsmallest(n, grown)
            differ = [[(k, np.frombuffer(lists[k][rank][1], np.int32)) for k, rank in edits] for _, edits in mixed]
            yield ids, [total - loss for loss, _ in mixed], differ

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: bytes joined, the leading space taken off."""
        return b"".join(map(self.text.__getitem__, ids.tolist()))[1:].decode("utf-8", "surrogateescape")


def _smallest(gaps: np.ndarray, n: int) -> np.ndarray:
    """Positions of the n smallest, ties by position."""
    edge = np.partition(gaps, n - 1)[n - 1]
    below, equal = np.flatnonzero(gaps < edge), np.flatnonzero(gaps == edge)
    return np.concatenate((below, equal[: n - len(below)]))


_loaded: dict[str, Pieces] = {}


def pieces(path: str = DEFAULT_MODEL, model_bytes: bytes | None = None) -> Pieces:
    """The vocabulary in this Python process, with what it has solved; encode_column drops it after each task."""
    if path not in _loaded:
        _loaded[path] = Pieces(Path(path).read_bytes() if model_bytes is None else model_bytes)
    return _loaded[path]


def forget() -> None:
    """Drops the vocabularies of this Python process."""
    _loaded.clear()


def encode_column(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, n: int = N_BEST, path: str = DEFAULT_MODEL) -> DataFrame:
    """Adds n_pieces, piece_ids, nbest_scores, nbest_edits and round_trip to the columns in carry.

    nbest_edits holds, for each of the n best, the parts (numbered from 0) in which it differs from the best and
    their piece ids there. round_trip: decoding piece_ids gives the whole text back, byte by byte. Null texts count as empty. Equal
    texts get equal values; an empty table gives an empty one. The vocabulary's file is read by the driver and sent to the executors.
    """
    carry = docs.columns if carry is None else carry
    shared = docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())  # one vocabulary file

    def run(texts: list[bytes | None]) -> dict:
        vocabulary = pieces(path, shared.value)
        gc.disable()  # nothing here is cyclic; collection passes over the remembered parts took a third of the time
        out: dict[str, list] = {k: [] for k in ("n_pieces", "piece_ids", "nbest_scores", "nbest_edits", "round_trip")}
        try:
            whole = [(raw or b"").decode("utf-8", "surrogateescape") for raw in texts]
            for text, (ids, scores, edits) in zip(whole, vocabulary.encode_run(whole, n), strict=True):
                out["n_pieces"].append(len(ids))
                out["piece_ids"].append(ids)
                out["nbest_scores"].append(scores)
                out["nbest_edits"].append([[{"part": k, "ids": x} for k, x in e] for e in edits])
                out["round_trip"].append(vocabulary.decode(ids) == text)
        finally:
            gc.enable()
        return out

    made = "n_pieces long, piece_ids array<int>, nbest_scores array<double>, nbest_edits array<array<struct<part: int, ids: array<int>>>>, round_trip boolean"
    return map_texts(docs, text_col, carry, run, made, at_end=lambda: (forget(), common.forget(shared)))


def sentencepiece_nbest(docs: DataFrame) -> DataFrame:
    """doc_id and the columns of encode_column for each row of documents; see there for null, empty and equal texts.

    Null and repeated ids are carried as they are; other columns take no part.
    """
    return encode_column(docs.select("doc_id", "text"), carry=["doc_id"])


def decode_column(encoded: DataFrame, ids_col: str = "piece_ids", path: str = DEFAULT_MODEL) -> DataFrame:
    """Adds `decoded`: the text of an array of piece ids; null for null. Bytes that are no UTF-8 are shown as U+FFFD."""
    shared = encoded.sparkSession.sparkContext.broadcast(Path(path).read_bytes())  # one vocabulary file

    @F.pandas_udf("string")
    def text_of(ids: pd.Series) -> pd.Series:
        vocabulary = pieces(path, shared.value)
        shown = lambda x: vocabulary.decode(np.asarray(x, np.int32)).encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return ids.map(lambda x: None if x is None else shown(x))

    return encoded.withColumn("decoded", text_of(ids_col))
