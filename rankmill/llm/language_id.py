"""Language identification by prediction by partial matching (PPM) with frozen statistics.

One context tree per language holds, for every byte context of up to ORDER bytes, how often each next byte followed it in that
language's training texts. A text's code length under a language is the sum over its bytes of -log2 P(byte | longest context in
the tree): a byte seen in the context costs count / (total + distinct); an unseen one pays the escape distinct / (total +
distinct) and is coded in the next shorter context without the bytes already ruled out. Below the empty context all 256 bytes are
equally likely. Statistics are frozen after training, so each (context, byte) pair has one fixed cost.

The trees are compiled together. A node is a context that any language has; a cell is a (node, byte) that any language has seen,
found by a bit mask of the node's bytes and the rank of the byte in it. A byte that no language saw at a node costs each language
its escape there, and is looked up at the node's suffix. Cells hold one cost a language, so memory follows the sample, not the
number of languages times all pairs; there is no limit on languages.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, id_remainder, map_texts, pack, unpack

#: Longest context in bytes.
ORDER = 3
#: The fit's documented bounds: texts per language and over all languages (one each at least), and characters of a text that are learnt.
SAMPLE_TEXTS, SAMPLE_TOTAL, SAMPLE_CHARS = 400, 12_800, 1 << 14
#: Candidates by hash for each text that the sample takes.
SPARE = 4
#: A byte that UTF-8 never uses; it stands before each text in place of a context.
BOUNDARY = 255
#: A text is treated as at most this many independent bytes when code lengths become a score.
EVIDENCE_BYTES = 48
#: Raw bytes take 8 bits; a text that no learned language codes in fewer is in none of them.
RAW_BITS = 8.0

LETTER = regex.compile(r"\p{L}")


@dataclass
class PpmModel:
    """Compiled trees. symbols: of a byte; nodes: the deepest node of ORDER symbols; mask, base: the bytes of a node's cells."""

    languages: list[str]
    symbols: np.ndarray
    width: int
    nodes: np.ndarray
    suffix: np.ndarray
    mask: np.ndarray
    base: np.ndarray
    costs: np.ndarray
    escapes: np.ndarray

    def cells(self, node: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """The cell that codes each symbol, and (places, nodes) where it escaped on the way there."""
        words = self.mask.shape[1]
        mask, base = self.mask.ravel(), self.base.ravel()
        word, bit = symbol >> 6, (symbol & 63).astype(np.uint64)

        def look(n: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = n * words + w
            own = mask[at] >> b
            # Bits from b upwards, less those above: the rank counts the set bits below b.
            below = np.bitwise_count(mask[at] & ((np.uint64(1) << b) - np.uint64(1)))
            return (own & np.uint64(1)).astype(bool), base[at] + below

        seen, cell = look(node, word, bit)
        escaped = []
        left = np.flatnonzero(~seen)
        at = node[left]
        while len(left):
            escaped.append((left, at))
            at = self.suffix[at]
            seen, found = look(at, word[left], bit[left])
            cell[left[seen]] = found[seen]
            left, at = left[~seen], at[~seen]
        return cell, escaped

    def code_lengths(self, texts: Sequence[bytes]) -> np.ndarray:
        """Bits that each text takes under each language: array (texts, languages)."""
        out = np.zeros((len(texts), len(self.languages)))
        if not len(texts) or not self.languages:
            return out
        gap = bytes([BOUNDARY]) * ORDER
        data = np.frombuffer(gap + gap.join(texts), dtype=np.uint8)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        ends = np.cumsum(lengths + ORDER)
        starts = ends - lengths
        piece = 1 << 18  # positions at a time
        for low in range(ORDER, len(data), piece):
            high = min(low + piece, len(data))
            symbol = self.symbols[data[low - ORDER : high]]
            context = np.zeros(high - low, dtype=np.int64)
            for k in range(ORDER):
                context = context * self.width + symbol[k : k + high - low]
            cell, escaped = self.cells(self.nodes[context].astype(np.int64), symbol[ORDER:])
            first, last = np.searchsorted(ends, low, "right"), np.searchsorted(starts, high, "left")
            row = np.arange(first, last)
            a, b = np.maximum(starts[row], low) - low, np.minimum(ends[row], high) - low
            row, a, b = row[b > a], a[b > a], b[b > a]
            if not len(row):
                continue
            cuts = np.empty(2 * len(row), dtype=np.int64)
            cuts[::2], cuts[1::2] = a, b
            cuts = cuts[:-1] if cuts[-1] == high - low else cuts
            for k in range(len(self.languages)):
                cost = self.costs[k][cell].astype(np.float64)
                for places, nodes in escaped:
                    cost[places] += self.escapes[k][nodes]
                out[row, k] += np.add.reduceat(cost, cuts)[::2]
        return out


def _grams(symbols: np.ndarray, order: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes of order symbols and the next, how often) over the positions whose symbol is not the boundary."""
    at = np.flatnonzero(symbols[ORDER:] != 0) + ORDER
    code = np.zeros(len(at), dtype=np.int64)
    for k in range(order, -1, -1):
        code = code * width + symbols[at - k]
    return np.unique(code, return_counts=True)


def train(sample: list[tuple[str, bytes]]) -> PpmModel:
    """Counts the sample's contexts and compiles the trees. Deterministic; an empty sample has no language."""
    languages = sorted({lang for lang, _ in sample})
    texts: dict[str, list[bytes]] = {lang: [] for lang in languages}
    for lang, text in sample:
        texts[lang].append(text)
    gap = bytes([BOUNDARY]) * ORDER
    data = {lang: np.frombuffer(gap + gap.join(sorted(texts[lang])), dtype=np.uint8) for lang in languages}
    used = sorted({int(b) for d in data.values() for b in np.unique(d)} - {BOUNDARY})
    width = len(used) + 2  # symbol 0: the boundary, 1: every byte that no sampled text has
    symbols = np.ones(256, dtype=np.int64)
    symbols[used], symbols[BOUNDARY] = np.arange(2, width), 0
    share = np.full(width, 1.0)  # bytes that a symbol stands for; the boundary is never coded
    share[0], share[1] = 0, 256 - len(used)
    counted = {lang: [_grams(symbols[d], order, width) for order in range(ORDER + 1)] for lang, d in data.items()}
    # Nodes by order: every context that a language has. Order 0 is the empty context, node 0, with a cell for every symbol.
    levels = [np.zeros(1, np.int64)]
    for order in range(1, ORDER + 1):
        levels.append(np.unique(np.concatenate([np.zeros(0, np.int64), *[counted[x][order][0] // width for x in languages]])))
    offset = np.cumsum([0] + [len(level) for level in levels])
    suffix = np.zeros(offset[-1], dtype=np.int64)
    words = -(-width // 64)
    mask = np.zeros((offset[-1], words), dtype=np.uint64)
    cell_node, cell_symbol = [np.zeros(width, np.int64)], [np.arange(width)]
    for order in range(1, ORDER + 1):
        if order > 1:
            suffix[offset[order] : offset[order + 1]] = offset[order - 1] + np.searchsorted(levels[order - 1], levels[order] % width ** (order - 1))
        code = np.unique(np.concatenate([np.zeros(0, np.int64), *[counted[x][order][0] for x in languages]]))
        cell_node.append(offset[order] + np.searchsorted(levels[order], code // width))
        cell_symbol.append(code % width)
    node, symbol = np.concatenate(cell_node), np.concatenate(cell_symbol)
    np.bitwise_or.at(mask, (node, symbol >> 6), np.uint64(1) << (symbol & 63).astype(np.uint64))
    sizes = np.bitwise_count(mask).astype(np.int64).ravel()
    base = (np.cumsum(sizes) - sizes).reshape(mask.shape).astype(np.int32)
    costs, escapes = np.zeros((len(languages), len(node)), np.float32), np.zeros((len(languages), offset[-1]), np.float32)
    model = PpmModel(languages, symbols, width, np.zeros(0, np.int32), suffix, mask, base, costs, escapes)
    of_order = np.searchsorted(offset, node, "right") - 1
    for k, lang in enumerate(languages):
        p = np.zeros(len(node))  # probability of each cell's symbol, by language
        factor = np.ones(offset[-1])  # what a symbol without a cell keeps of its probability in the suffix
        for order in range(ORDER + 1):
            cells = np.flatnonzero(of_order == order)
            own = node[cells] - offset[order]
            code, count = counted[lang][order]
            n = np.zeros(len(cells))
            at = np.searchsorted(levels[order], code // width) if order else np.zeros(len(code), np.int64)
            n[model.cells(offset[order] + at, code % width)[0] - cells[0]] = count if len(cells) else 0
            total, distinct = np.bincount(own, n, len(levels[order])), np.bincount(own, n > 0, len(levels[order]))
            if order:
                up, lost = model.cells(suffix[node[cells]], symbol[cells])
                below = p[up]
                for places, nodes in lost:
                    below[places] *= factor[nodes]
            else:
                below = share / 256
            # What the escape is shared by: the probability below of all that the language has not seen here.
            left = 1 - np.bincount(own, np.where(n > 0, below, 0), len(levels[order]))
            left = np.where(left > 1e-12, left, 0)
            escape = np.divide(distinct, total + distinct, out=np.ones_like(left), where=total > 0)
            spread = np.divide(escape, left, out=np.zeros_like(left), where=left > 0)
            factor[offset[order] : offset[order + 1]] = spread
            # Where a context has seen every symbol nothing can escape from it.
            whole = np.where(left > 0, total + distinct, total)
            direct = np.divide(n, whole[own], out=np.zeros(len(n)), where=n > 0)
            p[cells] = np.where(n > 0, direct, below * spread[own])
        per_byte = np.divide(p, share[symbol], out=np.ones_like(p), where=share[symbol] > 0)
        costs[k] = -np.log2(np.maximum(per_byte, 1e-300))
        escapes[k] = -np.log2(np.maximum(factor, 1e-300))
    model.nodes = np.zeros(width**ORDER, dtype=np.int32)
    every = np.arange(width**ORDER, dtype=np.int64)
    for order in range(1, ORDER + 1):
        if len(levels[order]):
            code = every % width**order
            at = np.minimum(np.searchsorted(levels[order], code), len(levels[order]) - 1)
            hit = levels[order][at] == code
            model.nodes[hit] = (offset[order] + at[hit]).astype(np.int32)
    return model


def training_sample(docs: DataFrame, usable: Column, id_col: str, text_col: str, lang_col: str, texts: int = SAMPLE_TEXTS) -> list[tuple[str, bytes]]:
    """At most texts texts of each language, fewer if there are more than SAMPLE_TOTAL / texts languages, chosen by a hash of their ids.

    A language's ids are counted first; only rows whose hash is below what leaves SPARE times the texts are ranked, so no task
    ranks a whole language. Of a chosen text its first SAMPLE_CHARS characters are learnt, so long texts count and no language is
    left out. Of rows with one id the smallest text counts. Rows without id or language, and texts without a letter, take no part.
    """
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    rows = rows.select(F.col(lang_col).cast("string").alias("__lang"), F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    counts = rows.groupBy("__lang").agg(F.approx_count_distinct("__id").alias("n")).collect()  # one row a language, as the model has
    if not counts:
        return []
    most = max(1, min(texts, SAMPLE_TOTAL // len(counts)))
    shares = [(r["__lang"], min(1.0, SPARE * most / max(1, r["n"]))) for r in counts]
    share = docs.sparkSession.createDataFrame(shares, "__lang string, __share double")
    drawn = F.pmod(F.xxhash64(F.col("__id")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    few = rows.join(F.broadcast(share), "__lang").where(drawn <= F.col("__share"))  # share: one row a language
    few = few.groupBy("__lang", "__id").agg(F.min(F.substring("__text", 1, SAMPLE_CHARS)).alias("__text"))
    order = Window.partitionBy("__lang").orderBy(F.xxhash64("__id"), "__id")  # some SPARE * most rows a language
    found = few.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= most).select("__lang", "__text").collect()
    return sorted((r["__lang"], r["__text"].encode("utf-8", "surrogatepass")) for r in found)


def identify(docs: DataFrame, model: PpmModel, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds lang_pred (string), score (double, 0 to 1) and bits_per_byte (double) to the columns in carry.

    Whole texts are scored. Null texts and texts without a letter (Unicode category L) are `und`, with score 0 and null
    bits. Repeated rows get equal results, ties go to the language first in order. With no learned language everything is `und`.
    """
    carry = docs.columns if carry is None else carry
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def score(raw: list[bytes | None]) -> dict:
        m = shared.value
        lettered = np.array([x is not None and has_letter(x) for x in raw], dtype=bool)
        texts = [x or b"" for x in raw]
        bits = m.code_lengths(texts)
        size = np.maximum(np.array([len(t) for t in texts]), 1)
        if bits.shape[1]:
            best = bits.argmin(1)
            each = bits / size[:, None]
            least = each[np.arange(len(best)), best]
            weight = np.minimum(size, EVIDENCE_BYTES)[:, None]
            sure = 1 / np.exp2(-(each - least[:, None]) * weight).sum(1)
            names = np.array(m.languages, dtype=object)[best]
        else:
            lettered[:] = False
            least, sure, names = np.zeros(len(size)), np.zeros(len(size)), np.full(len(size), "und", dtype=object)
        return {
            "lang_pred": np.where(lettered, names, "und"), "score": np.where(lettered, sure, 0.0),
            "bits_per_byte": [float(x) if ok else None for x, ok in zip(least, lettered, strict=True)],
        }

    return map_texts(docs, text_col, carry, score, "lang_pred string, score double, bits_per_byte double", at_end=lambda: forget(shared))


def has_letter(text: bytes) -> bool:
    """A character of Unicode category L stands in the text; bytes that are no UTF-8 are none."""
    return LETTER.search(text.decode("utf-8", "replace")) is not None


def fit(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> PpmModel:
    """The model of a training sample. An empty table, or one without a usable row, gives a model without languages."""
    return train(training_sample(docs, usable, id_col, text_col, lang_col))


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte for each row of documents.

    Rows with a null doc_id are scored like others (crc32 of the empty text) and not learnt from. See identify() for null, empty
    and equal texts. Other columns take no part.
    """
    remainder = id_remainder(F.col("doc_id"), 3)
    model = fit(docs, remainder != 1)
    base = docs.select("doc_id", (remainder == 1).alias("held_out"), "text")
    return identify(base, model, carry=["doc_id", "held_out"])


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of documents in a learned language: not `und`, and coded in fewer than RAW_BITS bits a byte.

    Columns of any name and type pass through as they are; repeated rows stay or go together; an empty table gives an empty one.
    """
    model = fit(docs, id_remainder(F.col("doc_id"), 3) != 1)
    packed, carry = pack(docs, {"__source_text": F.col("text")})
    scored = identify(packed, model, "__source_text", carry)
    return unpack(scored.where((F.col("lang_pred") != "und") & (F.col("bits_per_byte") < RAW_BITS)), docs)
