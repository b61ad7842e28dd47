"""Toxicity by votes of the nearest labelled examples under exact TF-IDF cosine.

Terms are whole words, and those word beginnings of PREFIXES characters that tell the labels apart, so inflected and compounded
forms meet their stem. Each text of a bounded sample of labelled texts is an example with a unit TF-IDF vector over all words of
the sample, with document frequencies of the corpus. The words and beginnings most associated with label 1 (chi-square, chosen one
by one, TERMS at most) weigh TELLING times as much; no word of an example is left out. Examples are indexed by term in blocks of BLOCK consecutive examples:
postings of the rarer terms, and for common ones dense rows with the largest weight in the block. A query visits blocks by
falling upper bound (its rare terms' best sum in the block, and the sum of query weight times block maximum over its common
terms); those whose bound is below the K-th best cosine found by then are left out, so the K nearest are exact. Votes weigh cosine
times how many labelled rows an example stands for; the vote share is mapped to a probability by pool-adjacent-violators over leave-one-out shares of the sample.
"""

from __future__ import annotations

import functools
import hashlib
import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_dir, forget, id_remainder, map_texts, pack, small_batches, text_runs, trim, unpack

#: The fit's documented bounds: labelled rows of each label and bytes of such a text.
SAMPLE = {1: 1500, 0: 2500}
SAMPLE_TEXT_BYTES = 1 << 16
TERMS, PREFIXES, MIN_ROWS, BLOCK, K = 160, range(3, 9), 6, 64, 25
#: A sample with fewer toxic rows than MIN_ROWS * ROWS_SHARE asks for a term in one of so many of them, one row at least.
ROWS_SHARE = 10
#: Smallest share of label 1 among the labelled rows with a term, as the sample shows it.
MIN_SHARE = 0.75
#: Distinct texts whose result a Python worker remembers.
REMEMBER = 20_000
#: At most one in so many of the sample's toxic rows votes.
VOTERS_SHARE = 8
#: Factor of the telling terms' weights; all other terms weigh by TF-IDF alone.
TELLING = 4.0
#: A term of more than one in so many examples is kept in dense blocks.
COMMON = 4
#: Blocks that are visited before the k-th best is a floor for the others.
FIRST = 8

WORD = re.compile(r"[^\W\d_]+")
#: What WORD does not match, as spaces: by ASCII byte, and by code point.
ASCII_LETTERS = bytes(c if c < 128 and WORD.match(chr(c)) else 32 for c in range(256))


@functools.cache
def letters() -> np.ndarray:
    """The code points themselves, and a space for each that is no letter of WORD."""
    points = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    shown = np.full(len(points), 32, np.uint32)
    for run in WORD.finditer(points.tobytes().decode("utf-32-le", "surrogatepass")):  # no Python object for each code point
        shown[slice(*run.span())] = points[slice(*run.span())]
    return shown


def words_of(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, for each word of the lower-case texts in order its place among these, and its text).

    A run of texts is cut at once, and each distinct word becomes a Python object once.
    """
    parts = []
    for text in texts:
        text = text.lower()
        if text.isascii():
            parts.append(text.encode().translate(ASCII_LETTERS))
        else:
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            parts.append(letters()[codes].tobytes().decode("utf-32-le").encode())
    ends = np.cumsum([len(p) + 1 for p in parts])
    joined = np.frombuffer(b" ".join([b"", *parts, b""]), np.uint8)  # a byte 32 in UTF-8 is a space
    del parts
    inside = joined != 32
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts = edge[::2]
    offsets = np.concatenate(([0], np.cumsum(edge[1::2] - starts)))
    if not len(starts):
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    bare = joined[inside]
    del joined, inside
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(bare)).dictionary_encode()
    text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, ends), prepend=0))
    return words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy().astype(np.int64), text


def terms_of(word: str) -> list[str]:
    """What may be chosen as telling for a word: the word, and its beginnings (marked)."""
    return [word, *[word[:k] + "*" for k in PREFIXES if k <= len(word)]]


@dataclass
class ToxicityModel:
    """Vocabulary of all the examples' terms, block-max index of the examples, and the calibration of vote shares.

    terms: the telling ones, and their places in the vocabulary. Terms of over 1 in COMMON examples stand in dense blocks
    with the largest weight of each block; the others in postings, term by term.
    """

    terms: dict[str, int]
    vocabulary: dict[str, int]
    idf: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    ids: list[str]
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    where: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    common: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    dense: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    block_max: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    blank: float = 0.0
    voters: int = K
    steps: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(0), np.zeros(0)))
    beginnings: dict[str, list[tuple[str, int]]] = field(default_factory=dict)
    shortest: int = 0

    def __post_init__(self) -> None:
        heads = [(term[:-1], place) for term, place in self.vocabulary.items() if term.endswith("*")]
        self.shortest = min((len(h) for h, _ in heads), default=0)
        for head, place in heads:  # by how they begin themselves
            self.beginnings.setdefault(head[: self.shortest], []).append((head, place))

    def terms_in(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place, times): the vocabulary's terms in each of a run of whole texts, by text and place, and how often each stands there."""
        distinct, words, text = words_of(texts)
        place = np.fromiter(map(self.vocabulary.get, distinct, repeat(-1)), np.int64, len(distinct))
        size = max(1, len(self.vocabulary))
        own = place[words]
        keys = (text * size + own)[own >= 0]
        near, short = self.beginnings, self.shortest
        if near:
            begun = [(k, at) for k, w in enumerate(distinct) if w[:short] in near for head, at in near[w[:short]] if w.startswith(head)]
            if begun:  # a word may have several beginnings, and several words one
                which, at = np.array(begun, dtype=np.int64).T
                n = np.bincount(which, minlength=len(distinct))
                low = np.cumsum(n) - n
                hit = np.flatnonzero(n[words])
                each = n[words[hit]]
                nth = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                keys = np.concatenate((keys, np.repeat(text[hit] * size, each) + at[np.repeat(low[words[hit]], each) + nth]))
        keys.sort()
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
        times = np.diff(first, append=len(keys))
        return *np.divmod(keys[first], size), times.astype(np.float64)

    def vectors(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """arrays() of each of a run of texts."""
        text, keys, times = self.terms_in(texts)
        raw = (1 + np.log(times)) * self.idf[keys]
        cuts = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
        out = []
        for low, high in zip(cuts, cuts[1:], strict=False):
            own = raw[low:high]
            out.append((keys[low:high], own / np.sqrt((own * own).sum()) if len(own) else own))
        return out

    def arrays(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Unit TF-IDF vector of a whole text over the vocabulary: places and weights; empty where it has no term."""
        return self.vectors([text])[0]

    def vector(self, text: str) -> dict[int, float]:
        """arrays() as a dictionary."""
        keys, raw = self.arrays(text)
        return dict(zip(keys.tolist(), raw.tolist(), strict=True))

    def index(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Sets postings, dense blocks and their maxima."""
        n, size = len(vectors), len(self.vocabulary)
        keys = np.concatenate([np.zeros(0, np.int64), *[k for k, _ in vectors]])
        value = np.concatenate([np.zeros(0), *[v for _, v in vectors]])
        where = np.repeat(np.arange(n, dtype=np.int32), [len(k) for k, _ in vectors])
        often = np.bincount(keys, minlength=size) > max(BLOCK // 4, n / COMMON)
        self.common = np.where(often, np.cumsum(often) - 1, -1)
        blocks = -(-n // BLOCK)
        full = often[keys]
        self.dense = np.zeros((int(often.sum()), blocks * BLOCK))
        self.dense[self.common[keys[full]], where[full]] = value[full]
        self.block_max = self.dense.reshape(-1, blocks, BLOCK).max(2) if self.dense.size else np.zeros((int(often.sum()), blocks))
        keys, value, where = keys[~full], value[~full], where[~full]
        order = np.argsort(keys, kind="stable")
        self.where, self.value = where[order], value[order]
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(keys, minlength=size))))

    def nearest(self, vector: dict[int, float] | tuple[np.ndarray, np.ndarray], k: int = K, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest with a cosine above 0, nearest first, ties by example; exact.

        The FIRST blocks by upper bound are visited at once; their k-th best is a floor, and of the others only those whose bound
        reaches it are.
        """
        if isinstance(vector, dict):
            vector = np.fromiter(vector, np.int64), np.fromiter(vector.values(), float)
        keys, q = vector
        if not len(keys) or not len(self.labels):
            return np.zeros(0, int), np.zeros(0)
        low, n = self.starts[keys], self.starts[keys + 1] - self.starts[keys]
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        blocks = self.block_max.shape[1]
        score = np.bincount(self.where[at], self.value[at] * np.repeat(q, n), blocks * BLOCK).astype(float, copy=False).reshape(blocks, BLOCK)
        row = self.common[keys]
        used, wide = row[row >= 0], q[row >= 0]
        if not len(used):  # no common term: the sums are whole
            return self._best(score, np.arange(blocks), 0.0, k, skip)
        bound = score.max(1) + wide @ self.block_max[used]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        dense = self.dense.reshape(-1, blocks, BLOCK)
        first = order[:FIRST]
        score[first] += np.tensordot(wide, dense[used[:, None], first], 1)
        found, cosine = self._best(score, first, 0.0, k, skip)
        floor = cosine[k - 1] - 1e-9 if len(cosine) >= k else 0.0
        rest = order[FIRST:][bound[order[FIRST:]] >= floor]
        if not len(rest):
            return found, cosine
        if len(rest) > blocks // 4:  # cheaper without picking them out
            whole = np.zeros(len(self.dense))
            whole[used] = wide
            score[rest] += (whole @ self.dense).reshape(blocks, BLOCK)[rest]
        else:
            score[rest] += np.tensordot(wide, dense[used[:, None], rest], 1)
        return self._best(score, np.concatenate((first, rest)), floor, k, skip)

    @staticmethod
    def _best(score: np.ndarray, visited: np.ndarray, floor: float, k: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of the visited blocks' examples, of those of the floor at least and above 0; rounded, so that ties are ties."""
        s = score[visited]
        at = np.nonzero(s >= max(floor, 1e-12))
        s, e = np.round(s[at], 12), visited[at[0]] * BLOCK + at[1]
        if skip >= 0:
            s, e = s[e != skip], e[e != skip]
        if len(s) > 4 * k:
            own = s >= np.partition(s, len(s) - k)[len(s) - k]
            s, e = s[own], e[own]
        best = np.lexsort((e, -s))[:k]
        return e[best], s[best]

    def share(self, vector: dict[int, float] | tuple[np.ndarray, np.ndarray], skip: int = -1) -> tuple[float, np.ndarray]:
        """Weighted share of label 1 among the nearest, and those examples."""
        found, cosine = self.nearest(vector, self.voters, skip)
        if not len(found):
            return self.blank, found
        vote = cosine * self.weights[found]
        return float((vote * self.labels[found]).sum() / vote.sum()), found

    def score(self, vector: dict[int, float] | tuple[np.ndarray, np.ndarray]) -> tuple[float, np.ndarray]:
        """Calibrated probability of label 1, and the examples that voted."""
        share, found = self.share(vector)
        if not len(found) or not len(self.steps[0]):
            return min(1.0, max(0.0, share)), found
        return float(np.interp(share, *self.steps)), found


def _monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: (share, probability) steps that never fall."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b, c in zip(x[order], y[order], w[order], strict=True):
        pools.append([a, b, c, a])
        while len(pools) > 1 and (pools[-2][1] >= pools[-1][1] or pools[-2][3] == pools[-1][0]):
            p, q = pools[-2], pools.pop()
            pools[-1] = [p[0], (p[1] * p[2] + q[1] * q[2]) / (p[2] + q[2]), p[2] + q[2], q[3]]
    xs = np.array([v for p in pools for v in (p[0], p[3])])
    return xs, np.array([v for p in pools for v in (p[1], p[1])])


def tellers(sample: list[tuple[str, int, str]], totals: dict[int, int]) -> list[str]:
    """At most TERMS words and beginnings, of those that MIN_SHARE of the labelled rows with them have label 1 for, by chi-square.

    Each chosen term halves what the rows with it count for the next ones: words that only keep company with telling ones, or come
    from copies of one text, are left with too little.
    """
    words = {y: [set(WORD.findall(text.lower())) for _, label, text in sample if label == y] for y in (0, 1)}
    n1, n0 = max(1, len(words[1])) * 1.0, max(1, len(words[0])) * 1.0
    up1, up0 = totals.get(1, 0) / n1, totals.get(0, 0) / n0
    least = max(1, min(MIN_ROWS, int(n1) // ROWS_SHARE))
    often: set[str] = set()
    seen: dict[int, Counter[str]] = {0: Counter(), 1: Counter()}
    for k in (0, *PREFIXES):  # one length at a time: all beginnings of all words at once would fill memory
        own = Counter(t for row in words[1] for t in ({w[:k] + "*" for w in row if len(w) >= k} if k else row))
        own = Counter({t: n for t, n in own.items() if n >= least})
        often |= own.keys()
        seen[1] += own
    for row in words[0]:
        seen[0].update({t for w in row for t in terms_of(w) if t in often})
    positive = [{t for w in row for t in terms_of(w) if t in often} for row in words[1]]
    del words
    rows_of: dict[str, list[int]] = {t: [] for t in often if seen[1][t] * up1 >= MIN_SHARE * (seen[1][t] * up1 + seen[0][t] * up0)}
    for i, row in enumerate(positive):
        for t in row & rows_of.keys():
            rows_of[t].append(i)
    part = np.ones(len(positive))
    chosen: list[str] = []
    open_ = {t: np.array(r) for t, r in rows_of.items()}

    def chi_square(term: str, a: float) -> float:
        x, y, full1, full0 = a * up1, seen[0][term] * up0, n1 * up1, n0 * up0
        off = x * (full0 - y) - y * (full1 - x)
        return off * off * (full1 + full0) / max(1e-9, full1 * full0 * (x + y) * (full1 + full0 - x - y))

    while open_ and len(chosen) < TERMS:
        held = {t: float(part[r].sum()) for t, r in open_.items()}
        open_ = {t: r for t, r in open_.items() if held[t] >= least}
        if not open_:
            break
        best = min(open_, key=lambda t: (-chi_square(t, held[t]), -len(t), t))
        chosen.append(best)
        part[open_.pop(best)] /= 2
    return sorted(chosen)


def vocabulary_of(sample: list[tuple[str, int, str]], telling: list[str]) -> dict[str, int]:
    """All words of the sampled texts and the telling terms, in order, and their places."""
    words = {w for _, _, text in sample for w in WORD.findall(text.lower())}
    return {t: k for k, t in enumerate(sorted(words | set(telling)))}


def train(
    sample: list[tuple[str, int, str]], totals: dict[int, int], corpus: tuple[int, np.ndarray] | None = None, telling: list[str] | None = None
) -> ToxicityModel:
    """(id text, label, text) rows and the number of labelled rows of each label -> model. Deterministic.

    telling: the terms that weigh more, those of tellers() if None. corpus: how many texts there are, and how many of them hold
    each term of vocabulary_of(sample, telling); the sample's own if None.
    """
    sample = sorted(sample)
    labels = np.array([y for _, y, _ in sample], dtype=float)
    size = {y: max(1, int((labels == y).sum())) for y in (0, 1)}
    weights = np.array([totals.get(int(y), 0) / size[int(y)] for y in labels]) if len(labels) else labels
    telling = tellers(sample, totals) if telling is None else telling
    vocabulary = vocabulary_of(sample, telling)
    if corpus is None:
        counter = ToxicityModel({}, vocabulary, np.zeros(0), labels, weights, [])
        held = np.zeros(len(vocabulary))
        for _, _, text in sample:
            held[counter.terms_in([text])[1]] += 1
        corpus = len(sample), held
    idf = np.log((1 + corpus[0]) / (1 + corpus[1])) + 1
    terms = {t: vocabulary[t] for t in telling}
    idf[list(terms.values())] *= TELLING
    model = ToxicityModel(terms, vocabulary, idf, labels, weights, [i for i, _, _ in sample])
    model.voters = max(1, min(K, size[1] // VOTERS_SHARE))  # more would be mostly label 0 whatever the text
    vectors = [model.arrays(text) for _, _, text in sample]
    model.index(vectors)
    empty = np.array([not len(v) for v, _ in vectors], dtype=bool)
    mass = float(weights[empty].sum()) if len(empty) else 0.0
    model.blank = float((weights * labels)[empty].sum() / mass) if mass else 0.0
    own = [i for i, (v, _) in enumerate(vectors) if len(v)]
    shares = np.array([model.share(vectors[i], skip=i)[0] for i in own])
    if len(own):
        model.steps = _monotone(shares, labels[own], weights[own])
    return model


def training_sample(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str, text_col: str, label_col: str) -> tuple[list, dict[int, int]]:
    """A bounded sample of labelled rows, by a hash of their ids, and how many labelled rows there are to choose from.

    labels holds the usable ids. Ids that are labelled both ways count as label 1. Only labels whose document is there, with a text
    of at most SAMPLE_TEXT_BYTES, count and can be chosen; ids are chosen before any text is gathered. Of rows with one id the
    smallest text counts.
    """
    rows = labels.where(usable & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    ids = rows.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__y"))
    short = docs.where(F.col(id_col).isNotNull() & (F.octet_length(text_col) <= SAMPLE_TEXT_BYTES))
    there = ids.join(short.select(F.col(id_col).alias("__id")).distinct(), "__id", "left_semi")
    checkpoint_dir(docs.sparkSession)
    there = there.checkpoint()  # ids and labels alone
    totals = {r["__y"]: r["count"] for r in there.groupBy("__y").count().collect()}
    chosen = None
    for y, most in SAMPLE.items():
        part = there.where(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = short.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).join(F.broadcast(chosen), "__id")
    found = texts.groupBy("__id", "__y").agg(F.min("__text").alias("__text")).collect()  # at most sum(SAMPLE.values()) rows
    return [(str(r["__id"]), r["__y"], r["__text"]) for r in found], totals


def document_counts(docs: DataFrame, vocabulary: dict[str, int], text_col: str) -> tuple[int, np.ndarray]:
    """How many rows docs has, and in how many of them each term stands. Tasks give one row for each term they met."""
    small_batches(docs.sparkSession)
    size = len(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by SAMPLE and SAMPLE_TEXT_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ToxicityModel({}, shared.value, np.zeros(0), np.zeros(0), np.zeros(0), [])
        held = np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            held[size] += batch.num_rows
            for run_of in text_runs(batch):
                texts = [t for t in run_of.column(0).to_pylist() if t is not None]
                held[:size] += np.bincount(model.terms_in(texts)[1], minlength=size)
        found = np.flatnonzero(held)
        forget(shared)
        trim()
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(held[found])], names=["term", "n"])

    parts = docs.select(F.col(text_col).cast("string").alias("__text")).mapInArrow(run, "term long, n long")
    sums = parts.groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    held = np.zeros(size + 1, dtype=np.int64)
    held[sums.column("term").to_numpy()] = sums.column("n").to_numpy()
    return int(held[size]), held[:size].astype(float)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """The model of a sample of labelled rows, with document frequencies of all rows of docs."""
    sample, totals = training_sample(docs, labels, usable, id_col, text_col, label_col)
    if not sample:
        return train([], totals)
    telling = tellers(sorted(sample), totals)
    model = train(sample, totals, document_counts(docs, vocabulary_of(sample, telling), text_col), telling)
    trim()
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds score (double), predicted (int) and evidence (array of example ids) to the columns in carry.

    Whole texts are scored. A text without a term of any example, as null and empty ones are, gets the share of label 1 among
    such examples, without evidence. Equal texts get equal results. With no labelled rows every score is 0.
    """
    carry = docs.columns if carry is None else carry
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by SAMPLE and SAMPLE_TEXT_BYTES

    known: dict[bytes, tuple[float, list[str]]] = {}

    def run(texts: list[bytes | None]) -> dict:
        m = shared.value
        keys = [hashlib.blake2b(text or b"", digest_size=16).digest() for text in texts]
        here = {key: known[key] for key in keys if key in known}
        new = {key: text for key, text in zip(keys, texts, strict=True) if key not in here}
        vectors = m.vectors([(text or b"").decode("utf-8", "replace") for text in new.values()])
        if len(known) + len(new) > REMEMBER:
            known.clear()
        for key, vector in zip(new, vectors, strict=True):
            score, found = m.score(vector)
            here[key] = score, [m.ids[e] for e in found[:5]]
            if len(known) < REMEMBER:
                known[key] = here[key]
        scores, evidence = [here[key][0] for key in keys], [here[key][1] for key in keys]
        return {"score": scores, "predicted": [int(s >= 0.5) for s in scores], "evidence": evidence}

    return map_texts(docs, text_col, carry, run, "score double, predicted int, evidence array<string>", at_end=lambda: forget(shared))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence for each row of documents.

    Null ids are scored and not learnt from; see score_toxicity() for null, empty and equal texts, training_sample() for repeated
    ids. Other columns take no part; an empty table gives an empty one.
    """
    remainder = id_remainder(F.col("doc_id"), 5)
    model = fit(docs, labels, remainder != 0)
    return score_toxicity(docs.select("doc_id", (remainder == 0).alias("held_out"), "text"), model, carry=["doc_id", "held_out"])


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents that are not predicted toxic. The labelled texts come from docs.

    Columns of any name and type pass through as they are; equal texts stay or go together; an empty table gives an empty one.
    """
    model = fit(docs, labels, id_remainder(F.col("doc_id"), 5) != 0)
    packed, carry = pack(docs, {"__source_text": F.col("text")})
    scored = score_toxicity(packed, model, "__source_text", carry)
    return unpack(scored.where("predicted = 0"), docs)
