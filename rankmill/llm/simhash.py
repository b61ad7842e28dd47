"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Fingerprints of 8 bytes that differ in at most BITS = 4 bits differ in at most 4 bytes, so they share at
least MIN_SHARED = 4 bytes at equal positions. Posting lists for single (position, byte) pairs hold a
256th of all fingerprints each and their pair tallies grow with the square of the corpus; the index is
therefore keyed by the bytes at three positions, for the 20 position triples of TRIPLES, chosen so that
any four positions contain one of them. No pair that shares four bytes is missed. Within a posting list
each pair's shared positional bytes are tallied, pairs below MIN_SHARED go, and the rest are verified
bit by bit. Equal fingerprints are one node from the start. A long posting list is cut into blocks that are
compared two at a time, and a list gives at most a spanning forest of its links, not its pairs.

With three bytes a key, lists grow with the corpus and comparisons with its square over 2**24. Beyond DENSE distinct
fingerprints, where lists would hold more than DENSE / 2**24 on average, keys take four positions, each of the 70 sets of four: more
rows, but lists 256 times shorter. Both find every link.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_dir, map_texts, pack, popcount, unpack

#: Largest Hamming distance of a link, and the positional bytes that such a pair shares at least.
BITS, MIN_SHARED = 4, 4
#: Words of a shingle, and the seed of its XXH64.
SHINGLE, SEED = 4, 42
#: Members of a block of a long posting list.
BLOCK = 1024
#: Lists up to this length are compared pair by pair for a whole batch at once.
SHORT = 8
#: Distinct fingerprints from which keys take four positions instead of three.
DENSE = 1 << 35
#: Rows of one key in a join from which they are joined apart: at least, and as a share of all rows.
HOT_ROWS, HOT_SHARE = 10_000, 100_000


def _triples() -> list[tuple[int, int, int]]:
    """20 triples of 0..7 of which every set of four positions contains one.

    Turan's construction: three classes in a ring; triples inside a class, or two of a class and one of the next.
    """
    classes = [(0, 1, 2), (3, 4, 5), (6, 7)]
    out = [c for c in classes if len(c) == 3]
    for k, own in enumerate(classes):
        for pair in combinations(own, 2):
            out += [tuple(sorted((*pair, x))) for x in classes[(k + 1) % 3]]
    return sorted(out)


TRIPLES = _triples()
QUADS = list(combinations(range(8), MIN_SHARED))


def fingerprint(text: bytes) -> int:
    """SimHash of a text's 4-word shingles: a bit is 1 if set in over half the shingles' hashes."""
    words = text.lower().split()  # bytes: lower-cases A-Z, splits on the six ASCII white-space characters
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) < SHINGLE:
        spans = [(0, len(joined))]
    else:
        spans = zip(starts[: len(words) - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
    total = np.zeros(64, dtype=np.int64)
    for low in range(0, len(hashes), 1 << 15):
        part = hashes[low : low + (1 << 15)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * total > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds `__fp` (long: the 64 bits, signed) to the columns in carry. Null texts count as empty: zero."""
    carry = docs.columns if carry is None else carry

    def run(texts: list[bytes | None]) -> dict:
        return {"__fp": np.array([fingerprint(t or b"") for t in texts], dtype=np.uint64).view(np.int64)}

    return map_texts(docs, text_col, carry, run, "__fp long")


def _matches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Count filter, then verification, of aligned fingerprints."""
    x = a ^ b
    tally = sum(((x >> np.uint64(8 * k)) & np.uint64(255)) == 0 for k in range(8))
    kept = tally >= MIN_SHARED
    kept[kept] = popcount(x[kept]) <= BITS
    return kept


def _forest(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among values."""
    left = np.sort(values)
    from_, to = [], []
    front: list[np.uint64] = []
    while len(left) or front:
        if not front:
            front, left = [left[0]], left[1:]
        node = front.pop()
        if not len(left):
            continue
        near = _matches(left, np.full(len(left), node))
        if near.any():
            found = left[near]
            from_.append(np.full(len(found), node))
            to.append(found)
            front += list(found)
            left = left[~near]
    empty = np.zeros(0, dtype=np.uint64)
    return (np.concatenate(from_), np.concatenate(to)) if from_ else (empty, empty)


def _link(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (list, block pair) -> edges. Carries the unfinished last list to the next batch."""

    def edges(key: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(starts, len(key)))
        size = np.repeat(sizes, sizes)
        out_a, out_b = [], []
        for gap in range(1, SHORT):
            near = (size[:-gap] <= SHORT) & (key[:-gap] == key[gap:])
            at = np.flatnonzero(near)
            at = at[_matches(fp[at], fp[at + gap])] if len(at) else at
            out_a.append(fp[at])
            out_b.append(fp[at + gap])
        for k in np.flatnonzero(sizes > SHORT):
            a, b = _forest(np.unique(fp[starts[k] : starts[k] + sizes[k]]))
            out_a.append(a)
            out_b.append(b)
        a, b = np.concatenate(out_a).view(np.int64), np.concatenate(out_b).view(np.int64)
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for frame in frames:
        own = frame["list"].to_numpy(np.int64)
        key = np.concatenate((key, own))
        fp = np.concatenate((fp, frame["fp"].to_numpy(np.int64).view(np.uint64)))
        if not len(key):
            continue
        done = len(key) - _run_at_end(key)
        if done > 1:
            yield edges(key[:done], fp[:done])
        key, fp = key[done:], fp[done:]
    if len(key) > 1:
        yield edges(key, fp)


def _run_at_end(key: np.ndarray) -> int:
    """Length of the run of equal values at the end."""
    differ = np.flatnonzero(key != key[-1])
    return len(key) if not len(differ) else len(key) - 1 - int(differ[-1])


def links(nodes: DataFrame, fp: str = "fp", positions: list[tuple[int, ...]] = TRIPLES) -> DataFrame:
    """Links (a < b) between distinct fingerprints at most BITS apart: all of them, up to what connects each list.

    Every pair within distance BITS is connected by the returned links, though a list shared by many near
    fingerprints returns a spanning forest instead of all its pairs. positions: sets of byte positions of which any MIN_SHARED
    positions contain one, TRIPLES or QUADS.
    """
    byte = [F.shiftrightunsigned(F.col(fp), 8 * k).bitwiseAND(F.lit(255)) for k in range(8)]
    keys = []
    for n, places in enumerate(positions):
        key = F.lit(n).cast("long")
        for k in places:
            key = F.shiftleft(key, 8) + byte[k]
        keys.append(key)
    posted = nodes.select(F.col(fp).alias("fp"), F.explode(F.array(*keys)).alias("key"))
    size = posted.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    members = posted.join(size, "key")
    # A list of more than BLOCK members: deal its members into blocks, and give each pair of blocks a list of its own.
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.expr("transform(sequence(0, blocks - 1), x -> least(x, own) * blocks + greatest(x, own))")
    dealt = members.withColumn("blocks", blocks).withColumn("own", own)
    whole = dealt.where("blocks = 1").select(F.col("key").alias("list"), "fp")
    cut = dealt.where("blocks > 1").select("key", "fp", F.explode(pairs).alias("pair")).select(F.xxhash64("key", "pair").alias("list"), "fp")
    # Equal hashes of two lists only mean that more pairs are compared.
    lists = whole.unionByName(cut)
    parts = lists.repartition(F.col("list")).sortWithinPartitions("list")
    return parts.mapInPandas(_link, "a long, b long").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each end of an edge reaches, by alternating large and small stars.

    Each round is written to the shared checkpoint folder, which cuts lineage. All in DataFrames: neither links nor
    components come to the driver, only a count and a checksum for each round. Rounds go on until nothing changes; a graph that
    takes more than max_rounds (their number grows with the logarithm of a component's width) raises RuntimeError.
    """
    spark = edges.sparkSession
    checkpoint_dir(spark)
    current = edges.where("a <> b").select("a", "b").distinct().checkpoint()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    before = state(current)
    rounds = 0
    while before[0]:
        if rounds == max_rounds:
            raise RuntimeError(f"components not found in {max_rounds} rounds")
        rounds += 1
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # Small star: each node's smaller neighbours, and the node, point to the smallest of them.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(low, "a").select(F.col("m").alias("a"), "b").where("a <> b")
        current = moved.unionByName(low.select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
        after = state(current)
        if after == before:
            break
        before = after
    return current.select(F.col("b").alias("node"), F.col("a").alias("root"))


def _join_named(rows: DataFrame, names: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with names, which has one row a key and `__rows`, how many rows have it. Keys of very many rows meet none in a shuffle.

    Such keys have over HOT_ROWS rows and over a HOT_SHARE-th of all, so there are at most HOT_SHARE of them, and they are broadcast.
    """
    edge = max(HOT_ROWS, total // HOT_SHARE)
    hot = F.broadcast(names.where(F.col("__rows") > edge).drop("__rows"))  # at most HOT_SHARE rows
    cold = names.where(F.col("__rows") <= edge).drop("__rows")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, `__fp` (long), root (its component's smallest fingerprint) and component_id for each row; component_id is the smallest id reachable through links.

    Null and blank texts have fingerprint zero and link like any other. Repeated rows and equal texts share a
    fingerprint. A null id takes no part as a smallest id; a component of null ids only has a null component_id. An empty table
    gives an empty one.
    """
    spark = docs.sparkSession
    checkpoint_dir(spark)
    prints = fingerprints(docs.select(F.col(id_col), F.col(text_col)), text_col, [id_col]).checkpoint()
    nodes = prints.groupBy(F.col("__fp").alias("fp")).agg(F.min(id_col).alias("least"), F.count("*").alias("copies")).checkpoint()
    distinct, total = nodes.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    reached = components(links(nodes, positions=QUADS if distinct > DENSE else TRIPLES)).distinct()
    linked = nodes.join(reached.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "copies", "root")
    # Fingerprints without a link are their own component; only the others meet by root.
    linked = linked.checkpoint()
    alone = linked.where("root is null").select("fp", "copies", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    rooted = linked.select("fp", "least", "copies", F.coalesce("root", "fp").alias("root"))
    group = linked.where("root is not null").select("root").distinct()
    rooted = rooted.join(group.withColumnRenamed("root", "__r"), F.col("root") == F.col("__r"), "left_semi")
    first = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("__rows"))
    joined = _join_named(rooted.select("root", "fp", "copies"), first, "root", distinct).select("fp", "copies", "root", "component_id")
    apart = alone.join(group, "root", "left_anti").select("fp", "copies", "root", "component_id")
    names = apart.unionByName(joined).select(F.col("fp").alias("__fp"), "root", "component_id", F.col("copies").alias("__rows")).checkpoint()
    return _join_named(prints, names, "__fp", total).select(id_col, "__fp", "root", "component_id")


def simhash_near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id for each row of documents; see near_duplicates() for the edge cases."""
    found = near_duplicates(docs.select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component: of its smallest doc_id, and of the smallest fingerprint where rows of that id differ.

    Rows with a null doc_id stay only where no row of their component has an id, one of each fingerprint. A repeated id in two
    components keeps a row in each. Columns of any name and type but maps pass through as they are; of rows alike in id and
    fingerprint it doesn't matter which stays. An empty table gives an empty one.
    """
    found = near_duplicates(docs.select("doc_id", "text"), "doc_id", "text")
    best = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    named = best.where("doc_id is not null").groupBy("root", "doc_id").agg(F.min("__fp").alias("__fp"))
    unnamed = best.where("doc_id is null").select("root", "doc_id", "__fp").distinct()
    chosen = named.unionByName(unnamed).select(F.col("doc_id").alias("__id"), F.col("__fp").alias("__print")).distinct()
    packed, carry = pack(docs, {"__key": F.col("doc_id"), "__source_text": F.col("text")})
    printed = fingerprints(packed, "__source_text", [*carry, "__key"])
    kept = printed.join(chosen, F.col("__key").eqNullSafe(F.col("__id")) & (F.col("__fp") == F.col("__print")), "left_semi")
    return unpack(kept.dropDuplicates(["__key", "__fp"]), docs)
