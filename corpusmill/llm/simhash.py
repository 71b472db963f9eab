"""Operator 10, SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints.  A-Z is lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, shingles are
three words joined by a space (all words if there are fewer), repeats included.
Each is hashed with XXH64, seed 42; a bit is set if over half the hashes set it.

Links.  Two fingerprints link when at most two bits differ.  The distinct fingerprints are
sorted by Gray rank, which puts those with few differing bits side by side, over all tasks:
that order is cut into RANGES ranges, of which a task holds one at a time (some 55 bytes a fingerprint).  One tree stands over the order:

* eight neighbours make a node that holds the bits all of them share, eight nodes
  a node above, and so on: what all children share is stated once, in the parent;
* the upper nodes stand over the ranges, from the bits that all fingerprints of a range
  share; they are broadcast, RANGES leaves;
* a search walks down with the differences met so far and drops a node, with all
  below it, once they pass two.  A node whose free bits cannot bring the total
  over two links as a whole;
* a fingerprint is sent to the ranges that the upper nodes leave (its own and later ones, as
  links have no direction) and goes on down there.  Ranges hold about equal numbers of distinct
  fingerprints, whatever the skew of the documents.  With ``b`` bits that tell the ranges apart
  a fingerprint goes to some ``(1 + b + b * (b - 1) / 2) / 2`` of them.

Only a spanning forest of the links leaves a task, so a group of ``k`` near copies
gives at most ``k - 1`` edges.  ``components`` joins the forests.

Defined results.  Null and wordless texts have fingerprint zero and link like any
other.  Texts of any length are read whole, _HASHES_AT_ONCE shingles at a time.  Rows that
repeat a document share its component.  A null id is never the smallest id (a component
of null ids only has id null).  Of a component :func:`drop_near_duplicates` keeps one
document: the smallest id, and of several texts with that id the one with the smallest
``xxhash64``; rows that repeat both are that document and stay.  Empty tables give no
rows.  Extra columns are ignored, and carried through by :func:`drop_near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import common as C
from corpusmill.llm.components import connected_components

SHINGLE = 3
SEED = 42
#: Largest number of differing bits of a link.
RADIUS = 2
#: Children of a node of the index.
FAN = 8
#: Ranges of the Gray order, whatever the data, so that the ranges a fingerprint is sent to do not grow with it.
RANGES = 1 << 12
#: Rows searched at a time, and (query, node) pairs looked at together.
CHUNK, FRONTIER = 1 << 16, 1 << 20
_HASHES_AT_ONCE = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint, unsigned."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = [0, *(gaps[: len(gaps) - shingle + 1] + 1).tolist()]
    ends = [*gaps[shingle - 1 :].tolist(), len(line)]
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for i in range(0, len(starts), _HASHES_AT_ONCE):
        part = slice(i, i + _HASHES_AT_ONCE)
        hashes = b"".join([digest(line[a:b], SEED) for a, b in zip(starts[part], ends[part])])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        fps = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), batch.column(2)], ["doc_id", "fp", "text_hash"])


class _Forest:
    """Union of linked positions, as the smallest position of each tree; links are gathered and joined many at a time."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.rows = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.waiting.append((a, b))
        self.rows += len(a)
        if self.rows > FRONTIER:
            self.join()

    def join(self) -> np.ndarray:
        if self.rows:
            a, b = (np.concatenate(x) for x in zip(*self.waiting))
            self._union(a, b)
        self.waiting, self.rows = [], 0
        return self.root

    def _union(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            ra, rb = root[a], root[b]
            open_ = ra != rb
            if not open_.any():
                return
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(up := root[root], root):
                root = up
            self.root = root


class GrayIndex:
    """The hierarchical index over leaves in Gray order: fingerprints, or ranges of them with the bits that each shares."""

    def __init__(self, values: np.ndarray, shared: np.ndarray | None = None) -> None:
        n = len(values)
        shared = np.full(n, ~np.uint64(0)) if shared is None else shared
        self.values, masks = [values & shared], [shared]
        self.lo, self.hi = [np.arange(n)], [np.arange(n)]
        while len(self.values[-1]) > 1:
            heads = np.arange(0, len(self.values[-1]), FAN)
            low = np.bitwise_and.reduceat(self.values[-1], heads)
            high = np.bitwise_or.reduceat(self.values[-1], heads)
            same = np.bitwise_and.reduceat(masks[-1], heads) & ~(low ^ high)
            self.values.append(low & same)
            masks.append(same)
            self.lo.append(self.lo[-1][heads])
            self.hi.append(self.hi[-1][np.r_[heads[1:], len(self.hi[-1])] - 1])
        self.free = [64 - np.bitwise_count(m).astype(np.int64) for m in masks]
        #: bits that a node states itself: those it shares and its parent does not
        self.own = [m & ~np.repeat(up, FAN)[: len(m)] for m, up in zip(masks, [*masks[1:], np.zeros(1, np.uint64)])]
        #: (query, node) pairs looked at, and leaves left out with nodes that were dropped, for figures and tests
        self.looked, self.pruned = 0, 0

    def tight(self, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Neighbours in nodes that are small balls: their leaves are all linked."""
        out = []
        for lo, hi, free in zip(self.lo[1:], self.hi[1:], self.free[1:]):
            small = np.flatnonzero(free <= radius)
            runs = hi[small] - lo[small]
            out.append(np.repeat(lo[small], runs) + _ranges(runs))
        at = np.concatenate(out) if out else np.zeros(0, np.int64)
        return at, at + 1

    def search(self, fp: np.ndarray, after: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For queries ``fp``, nodes that cannot be dropped any further, as arrays (query, first leaf, last leaf).

        Leaves up to ``after`` (one for each query) need not be found.  At a node that is given out above the leaves all are within ``radius``.
        """
        query = np.arange(len(fp))
        if len(self.values[0]):
            yield from self._down(len(self.values) - 1, fp, after, query, np.zeros(len(fp), np.int64), np.zeros(len(fp), np.int64), radius)

    def _down(self, level: int, fp: np.ndarray, after: np.ndarray, query: np.ndarray, node: np.ndarray, met: np.ndarray, radius: int) -> Iterator:
        if len(query) > FRONTIER:
            for i in range(0, len(query), FRONTIER):
                part = slice(i, i + FRONTIER)
                yield from self._down(level, fp, after, query[part], node[part], met[part], radius)
            return
        self.looked += len(query)
        met = met + np.bitwise_count((fp[query] ^ self.values[level][node]) & self.own[level][node])
        later = self.hi[level][node] > after[query]
        far = later & (met > radius)
        if level:
            self.pruned += int((self.hi[level][node[far]] - self.lo[level][node[far]] + 1).sum())
        keep = later & ~far
        query, node, met = query[keep], node[keep], met[keep]
        whole = (met + self.free[level][node] <= radius) | (level == 0)
        if whole.any():
            yield query[whole], self.lo[level][node[whole]], self.hi[level][node[whole]]
        query, node, met = query[~whole], node[~whole], met[~whole]
        if level and len(query):
            heads = node * FAN
            times = np.minimum(heads + FAN, len(self.values[level - 1])) - heads
            yield from self._down(level - 1, fp, after, np.repeat(query, times), np.repeat(heads, times) + _ranges(times), np.repeat(met, times), radius)


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, end to end."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


class RangeSearch:
    """The part of the tree over one range: links among its fingerprints, then those of queries from earlier ranges, as a spanning forest."""

    def __init__(self, fp: np.ndarray, radius: int = RADIUS) -> None:
        self.fp, self.radius, self.index = fp, radius, GrayIndex(fp)
        self.root = np.arange(len(fp))

    def among(self) -> tuple[np.ndarray, np.ndarray]:
        """Links among the range's own fingerprints."""
        forest = _Forest(len(self.fp))
        forest.add(*self.index.tight(self.radius))
        for start in range(0, len(self.fp), CHUNK):
            part = np.arange(start, min(start + CHUNK, len(self.fp)))
            for query, _, hi in self.index.search(self.fp[part], part, self.radius):
                forest.add(part[query], hi)  # leaves of a small ball are linked to each other already
        return self._new(forest.join(), self.fp)

    def of(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links of fingerprints from elsewhere; what earlier queries have joined is not told again."""
        n, m = len(self.fp), len(queries)
        forest = _Forest(n + m)
        forest.root[:n] = self.root
        for query, _, hi in self.index.search(queries, np.full(m, -1), self.radius):
            forest.add(n + query, hi)
        return self._new(forest.join(), np.r_[self.fp, queries])

    def _new(self, root: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.fp)
        joined = np.flatnonzero(root != np.r_[self.root, np.arange(n, len(root))])
        # of a tree that has joined another only its former root is told
        joined = joined[(joined >= n) | (self.root[np.minimum(joined, n - 1)] == joined)]
        self.root = root[:n]
        return fp[root[joined]], fp[joined]


def _ranged(limits: np.ndarray):
    """Each fingerprint with the number of its range; ``limits`` are the last ranks of all ranges but one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.searchsorted(limits, batch.column(1).to_numpy()).astype(np.int64))], ["fp", "rank", "range"])

    return run


def _routed(upper: object):
    """Each fingerprint for its own range (leaf) and for all later ones that the upper nodes leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ones, shared = (np.frombuffer(x, t) for x, t in zip(upper.value, (np.int64, np.uint64, np.uint64)))
        index = GrayIndex(ones, shared)
        for batch in batches:
            fp, rank = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            home = np.searchsorted(at, batch.column(2).to_numpy())
            query, leaf = [np.arange(len(fp))], [home]
            for q, lo, hi in index.search(fp, home):
                lo = np.maximum(lo, home[q] + 1)
                query.append(np.repeat(q, hi - lo + 1))
                leaf.append(np.repeat(lo, hi - lo + 1) + _ranges(hi - lo + 1))
            q, leaf = np.concatenate(query), np.concatenate(leaf)
            yield pa.RecordBatch.from_arrays([pa.array(at[leaf]), pa.array(leaf != home[q]), pa.array(rank[q]), pa.array(fp[q].view(np.int64))], ["range", "guest", "rank", "fp"])

    return run


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (range, guest, rank): a range's own fingerprints make its tree, then its guests are searched, CHUNK at a time."""

    def told(pair: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in pair], ["a", "b"])

    held: list[np.ndarray] = []
    now: tuple[int, bool] | None = None
    tree: RangeSearch | None = None

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal tree
        if held:
            rows = np.concatenate(held)
            held.clear()
            if now[1]:
                yield told(tree.of(rows))
            else:
                tree = RangeSearch(rows)
                yield told(tree.among())

    for batch in batches:
        range_, guest = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
        fp = batch.column(2).to_numpy().view(np.uint64)
        cuts = np.flatnonzero(np.r_[True, (range_[1:] != range_[:-1]) | (guest[1:] != guest[:-1])]) if len(fp) else []
        for a, b in zip(cuts, [*cuts[1:], len(fp)]):
            part = (int(range_[a]), bool(guest[a]))
            if part != now or (part[1] and sum(map(len, held)) >= CHUNK):
                yield from flush()
            now = part
            held.append(fp[a:b])
    yield from flush()


def gray_rank(fp: Column) -> Column:
    """The rank of a signed fingerprint in the order of the Gray code, as a signed long that sorts alike."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def fingerprint_links(fps: DataFrame, fp: str = "fp") -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints that join all links of at most RADIUS bits."""
    spark = fps.sparkSession
    ranked = fps.select(F.col(fp).alias("fp"), gray_rank(F.col(fp)).alias("rank"))
    shares = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    limits = ranked.agg(F.percentile_approx("rank", shares, 8 * RANGES)).first()[0] or []
    limits = np.unique(np.array(limits, np.int64))
    ranked = C.materialize(ranked.mapInArrow(_ranged(limits), "fp long, rank long, range long"), "simhash-ranges")
    # at most RANGES rows, whatever the data
    nodes = ranked.groupBy("range").agg(F.bit_and("fp").alias("ones"), F.bit_or("fp").alias("some")).orderBy("range").collect()
    ones, some = (np.array([r[c] for r in nodes], np.int64).view(np.uint64) for c in ("ones", "some"))
    upper = spark.sparkContext.broadcast([np.array([r["range"] for r in nodes], np.int64).tobytes(), ones.tobytes(), (~(ones ^ some)).tobytes()])
    sent = ranked.mapInArrow(C.tidied(_routed(upper)), "range long, guest boolean, rank long, fp long")
    dealt = sent.repartition("range").sortWithinPartitions("range", "guest", "rank")
    return dealt.select("range", "guest", "fp").mapInArrow(C.tidied(_links), "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fp (signed long), component_id, text_hash (tells rows with one id apart), first_hash (that of the component's first document)."""
    spark = docs.sparkSession
    C.ship(spark)
    C.small_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    prints = C.materialize(rows.mapInArrow(C.tidied(_fingerprints), f"doc_id {docs.schema[id_col].dataType.simpleString()}, fp long, text_hash long"), "simhash")
    total = prints.count()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    each = C.materialize(prints.groupBy("fp").agg(first, F.count("*").alias("n")), "simhash-distinct")
    labels = C.materialize(connected_components(fingerprint_links(each.select("fp"))), "simhash-labels")
    linked = C.materialize(labels.join(each, labels["node"] == each["fp"]).select("fp", "component", "first"), "simhash-linked")
    tops = linked.groupBy("component").agg(F.min("first").alias("top"), F.count("*").alias("members"))
    named = C.join_unique(linked, tops, ["component"], "members", linked.count()).select(F.col("fp").alias("_fp"), "top")
    top = F.coalesce("top", "first")
    where = each.join(named, each["fp"] == named["_fp"], "left").select("fp", "n", top["doc_id"].alias("component_id"), top["text_hash"].alias("first_hash"))
    where = C.materialize(where, "simhash-components")
    return C.join_unique(prints, where, ["fp"], "n", total).select("doc_id", "fp", "component_id", "text_hash", "first_hash")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, the first."""
    found = simhash_components(docs, id_col, text_col)
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("first_hash"))
    gone = C.materialize(found.filter(~kept).groupBy("doc_id", "text_hash").agg(F.count("*").alias("copies")), "simhash-gone")
    size = gone.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    return C.drop_keys(docs, gone, size[0], {"doc_id": F.col(id_col), "text_hash": F.xxhash64(text_col)}, size[1])
