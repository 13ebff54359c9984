"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints within ``DISTANCE`` bits link.  Linking works on distinct
fingerprints: two that differ in at most two of 64 bits agree on two of four
16-bit blocks, so each meets its partners in one of six buckets of agreeing
bits.  A crowded bucket is dealt again by three parts of its free bits, of which
one must agree; after two such refinements 14 free bits are left, so no bucket
ever exceeds 2^14 fingerprints.  Within a bucket the fingerprints are sorted by
Gray rank, which places like bit patterns side by side, and packed into a tree
whose nodes hold the bits that all their members share and that their parent
does not; a search adds up differences from the root and drops whole nodes.
A bucket gives a star for each group of members that it links, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.runtime import materialise
from .common import components, lean, portions

SEED = 42
SHINGLE = 3
DISTANCE = 2
FANOUT = 8
CROWDED = 4096              # members from which a bucket is dealt again
STEP = 1 << 16              # shingles, and searches, in hand at once


def fingerprint(text: str | None) -> int:
    """64 majority bits over the hashes of all word shingles; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n = len(words) - SHINGLE + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, n, STEP):
        part = words[at:at + STEP + SHINGLE - 1]
        line = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
        starts = [0, *ends[:-SHINGLE].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(line[s:e], SEED) for s, e in zip(starts, (ends[SHINGLE - 1:] - 1).tolist())], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, fp): one row per row of ``docs``; ``fp`` holds the 64 bits as a long."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in portions(batch, 1):
                bits = np.fromiter(map(fingerprint, rows.column(1).to_pylist()), np.uint64, len(rows))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(bits.view(np.int64))], ["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("t")).mapInArrow(lean(work), f"key {kind}, fp long")
    return found.withColumnRenamed("key", key)


# --- buckets -----------------------------------------------------------------

def _parts(bits: list[int], n: int) -> list[list[int]]:
    return [list(map(int, part)) for part in np.array_split(bits, n)]


def _mask(bits: list[int]) -> int:
    return int(np.array([sum(1 << b for b in bits)], np.uint64).view(np.int64)[0])


def first_masks() -> list[list[int]]:
    """Agreeing bits by choice of two of four blocks."""
    blocks = _parts(list(range(64)), DISTANCE + 2)
    return [blocks[i] + blocks[j] for i in range(len(blocks)) for j in range(i)]


def finer(masks: list[list[int]]) -> list[list[int]]:
    """Each set of agreeing bits with one of three parts of the bits left free."""
    return [m + part for m in masks for part in _parts([b for b in range(64) if b not in m], DISTANCE + 1)]


def _dealt(rows: DataFrame, masks: list[list[int]], parents: int) -> DataFrame:
    """(fp, mask, value): ``rows`` under each mask; with ``parents`` only under
    the masks that refine the row's own."""
    def item(i: int, bits: list[int]):
        return F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_mask(bits))).alias("value"))

    if not parents:
        dealt = F.array(*[item(i, m) for i, m in enumerate(masks)])
    else:
        step = len(masks) // parents
        dealt = F.lit(None)
        for p in range(parents):
            dealt = F.when(F.col("mask") == p, F.array(*[item(i, masks[i]) for i in range(p * step, (p + 1) * step)])
                           ).otherwise(dealt)
    return rows.select("fp", F.explode(dealt).alias("d")).select("fp", "d.mask", "d.value")


def links(fps: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(a, b), a < b: distinct fingerprints with the same components as all pairs
    at most two bits apart.  A bucket gives the members of each of its groups with
    one of them, not all of its pairs."""
    masks, parents, found, rows = first_masks(), 0, None, fps.select("fp")
    while True:
        dealt = _dealt(rows, masks, parents)
        last = len(masks[0]) >= 50
        counts = dealt.groupBy("mask", "value").agg(F.count("*").alias("n")).filter("n > 1")
        shared = dealt.join(counts, ["mask", "value"])
        if not last:
            shared = materialise(shared)
        now = _linked(shared if last else shared.filter(F.col("n") <= crowded))
        found = now if found is None else found.unionByName(now)
        if last:
            break
        rows = shared.filter(F.col("n") > crowded)
        if rows.isEmpty():
            break
        parents, masks = len(masks), finer(masks)
    return found.distinct()


def _linked(shared: DataFrame) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for rows in batches:                # a bucket may reach into the next batch
            rows = rows if rest is None else pd.concat([rest, rows], ignore_index=True)
            if not len(rows):
                continue
            mask, value = rows["mask"].to_numpy(), rows["value"].to_numpy()
            open_from = int(np.flatnonzero((mask == mask[-1]) & (value == value[-1]))[0])
            rest = rows.iloc[open_from:]
            if open_from:
                yield from _pairs(rows.iloc[:open_from])
        if rest is not None:
            yield from _pairs(rest)

    ordered = shared.select("mask", "value", "fp").repartition("mask", "value").sortWithinPartitions("mask", "value")
    return ordered.mapInPandas(lean(work), "a long, b long")


def _pairs(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    mask, value = rows["mask"].to_numpy(), rows["value"].to_numpy()
    bucket = np.concatenate([[0], np.cumsum((mask[1:] != mask[:-1]) | (value[1:] != value[:-1]))])
    fp = rows["fp"].to_numpy().view(np.uint64)
    order = np.lexsort((gray_rank(fp), bucket))
    bucket, fp = bucket[order], fp[order].view(np.int64)
    label = np.arange(len(fp))
    for left, right in search(bucket, fp.view(np.uint64)):
        _unite(label, left, right)
    linked = np.flatnonzero(label != np.arange(len(fp)))
    if len(linked):
        a, b = fp[label[linked]], fp[linked]
        yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _unite(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Let linked members share the smallest label; labels point at roots before and after."""
    while True:
        a, b = label[left], label[right]
        differ = a != b
        if not differ.any():
            return
        np.minimum.at(label, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while not np.array_equal(jumped := label[label], label):
            label[:] = jumped


# --- hierarchical index --------------------------------------------------------

def gray_rank(fp: np.ndarray) -> np.ndarray:
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class Level:
    """Nodes of one height: shared bits (``mask``, ``pattern``) and child ranges."""

    def __init__(self, ones: np.ndarray, any_: np.ndarray, bucket: np.ndarray, first: np.ndarray, last: np.ndarray):
        self.ones, self.any, self.bucket, self.first, self.last = ones, any_, bucket, first, last
        self.mask = ~(ones ^ any_)


def build(bucket: np.ndarray, fp: np.ndarray) -> list[Level]:
    """Levels from the members up to one root a bucket; both arrays in Gray order
    within each bucket."""
    rows = np.arange(len(fp))
    levels = [Level(fp, fp, bucket, rows, rows + 1)]
    while len(levels) == 1 or (levels[-1].bucket[1:] == levels[-1].bucket[:-1]).any():
        below = levels[-1]
        new = np.concatenate([[True], below.bucket[1:] != below.bucket[:-1]])
        start = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        first = np.flatnonzero((np.arange(len(new)) - start) % FANOUT == 0)
        levels.append(Level(np.bitwise_and.reduceat(below.ones, first), np.bitwise_or.reduceat(below.any, first),
                            below.bucket[first], first, np.concatenate([first[1:], [len(new)]])))
    return levels


def search(bucket: np.ndarray, fp: np.ndarray, distance: int = DISTANCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of members of one bucket at most ``distance`` bits apart, each
    once; the members stand in Gray order within their buckets.

    Searches go down in slices of at most ``STEP``, the deepest first, so that a
    group in which everything is near takes no more memory than any other.
    """
    levels = build(bucket, fp)
    _, root = np.unique(bucket, return_inverse=True)         # one root per bucket, in order
    for at in range(0, len(fp), STEP):
        query = np.arange(at, min(at + STEP, len(fp)))
        waiting = [(len(levels) - 1, query, root[query], np.zeros(len(query), np.int64), np.zeros(len(query), np.uint64))]
        while waiting:
            k, query, node, differences, seen = waiting.pop()
            level = levels[k]
            own = level.mask[node] & ~seen                   # shared here and not further up
            differences = differences + np.bitwise_count((fp[query] ^ level.ones[node]) & own)
            near = differences <= distance
            query, node, differences = query[near], node[near], differences[near]
            if not k:
                once = query < node
                if once.any():
                    yield query[once], node[once]
                continue
            seen = level.mask[node]
            width = level.last[node] - level.first[node]
            which = np.repeat(np.arange(len(node)), width)
            child = np.arange(len(which)) - np.repeat(np.cumsum(width) - width, width) + level.first[node][which]
            for s in range(0, len(which), STEP):
                w = which[s:s + STEP]
                waiting.append((k - 1, query[w], child[s:s + STEP], differences[w], seen[w]))


# --- groups -------------------------------------------------------------------

def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", crowded: int = CROWDED) -> DataFrame:
    """(key, fp, component): ``component`` is the smallest key linked to the row.

    Null and empty texts have fingerprint zero and link like any other.  Repeated
    rows stay; a null key takes part but never names a component, unless nothing
    else does.  Equal fingerprints are one class from the start, so a group of
    copies of any size is one row in all later steps.
    """
    marked = materialise(fingerprints(docs, key, text))
    classes = materialise(marked.groupBy("fp").agg(F.min(key).alias("least")))
    groups = components(links(classes, crowded), "a", "b").withColumnsRenamed({"node": "fp"})
    named = classes.join(groups, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    named = materialise(named)
    least = named.groupBy("label").agg(F.min("least").alias("component"))
    return marked.join(named.select("fp", "label").join(least, "label").select("fp", "component"), "fp")
