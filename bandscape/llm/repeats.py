"""Removal of repeated byte strings with suffix arrays and longest-previous-factor arrays.

A string of ``SPAN`` bytes is a window.  Among the grams of ``GRAM`` bytes inside a
window the one with the smallest hash is its anchor, so equal windows have equal
anchors at the same place.  Consecutive windows with the same anchor form a
context.  Contexts are grouped by their anchor's hash:

- an anchor at one place has no repeated window and goes at once;
- equal contexts are one class from the start, however many copies there are;
- the distinct contexts of an anchor, which differ at the edges of repeated
  passages, are laid side by side and sorted as suffixes.  Previous and next
  smaller places in suffix order give each window's longest earlier match.

An anchor with more than ``CROWDED`` distinct contexts, as in a line that very many
texts share, or with more than ``SORTED`` bytes of them, as in long periodic texts,
is settled by hashes of its windows, counted like any other rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.runtime import discard, materialise
from .common import fresh, lean, portions

SPAN = 200
GRAM = 80
CHUNK = 1 << 18             # bytes of a text in hand at once
BATCH = 1 << 19             # bytes sorted at once
CROWDED = 2000
SORTED = 1 << 20            # bytes of an anchor's distinct contexts that one task sorts
SENT = 2_000_000            # rows of two or three numbers that are broadcast
BASE = 0x9E3779B97F4A7C15


# --- anchors ------------------------------------------------------------------

class Rolling:
    """Hashes modulo 2^64 of any part of up to ``CHUNK`` + ``SPAN`` bytes."""

    def __init__(self, size: int = CHUNK + SPAN):
        def powers(base: int) -> np.ndarray:
            out = np.full(size + 1, base, np.uint64)
            out[0] = 1
            return np.cumprod(out)

        self.up, self.down = powers(BASE), powers(pow(BASE, -1, 1 << 64))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.down[:len(data)], out=out[1:])
        return out

    def part(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((prefix[end] - prefix[start]) * self.up[start])

    def every(self, prefix: np.ndarray, width: int) -> np.ndarray:
        count = len(prefix) - width
        return _mixed((prefix[width:] - prefix[:-width]) * self.up[:count])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _sliding(values: np.ndarray, width: int, best: np.ufunc, filler: int) -> np.ndarray:
    """``best`` of each ``width`` consecutive values."""
    blocks = np.concatenate([values, np.full(-len(values) % width, np.uint64(filler))]).reshape(-1, width)
    ahead = best.accumulate(blocks, axis=1).ravel()
    behind = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(values) - width + 1
    return best(behind[:count], ahead[width - 1:width - 1 + count])


def contexts(data: np.ndarray, rolling: Rolling, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor, context, first window, windows, inner) for all windows of ``data``.

    A periodic stretch has the same anchor at several places of one context; then
    ``inner`` is set, as windows of the context may equal each other.
    """
    prefix, width = rolling.prefix(data), span - gram + 1
    grams = rolling.every(prefix, gram)
    least = _sliding(grams, width, np.minimum, 2**64 - 1)
    first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    end = np.concatenate([first[1:], [len(least)]])
    edge = np.zeros(width - 1, np.uint64)
    places = np.flatnonzero(grams == _sliding(np.concatenate([edge, least, edge]), width, np.maximum, 0))     # anchors
    equal = np.concatenate([[0], np.cumsum(grams[places[1:]] == grams[places[:-1]])])
    low, high = np.searchsorted(places, first), np.searchsorted(places, end + width - 1)
    own = rolling.part(prefix, first, end - 1 + span) ^ _mixed((end - first).astype(np.uint64))
    return least[first], own, first, end - first, equal[high - 1] > equal[low]


def _anchors(docs: DataFrame, row: str, key: str, text: str, span: int, gram: int) -> DataFrame:
    """(row, key, lo, n, a, c, inner): contexts of all texts; long texts in overlapping chunks."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            for part in portions(batch, 2):
                owner, found = [], []
                for i, t in enumerate(part["t"]):
                    data = np.frombuffer(t.as_buffer(), np.uint8) if t.is_valid and len(t.as_buffer()) else np.zeros(0, np.uint8)
                    for lo in range(0, len(data) - span + 1, CHUNK):
                        a, c, first, n, inner = contexts(data[lo:lo + CHUNK + span - 1], rolling, span, gram)
                        found.append((a, c, first + lo, n, inner))
                        owner.append(np.full(len(a), i))
                if found:
                    a, c, lo, n, inner = (np.concatenate(x) for x in zip(*found))
                    owner = pa.array(np.concatenate(owner))
                    yield pa.RecordBatch.from_arrays(
                        [part["row"].take(owner), part["key"].take(owner), pa.array(lo.astype(np.int64)), pa.array(n.astype(np.int32)),
                         pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), pa.array(inner)], ["row", "key", "lo", "n", "a", "c", "inner"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(row).alias("row"), F.col(key).alias("key"), F.col(text).cast("binary").alias("t")).mapInArrow(
        lean(work), f"row long, key {kind}, lo long, n int, a long, c long, inner boolean")


# --- suffix order ---------------------------------------------------------------

def suffix_levels(data: np.ndarray, span: int) -> list[tuple[int, np.ndarray]]:
    """(length, rank) by prefix doubling up to half of ``span``; bytes beyond the end are zero."""
    key = np.zeros(len(data), np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i:i + len(data)]
    levels, length = [(8, _ranks(key))], 8
    while 2 * length < span:
        levels.append((2 * length, _pair(levels[-1][1], length, np.arange(len(data)))))
        length *= 2
    return levels


def _ranks(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_inverse=True)[1].astype(np.int32) + 1


def _pair(rank: np.ndarray, ahead: int, at: np.ndarray) -> np.ndarray:
    padded = np.concatenate([rank, np.zeros(ahead, np.int32)])
    return _ranks((padded[at].astype(np.uint64) << np.uint64(32)) | padded[at + ahead].astype(np.uint64))


def suffix_order(data: np.ndarray, starts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of ``starts`` in suffix order by ``span`` bytes, ties in the given
    order, and each one's common prefix with the one before it, at most ``span``."""
    levels = suffix_levels(data, span)
    length, rank = levels[-1]
    whole = _pair(rank, span - length, starts) if span > length else rank[starts]
    order = np.argsort(whole, kind="stable")
    left, right = starts[order][:-1], starts[order][1:]
    common = np.zeros(len(left), np.int64)
    for size, r in reversed(levels):                            # lengths halve, so each is added at most twice
        r = np.concatenate([r, np.zeros(2 * span + 1, np.int32)])
        for _ in range(2):
            same = (r[left + common] == r[right + common]) & (common + size <= span)
            common += np.where(same, size, 0)
    padded = np.concatenate([data, np.zeros(2 * span, np.uint8)])
    for _ in range(7):
        common += (common < span) & (padded[left + common] == padded[right + common])
    return order, np.concatenate([[0], common])


def longest_previous(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each place the longest match that starts at a smaller place.

    It is one with the previous or the next smaller place in suffix order; a stack
    of increasing places finds both in one pass.
    """
    best = [0] * len(order)
    places, shared = [], []                                     # shared[i]: with the place below it
    for place, c in zip([*order.tolist(), -1], [*common.tolist(), 0]):
        while places and places[-1] > place:
            top, below = places.pop(), shared.pop()
            best[top] = below if below > c else c               # with the previous and the next smaller one
            if below < c:
                c = below
        if place >= 0:
            places.append(place)
            shared.append(c)
    return np.array(best, np.int64)


def repeated_windows(parts: list[bytes], span: int, first: bool) -> list[np.ndarray]:
    """For each part, one of distinct contexts in their order of occurrence: does
    the window at each start occur elsewhere (``first``: at an earlier place)?

    Earlier matches are longest previous factors; later ones are those of the
    places in reverse, whose suffix order is the same.
    """
    sizes = np.array([len(p) for p in parts])
    counts, offset = sizes - span + 1, np.cumsum(sizes) - sizes
    which = np.repeat(np.arange(len(parts)), counts)
    edges = np.cumsum(counts) - counts
    starts = np.arange(len(which)) - edges[which] + offset[which]
    order, common = suffix_order(np.frombuffer(b"".join(parts), np.uint8), starts, span)
    hit = longest_previous(order, common) >= span
    if not first:
        hit |= longest_previous(len(order) - 1 - order, common)[::-1] >= span
    return np.split(hit, edges[1:])


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


# --- spans -------------------------------------------------------------------

def repeated_spans(docs: DataFrame, row: str, key: str, text: str, keep_first: bool, span: int = SPAN, gram: int = GRAM,
                   crowded: int = CROWDED, most: int = SORTED, sent: int = SENT) -> DataFrame:
    """(row, lo, hi): byte ranges covered by windows that occur more than once.

    With ``keep_first`` the first occurrence of each window, by ``key``, row and
    place, is left out.  Ranges of a row may overlap.
    """
    found = materialise(_anchors(docs, row, key, text, span, gram))
    again = materialise(found.groupBy("a").agg(F.count("*").alias("_n"), F.max("inner").alias("_i")).filter("_n > 1 or _i").select("a"))
    again = F.broadcast(again) if again.count() <= sent else again
    rows = materialise(found.join(again, "a", "left_semi"))
    discard(found)
    at = F.struct(F.col("key").isNotNull().alias("k0"), "key", "row", "lo", "n")        # null keys come first
    classes = materialise(rows.groupBy("a", "c").agg(F.count("*").alias("m"), F.min(at).alias("first"),
                                                           F.max("inner").alias("inner")))
    size = F.sum(F.col("first.n") + (span - 1))
    groups = classes.groupBy("a").agg(F.count("*").alias("k"), F.max("inner").alias("i"), size.alias("size")).filter("k > 1 or i")
    groups = groups.select("a", ((F.col("k") > crowded) | (F.col("size") > most)).alias("many"))
    mixed = materialise(classes.join(groups, "a").select("a", "many", "m", "first", "first.row", "first.lo", "first.n"))

    copies = rows.join(classes.filter("m > 1").drop("inner"), ["a", "c"])
    if keep_first:
        copies = copies.filter((F.col("row") != F.col("first.row")) | (F.col("lo") != F.col("first.lo")))
    spans = copies.select("row", "lo", (F.col("lo") + F.col("n") + (span - 1)).alias("hi"))

    wanted = mixed.select("row", "lo", "n", "a", "many", "m", "first")
    data = _of_rows(docs.select(F.col(row).alias("row"), F.col(text).cast("binary").alias("t")), "row", wanted, sent).join(wanted, "row")
    cut = F.substring(F.col("t"), (F.col("lo") + 1).cast("int"), (F.col("n") + (span - 1)).cast("int"))
    data = materialise(data.select("a", "many", "m", "first", "row", "lo", cut.alias("t")))
    spans = spans.unionByName(_sorted_spans(data.filter(~F.col("many")), span, keep_first))
    if not mixed.filter("many").isEmpty():
        spans = spans.unionByName(_counted_spans(data.filter("many"), span, keep_first))
    return spans


def _sorted_spans(data: DataFrame, span: int, keep_first: bool) -> DataFrame:
    def settled(rows: list[tuple]) -> pa.RecordBatch:
        out = []
        for (row, lo, m, _, _), hit in zip(rows, repeated_windows([r[4] for r in rows], span, keep_first)):
            if keep_first or m == 1:                # else all of it is repeated anyway
                out += [(row, lo + s, lo + e - 1 + span) for s, e in zip(*(x.tolist() for x in _runs(hit)))]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 3)], ["row", "lo", "hi"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, before = [], 0, None
        for batch in batches:
            for item in zip(*(batch[c].to_pylist() for c in ("row", "lo", "m", "a", "t"))):
                if item[3] != before and size > BATCH:          # an anchor's contexts stay together
                    yield settled(held)
                    held, size = [], 0
                before = item[3]
                held.append(item)
                size += len(item[4])
        if held:
            yield settled(held)

    dealt = data.repartition("a").sortWithinPartitions("a", "first").select("row", "lo", "m", "a", "t")
    return dealt.mapInArrow(lean(work), "row long, lo long, hi long")


def _counted_spans(data: DataFrame, span: int, keep_first: bool) -> DataFrame:
    """The same by counting hashes of windows, for anchors with very many contexts."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(CHUNK // 2 + 2 * span)
        for batch in batches:
            for i, t in enumerate(batch["t"]):
                data = np.frombuffer(t.as_buffer(), np.uint8)
                for at in range(0, len(data) - span + 1, CHUNK // 2):
                    part = data[at:at + CHUNK // 2 + span - 1]
                    hashes = rolling.every(rolling.prefix(part), span)
                    own = pa.array(np.full(len(hashes), i))
                    yield pa.RecordBatch.from_arrays(
                        [batch[c].take(own) for c in ("row", "m", "a", "first")]
                        + [pa.array(hashes.view(np.int64)), pa.array(np.arange(len(hashes)) + at + batch["lo"][i].as_py())],
                        ["row", "m", "a", "first", "h", "s"])

    first = data.schema["first"].dataType.simpleString()
    windows = data.select("row", "lo", "m", "a", "first", "t").mapInArrow(lean(work), f"row long, m long, a long, first {first}, h long, s long")
    windows = materialise(windows)
    place = F.struct("first", "s")
    seen = windows.groupBy("a", "h").agg(F.count("*").alias("_n"), F.min(place).alias("_least")).filter("_n > 1")
    hit = windows.join(seen, ["a", "h"])
    hit = hit.filter(place != F.col("_least")) if keep_first else hit.filter("m = 1")
    return hit.select("row", F.col("s").alias("lo"), (F.col("s") + span).alias("hi"))


# --- texts -------------------------------------------------------------------

def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching ranges."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


def kept_bytes(data: bytes, runs: list[tuple[int, int]], characters: bool = False) -> bytes:
    """``data`` without ``runs``; with ``characters`` a run is narrowed to whole UTF-8 characters."""
    out, at = [], 0
    for lo, hi in runs:
        if characters:
            while lo < hi and data[lo] & 0xC0 == 0x80:
                lo += 1
            while lo < hi < len(data) and data[hi] & 0xC0 == 0x80:
                hi -= 1
        out.append(data[at:lo])
        at = max(at, hi)
    return b"".join([*out, data[at:]])


def _of_rows(docs: DataFrame, row: str, rows: DataFrame, sent: int, how: str = "left_semi") -> DataFrame:
    """Only those texts go into a shuffle that take part in the join to come."""
    ids = materialise(rows.select(row).distinct())
    return docs.join(F.broadcast(ids) if ids.count() <= sent else ids, row, how)


def _with_spans(docs: DataFrame, row: str, spans: DataFrame, name: str, sent: int) -> DataFrame:
    listed = spans.groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias(name)).withColumnRenamed("row", row)
    listed = materialise(listed)
    whole = _of_rows(docs, row, listed, sent, "left_anti").withColumn(name, F.lit(None).cast(listed.schema[name].dataType))
    return _of_rows(docs, row, listed, sent).join(listed, row).unionByName(whole)


def digest(docs: DataFrame, row: str, key: str, text: str, keep_first: bool = False, sent: int = SENT, **options) -> DataFrame:
    """(row, key, n_bytes, n_removed, n_spans, kept_sha256) for each row of ``docs``,
    which must be a written table with a unique ``row``.

    A null text counts as empty.  Texts shorter than a window stay whole; repeated
    rows are copies of each other.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, spans in zip(batch["t"], batch["_spans"]):
                t, runs = t.as_py() or b"", merged([(s["lo"], s["hi"]) for s in spans.as_py() or []])
                rest = kept_bytes(t, runs)
                out.append((len(t), len(t) - len(rest), len(runs), hashlib.sha256(rest).hexdigest()))
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch["row"], batch["key"], *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())],
                ["row", "key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    spans = repeated_spans(docs, row, key, text, keep_first, sent=sent, **options)
    rows = docs.select(F.col(row).alias("row"), F.col(key).alias("key"), F.col(text).cast("binary").alias("t"))
    kind = docs.schema[key].dataType.simpleString()
    return _with_spans(rows, "row", spans, "_spans", sent).select("row", "key", "t", "_spans").mapInArrow(
        lean(work), f"row long, key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, row: str, key: str, text: str, keep_first: bool = True, sent: int = SENT, **options) -> DataFrame:
    """``docs`` with the repeated parts cut out of ``text``, at whole characters; all
    other columns stay as they are."""
    name, at = fresh(docs, "_spans"), docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, at):
                columns = dict(zip(part.schema.names, part.columns))
                texts = []
                for t, spans in zip(columns[text].to_pylist(), columns.pop(name).to_pylist()):
                    if spans:
                        runs = merged([(s["lo"], s["hi"]) for s in spans])
                        t = kept_bytes(t.encode("utf-8", "surrogatepass"), runs, True).decode("utf-8", "replace")
                    texts.append(t)
                columns[text] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    spans = repeated_spans(docs, row, key, text, keep_first, sent=sent, **options)
    return _with_spans(docs, row, spans, name, sent).select(*docs.columns, name).mapInArrow(lean(work), docs.schema)
