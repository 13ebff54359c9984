"""Subword lattice likelihood of documents.

A marked word is written as a sequence of pieces of an existing vocabulary, in any
of its segmentations, or byte by byte.  A forward recursion in log space sums all
of them.  No piece crosses a word, so a document's probability is the product over
its words, and each distinct word of the corpus is computed once.

The vocabulary's scores start as p ~ 1 / (rank + 10), the rank being the order of
the existing scores; expected piece counts over all distinct training words
(forward-backward over the lattice) then give the scores that are used.  A whole
word seen in training is one more arc: P(w) = max(c - D, 0) / N + D V / N * L(w)
with L the lattice, c the word's count, N all tokens, V distinct ones, and D the
absolute discount n1 / (n1 + 2 n2).  All of it sums to one over all texts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from copy import copy

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.runtime import materialise
from .pieces import MODEL, SPACE, load

ROUNDS = 2                  # passes that re-estimate the scores
CLASSES = 8                 # labels told apart, the commonest ones
FREQUENT = 100_000          # words above 1/FREQUENT of all tokens are looked up without a shuffle: fewer than that
CHUNK = 400_000             # characters of words of about one length in hand at once
PRIOR = 0.01                # added to each piece's expected count
END = ""                    # the end of a text, counted as a token; no word is empty
CODE = 21                   # bits of a character
PAD = (1 << CODE) - 1       # no character has this number
MIX = np.uint64(0x9E3779B97F4A7C15)


class Lattice:
    """Pieces in a trie, whose edges (node, character) are a table of hash slots."""

    def __init__(self, pieces: list[str], log_p: np.ndarray, byte: float, stop: float):
        """``byte`` and ``stop``: log probabilities of one byte and of a word's end."""
        self._score(log_p, byte, stop)
        edges: dict[int, int] = {}                              # key of an edge -> its node
        ends: dict[int, int] = {}                               # node -> the piece that ends there
        for i, piece in enumerate(pieces):
            node = 0
            for c in piece:
                node = edges.setdefault(node << CODE | ord(c), len(edges) + 1)
            ends[node] = i
        self.shift = np.uint64(64 - (2 * len(edges) + 2).bit_length())
        self.keys = np.full(1 << 64 - int(self.shift), -1)
        self.nodes = np.zeros(len(self.keys), np.int64)
        for key, node in edges.items():
            slot = int(self._slots(np.array([key]))[0])
            while self.keys[slot] >= 0:
                slot = (slot + 1) % len(self.keys)
            self.keys[slot], self.nodes[slot] = key, node
        self.piece = np.full(len(edges) + 1, -1)
        self.piece[list(ends)] = list(ends.values())

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * MIX) >> self.shift).astype(np.int64)

    def _children(self, keys: np.ndarray) -> np.ndarray:
        """The nodes at the ends of edges, 0 where there is no such edge."""
        slots = self._slots(keys)
        there = self.keys[slots]
        found = np.where(there == keys, self.nodes[slots], 0)
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):                                       # the slot is another edge's: try the next one
            slots[open_] = (slots[open_] + 1) % len(self.keys)
            there = self.keys[slots[open_]]
            same = there == keys[open_]
            found[open_[same]] = self.nodes[slots[open_[same]]]
            open_ = open_[~same & (there >= 0)]
        return found

    def _score(self, log_p: np.ndarray, byte: float, stop: float) -> None:
        self.log_p, self.byte, self.stop = log_p, byte, stop

    def rescored(self, weight: np.ndarray, single: float, stop: float) -> Lattice:
        """The same pieces with scores from weights of pieces, of bytes in all, and of ends."""
        total = weight.sum() + single + stop
        other = copy(self)
        other._score(np.log(weight / total), math.log(single / 256 / total), math.log(stop / total))
        return other

    def _arcs(self, codes: np.ndarray) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For each end the arcs into it: (start, rows, pieces)."""
        columns = np.ascontiguousarray(codes.T)
        arcs = [[] for _ in columns]
        for start in range(len(columns)):
            rows, nodes = np.arange(len(codes)), np.zeros(len(codes), np.int64)
            for at in range(start, len(columns)):
                nodes = self._children(nodes << CODE | columns[at, rows])
                alive = nodes > 0
                rows, nodes = rows[alive], nodes[alive]
                if not len(rows):
                    break
                piece = self.piece[nodes]
                whole = piece >= 0
                if whole.any():
                    arcs[at].append((start, rows[whole], piece[whole]))
        return arcs

    def _forward(self, codes: np.ndarray, arcs: list, spelled: np.ndarray) -> np.ndarray:
        alpha = np.zeros((codes.shape[1] + 1, len(codes)))
        for end, into in enumerate(arcs, 1):
            alpha[end] = alpha[end - 1] + spelled[end - 1]
            for start, rows, piece in into:
                alpha[end, rows] = np.logaddexp(alpha[end, rows], alpha[start, rows] + self.log_p[piece])
        return alpha

    def log_probability(self, words: list[str]) -> np.ndarray:
        """Natural logarithm of the summed probability of all segmentations."""
        return log_probabilities([self], words)[0]

    def expected(self, words: list[str], counts: np.ndarray) -> tuple[np.ndarray, float]:
        """Expected uses of each piece, and of single bytes, over weighted words."""
        pieces, single = np.zeros(len(self.log_p)), 0.0
        for which, codes in _by_length(words):
            arcs, size, weight = self._arcs(codes), _utf8(codes).T, counts[which]
            spelled = self.byte * size
            alpha = self._forward(codes, arcs, spelled)
            beta = np.full(alpha.shape, -np.inf)
            beta[-1] = 0
            used, uses = [], []
            for end in range(codes.shape[1], 0, -1):
                share = np.exp(alpha[end - 1] + spelled[end - 1] + beta[end] - alpha[-1])
                single += float((share * weight * size[end - 1]).sum())
                beta[end - 1] = np.logaddexp(beta[end - 1], spelled[end - 1] + beta[end])
                for start, rows, piece in arcs[end - 1]:
                    through = self.log_p[piece] + beta[end, rows]
                    used.append(piece)
                    uses.append(np.exp(alpha[start, rows] + through - alpha[-1, rows]) * weight[rows])
                    beta[start, rows] = np.logaddexp(beta[start, rows], through)
            if used:
                pieces += np.bincount(np.concatenate(used), np.concatenate(uses), len(pieces))
        return pieces, single


def log_probabilities(lattices: list[Lattice], words: list[str]) -> np.ndarray:
    """A row for each of several scorings of the same pieces."""
    out = np.empty((len(lattices), len(words)))
    for which, codes in _by_length(words):
        arcs, size = lattices[0]._arcs(codes), _utf8(codes).T
        for k, lattice in enumerate(lattices):
            out[k, which] = lattice._forward(codes, arcs, lattice.byte * size)[-1] + lattice.stop
    return out


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of about the same length together, all ending in the last column; what is
    before a shorter word is ``PAD``, which is in no piece and has no bytes."""
    lengths = np.array([len(w) for w in words], np.int64)
    order = np.argsort(lengths, kind="stable")
    sizes = lengths[order]
    at = 0
    while at < len(order):
        end = int(np.searchsorted(sizes, sizes[at] * 5 // 4 + 3, side="right"))
        end = min(end, at + max(1, CHUNK // max(1, int(sizes[end - 1]))))
        which, width = order[at:end], int(sizes[end - 1])
        text = "".join([words[i].rjust(width, chr(0)) for i in which]).encode("utf-32-le", "surrogatepass")
        codes = np.frombuffer(text, "<u4").reshape(len(which), width).astype(np.int64)
        codes[np.arange(width) < (width - sizes[at:end])[:, None]] = PAD
        yield which, codes
        at = end


def _utf8(codes: np.ndarray) -> np.ndarray:
    return 1.0 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000) - 4.0 * (codes == PAD)


# --- corpus -------------------------------------------------------------------

def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def classes(docs: DataFrame, label: Column | None, held_out: Column) -> list[tuple[str | None, int]]:
    """The commonest labels of training texts and their numbers; all other texts
    and those without a label are the class None."""
    if label is None:
        return [(None, docs.filter(~held_out).count())]
    sizes = docs.filter(~held_out).groupBy(label.cast("string").alias("label")).agg(F.count("*").alias("n"))
    named = sizes.filter("label is not null").orderBy(F.desc("n"), "label").limit(CLASSES).collect()
    rest = (sizes.agg(F.sum("n")).first()[0] or 0) - sum(r.n for r in named)
    return [(r.label, r.n) for r in named] + [(None, rest)] * (rest > 0 or not named)


def word_counts(docs: DataFrame, text: Column, held_out: Column, kind: Column, kinds: int) -> DataFrame:
    """(word, n_all, c0, c1, ...): uses in all texts, and in the training texts of
    each class; the end is the word ''."""
    names = ["word", "n_all", *[f"c{k}" for k in range(kinds)]]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            every, train = Counter(), [Counter() for _ in range(kinds)]
            for t, held, k in zip(rows["t"], rows["held"], rows["k"]):
                found = tokens(t)
                every.update(found)
                every[b""] += 1
                if not held:
                    train[k].update(found)
                    train[k][b""] += 1
            words = list(every)
            counts = [np.fromiter((c[w] for w in words), np.int64, len(words)) for c in (every, *train)]
            yield pd.DataFrame(dict(zip(names, [[w.decode("utf-8", "replace") for w in words], *counts])))

    counted = docs.select(text.alias("t"), held_out.alias("held"), kind.alias("k")).mapInPandas(
        work, ", ".join(f"{c} {'string' if c == 'word' else 'long'}" for c in names))
    return counted.groupBy("word").agg(*[F.sum(c).alias(c) for c in names[1:]])


def train(counts: DataFrame, kinds: int = 1, path: str = MODEL, rounds: int = ROUNDS) -> list[Lattice]:
    """Re-estimate the existing scores, for each class on all its distinct training
    words in ``counts`` (word, c0, c1, ...).

    What reaches the driver is one number for each piece of the vocabulary and class.
    """
    vocabulary = load(path)
    pieces = vocabulary.pieces
    rank = np.argsort(np.argsort(-np.array(vocabulary.scores), kind="stable"))
    weight = 1.0 / (rank + 10)
    first = Lattice(pieces, weight, 0, 0).rescored(weight, float(weight.min()) * 256, float(weight.sum()) / 4)
    lattices = [first] * kinds
    each = [f"c{k}" for k in range(kinds)]
    words = counts.filter(F.col("word") != END).filter(" or ".join(f"{c} > 0" for c in each)).select("word", *each)
    for _ in range(rounds):
        def work(batches: Iterator[pd.DataFrame], lattices: list[Lattice] = lattices) -> Iterator[pd.DataFrame]:
            totals = np.zeros((kinds, len(pieces) + 2))         # pieces, bytes, ends
            for rows in batches:
                for k, c in enumerate(each):
                    own = [SPACE + w for w in rows["word"][rows[c] > 0]]
                    some, single = lattices[k].expected(own, np.ones(len(own)))
                    totals[k, :-2] += some
                    totals[k, -2:] += single, len(own)
            kind, piece = np.nonzero(totals)
            yield pd.DataFrame({"kind": kind, "piece": piece, "uses": totals[kind, piece]})

        uses = np.zeros((kinds, len(pieces) + 2))
        found = words.mapInPandas(work, "kind int, piece int, uses double").groupBy("kind", "piece").agg(F.sum("uses").alias("uses"))
        found = found.toPandas()
        uses[found["kind"], found["piece"]] = found["uses"]
        lattices = [first.rescored(u[:-2] + PRIOR, u[-2] + PRIOR * 256, u[-1] + PRIOR) for u in uses]
    return lattices


def score(docs: DataFrame, key: str, text: str, held_out: Column, label: Column | None = None, path: str = MODEL) -> DataFrame:
    """(row, key, held_out, n_tokens, n_known, train_tokens, base_score, score) per row.

    With a ``label`` of the training texts, such as their language, the score sums
    over the classes it gives; the label of a text is no input of its score.  A null
    text counts as empty and consists of its end alone.  Repeated rows give a result
    each.  With no training text every word is scored by the lattice.
    """
    named = classes(docs, label, held_out)
    kinds, prior = len(named), [math.log10(max(n, 1) / max(1, sum(n for _, n in named))) for _, n in named]
    kind = F.lit(kinds - 1)
    for k, (value, _) in enumerate(named):
        if value is not None:
            kind = F.when(label.cast("string") == value, k).otherwise(kind)
    each = [f"c{k}" for k in range(kinds)]
    counts = word_counts(docs, F.col(text), held_out, kind, kinds).withColumn("n", F.expr(" + ".join(each)))
    counts = materialise(counts)
    facts = counts.agg(F.sum("n"), *[F.count_if(F.expr(e)) for e in ("n > 0", "n = 1", "n = 2")], F.sum("n_all"),
                       *[x for c in each for x in (F.sum(c), F.count_if(F.col(c) > 0))]).first()
    n, v, n1, n2, n_all, *by_kind = [x or 0 for x in facts]
    discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    lattices = train(counts, kinds, path)
    scores = [f"s{k}" for k in range(kinds)]

    def discounted(count: np.ndarray, total: int, distinct: int, below: np.ndarray) -> np.ndarray:
        """Logarithm of the discounted share of ``count``, and the rest of ``total`` times ``below``."""
        if not total:
            return below
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(np.maximum(count - discount, 0) / total), math.log(discount * distinct / total) + below)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            end = (rows["word"] == END).to_numpy()
            spelled = log_probabilities(lattices, [SPACE + w for w in rows["word"]])
            spelled = np.where(end, -np.inf if n else math.log(0.5), spelled if n else spelled + math.log(0.5))
            common = [discounted(rows["n"].to_numpy(), n, v, x) for x in spelled]
            yield pd.DataFrame({"word": rows["word"], "n": rows["n"], "n_all": rows["n_all"],
                                **{s: (discounted(rows[c].to_numpy(), by_kind[2 * k], by_kind[2 * k + 1], common[k]) / math.log(10))
                                   for k, (s, c) in enumerate(zip(scores, each))}})

    weighed = materialise(counts.mapInPandas(weigh, "word string, n long, n_all long, " + ", ".join(f"{s} double" for s in scores)))
    frequent = weighed.filter((F.col("n_all") * FREQUENT > n_all) | (F.col("word") == END)).toPandas()     # fewer than FREQUENT words
    total = n + v + 1
    look = {w.encode("utf-8"): i for i, w in enumerate(frequent["word"])}
    facts = np.column_stack([frequent["n"] > 0, np.log10((frequent["n"] + 1) / total), frequent[scores]]).astype(np.float64)
    shared = docs.sparkSession.sparkContext.broadcast((look, facts))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text, with the sums over frequent words, and one for each of its other words."""
        look, facts = shared.value
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                ids = part["row"].to_pylist()
                words, uses, owner, sums = [], [], [], []
                for row, t in zip(ids, part["t"].to_pylist()):
                    found = Counter(tokens(t))
                    found[b""] = 1
                    before, which, times = len(words), [], []
                    for w, c in found.items():
                        i = look.get(w)
                        if i is None:
                            words.append(w)
                            uses.append(c)
                        else:
                            which.append(i)
                            times.append(c)
                    owner += [row] * (len(words) - before)
                    sums.append((found.total(), *(np.array(times) @ facts[which]).tolist()))
                yield _batch(ids, [f"\t{row}" for row in ids], [1] * len(ids), part["key"], part["held"], list(zip(*sums)))
                if words:
                    yield _batch(owner, [w.decode("utf-8", "replace") for w in words], uses,
                                 pa.nulls(len(words), part["key"].type), [None] * len(words), [[None] * len(words)] * (3 + kinds))

    def _batch(row, word, uses, key, held, sums) -> pa.RecordBatch:
        """One text or one word of a text a row; a text's own ``word`` starts with a tab, which no word holds."""
        columns = [pa.array(c, pa.int64() if i == 0 else pa.float64()) for i, c in enumerate(sums)]
        return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(word, pa.string()), pa.array(uses, pa.int64()), key,
                                           pa.array(held, pa.bool_()), *columns],
                                          ["row", "word", "uses", "key", "held", "n_tokens", "n_known", "base", *[f"t{k}" for k in range(kinds)]])

    wide = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("t"),
                       held_out.alias("held"))
    rows = wide.mapInArrow(spread, f"row long, word string, uses long, key {docs.schema[key].dataType.simpleString()}, held boolean, "
                                   "n_tokens long, n_known double, base double, " + ", ".join(f"t{k} double" for k in range(kinds)))
    joined = rows.join(weighed.drop("n_all").hint("shuffle_hash"), "word", "left")
    text_row, uses = F.col("n_tokens").isNotNull(), F.col("uses")
    either = lambda own, other: F.sum(F.when(text_row, own).otherwise(uses * other))
    summed = joined.groupBy("row").agg(
        F.max(F.when(text_row, F.struct("key", "held", "n_tokens"))).alias("t"),
        either(F.col("n_known"), F.when(F.col("n") > 0, 1).otherwise(0)).cast("long").alias("n_known"),
        either(F.col("base"), F.log10((F.col("n") + 1) / F.lit(float(total)))).alias("base_score"),
        *[(either(F.col(f"t{k}"), F.col(s)) + prior[k]).alias(s) for k, s in enumerate(scores)])
    best = F.greatest(*scores) if kinds > 1 else F.col(scores[0])
    mixed = best + F.log10(sum((F.pow(F.lit(10.0), F.col(s) - best) for s in scores[1:]), F.pow(F.lit(10.0), F.col(scores[0]) - best)))
    return summed.select("row", F.col("t.key").alias("key"), F.col("t.held").alias("held_out"), "t.n_tokens", "n_known",
                         F.lit(n).cast("long").alias("train_tokens"), "base_score", mixed.alias("score"))
