"""Language identification with interpolated Kneser-Ney character models.

Each language has a model of character n-grams in sorted hash arrays.  A text gets
the language of lowest cross-entropy per character, and is rejected if even that
is higher than texts of the language have, by a calibrated margin.

The models are fitted on at most about ``FIT`` characters of labelled texts a
language, chosen by a hash of the row, and calibrated on others; that bounds what
is sent to the tasks.  Every text is scored whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.runtime import materialise
from .common import lean, portions

ORDER = 5
FIT = 2_000_000             # characters fitted for a language
CALIBRATE = 1_000_000       # characters calibrated with
SHARE = 0.8                 # of a language's texts may be fitted, the others calibrate
LEAST = 50                  # texts of a language without which nothing is rejected
OUTLIER = 0.999             # share of calibration texts that lie within ...
MARGIN = 2.0                # ... a limit, which is then widened by this factor
FLOOR = 8.0                 # least limit, in standard deviations
LEAST_DEVIATION = 0.25      # of a character, in nats
ALPHABET = 65_536           # characters of the uniform distribution below the unigrams
CHARS = 1 << 19             # characters in hand at once
UNKNOWN = "und"

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
PAD = " " * (ORDER - 1)
BASE = np.uint64(0x9E3779B97F4A7C15)


def letters(text: str | None) -> str:
    """Words of letters in lower case with single spaces; empty without letters."""
    return " ".join(WORD.findall(text.lower())) if text else ""


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def hashes(grams: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of characters."""
    out = np.full(len(grams), 7, np.uint64)
    for i in range(grams.shape[1]):
        out = (out ^ (grams[:, i].astype(np.uint64) + np.uint64(1))) * BASE
        out ^= out >> np.uint64(29)
    return out


# --- fitting -----------------------------------------------------------------

class Order(NamedTuple):
    """Sorted hashes of seen n-grams with log probabilities, and of their contexts with back-off weights."""

    grams: np.ndarray
    log_p: np.ndarray
    contexts: np.ndarray
    back_off: np.ndarray


def fit(grams: np.ndarray, counts: np.ndarray) -> list[Order]:
    """Orders 1 to n from the distinct n-grams (rows of characters) and their counts.

    Lower orders count the distinct characters seen in front, as Kneser and Ney do.
    """
    levels = []
    while grams.shape[1]:
        levels.append((grams, counts))
        shorter, counts = np.unique(grams[:, 1:], axis=0, return_counts=True)
        grams = shorter
    orders: list[Order] = []
    for grams, counts in reversed(levels):
        once, twice = (counts == 1).sum(), (counts == 2).sum()
        discount = once / (once + 2 * twice) if once and twice else 0.5
        contexts, which = np.unique(hashes(grams[:, :-1]), return_inverse=True)
        total, kinds = np.bincount(which, counts), np.bincount(which)
        gamma = discount * kinds / total
        p = (counts - discount) / total[which] + gamma[which] * np.exp(log_probability(orders, grams[:, 1:]))
        key = hashes(grams)
        order = np.argsort(key)
        orders.append(Order(key[order], np.log(p[order]), contexts, np.log(gamma)))
    return orders


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def log_probability(orders: list[Order], grams: np.ndarray) -> np.ndarray:
    """Of each row's last character after the others, backing off to shorter contexts."""
    out, waiting = np.zeros(len(grams)), np.arange(len(grams))
    for n in range(len(orders), 0, -1):
        own = grams[waiting, grams.shape[1] - n:]
        at, found = _find(orders[n - 1].grams, hashes(own))
        out[waiting[found]] += orders[n - 1].log_p[at[found]]
        waiting, own = waiting[~found], own[~found]
        at, found = _find(orders[n - 1].contexts, hashes(own[:, :-1]))
        out[waiting[found]] += orders[n - 1].back_off[at[found]]
    out[waiting] -= math.log(ALPHABET)
    return out


def _gram_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        for lang, texts in rows.groupby("lang")["t"]:
            counts: Counter[str] = Counter()
            for t in texts:
                if line := letters(t):
                    line = PAD + line + " "
                    for at in range(0, len(line), CHARS):
                        counts.update(line[i:i + ORDER] for i in range(at, min(at + CHARS, len(line) - ORDER + 1)))
            if counts:
                yield pd.DataFrame({"lang": [lang] * len(counts), "gram": list(counts), "n": list(counts.values())})


def _fitted(lang: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("gram")
    orders = fit(_codes("".join(rows["gram"])).reshape(-1, ORDER), rows["n"].to_numpy())
    return pd.DataFrame({"lang": [lang[0]], "arrays": [[a.tobytes() for o in orders for a in o]]})


class Model:
    def __init__(self, tables: dict[str, list[bytes]], limits: dict[str, tuple[float, float, float, float]] | None = None):
        """``limits``: for each language mean and deviation of a character's cross-entropy, the
        largest sum of deviations, in standard deviations, of a text that is kept, and the
        characters that a text counts for at most."""
        self.languages, self.limits = sorted(tables), limits or {}
        kinds = ("<u8", "<f8", "<u8", "<f8")
        self.orders = [[Order(*[np.frombuffer(b, k) for b, k in zip(tables[x][i:i + 4], kinds)])
                        for i in range(0, len(tables[x]), 4)] for x in self.languages]

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Characters of each text, and per language the sum of their negative log probabilities."""
        sizes, sums = np.zeros(len(texts), np.int64), np.zeros((len(self.languages), len(texts)))
        lines, owners, held = [], [], 0
        for i, text in enumerate(texts):
            line = letters(text)
            sizes[i] = len(line) + 1 if line else 0
            line = PAD + line + " " if line else ""
            for at in range(0, len(line) - ORDER + 1, CHARS):
                lines.append(line[at:at + CHARS + ORDER - 1])
                owners.append(i)
                held += len(lines[-1])
                if held >= CHARS:
                    self._add(lines, owners, sums)
                    lines, owners, held = [], [], 0
        if lines:
            self._add(lines, owners, sums)
        return sizes, sums

    def _add(self, lines: list[str], owners: list[int], sums: np.ndarray) -> None:
        windows = np.lib.stride_tricks.sliding_window_view(_codes("".join(lines)), ORDER)
        starts = np.cumsum([0, *map(len, lines)])[:-1]
        keep = np.ones(len(windows), bool)
        for i in range(1, ORDER):                               # windows across two lines
            keep[(starts[1:] - i)] = False
        windows = windows[keep]
        firsts = starts - np.arange(len(starts)) * (ORDER - 1)
        which, distinct = pd.factorize(hashes(windows))
        sample = np.empty(len(distinct), np.int64)
        sample[which[::-1]] = np.arange(len(which))[::-1]
        grams = windows[sample]
        for k, orders in enumerate(self.orders):
            np.add.at(sums[k], owners, np.add.reduceat(-log_probability(orders, grams)[which], firsts))

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        """lang_pred, score, cross_entropy, deviation, rejected for each text."""
        sizes, sums = self.entropies(texts)
        known = (sizes > 0) & bool(self.languages)
        if not self.languages:
            sums = np.zeros((1, len(texts)))
        best = sums.argmin(0)
        low = sums[best, np.arange(len(texts))]
        entropy = low / np.maximum(sizes, 1)
        limits = np.array([self.limits.get(x, (0.0, 1.0, np.inf, 1.0)) for x in self.languages] or [(0.0, 1.0, np.inf, 1.0)])
        mean, deviation, limit, most = limits[best].T
        z = (entropy - mean) * np.sqrt(sizes * most / (sizes + most)) / deviation
        names = np.array([*self.languages, UNKNOWN], object)
        return pd.DataFrame({"lang_pred": names[np.where(known, best, len(self.languages))],
                             "score": np.where(known, 1 / np.exp(low - sums).sum(0), 0.0), "n": sizes,
                             "cross_entropy": np.where(known, entropy, np.nan), "rejected": ~known | (z > limit)})


def train(docs: DataFrame, text: str, lang: str, row: Column, chars: int = FIT) -> Model:
    """A calibrated model from all labelled rows of ``docs``; ``row`` is hashed to choose among them."""
    labelled = docs.select(F.col(text).alias("t"), F.col(lang).alias("lang"),
                           (F.pmod(F.xxhash64(row, F.lit("fit")), F.lit(1 << 30)) / (1 << 30)).alias("u"))
    labelled = labelled.filter("t is not null and lang is not null")
    totals = labelled.groupBy("lang").agg(F.count("*").alias("texts"), F.sum(F.char_length("t")).alias("chars"))
    plan = F.broadcast(materialise(totals))                     # a row a language
    chosen = labelled.join(plan, "lang").withColumns({
        "share": F.when(F.col("texts") < LEAST, 1.0).otherwise(SHARE),
        "fit": F.least(F.lit(1.0), F.lit(float(chars)) / (F.col("chars") + 1)),
        "test": F.least(F.lit(1.0), F.lit(float(CALIBRATE)) / (F.col("chars") * (1 - SHARE) + 1))})
    picked = chosen.filter(F.when(F.col("u") < F.col("share"), F.col("u") < F.col("share") * F.col("fit"))
                           .otherwise(F.col("u") < F.col("share") + (1 - F.col("share")) * F.col("test")))
    picked = materialise(picked.select("t", "lang", "texts", (F.col("u") >= F.col("share")).alias("held")))
    counts = picked.filter("not held").select("t", "lang").mapInPandas(lean(_gram_counts), "lang string, gram string, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    tables = counts.groupBy("lang").applyInPandas(_fitted, "lang string, arrays array<binary>").collect()
    model = Model({r.lang: list(r.arrays) for r in tables})
    return Model({r.lang: list(r.arrays) for r in tables}, _limits(model, picked.filter("held")))


def _limits(model: Model, held: DataFrame) -> dict[str, tuple[float, float, float, float]]:
    """Calibration: how far texts of a language stray from its mean cross-entropy.

    A text of n characters is then judged as one of nm / (n + m), with m the mean
    length of the calibration texts: variance between texts does not vanish with
    length, so clean texts far longer than those stay.
    """
    scored = materialise(predict(held.select("lang", "t"), model, ["lang"], "t").filter("lang = lang_pred"))
    mean = scored.groupBy("lang").agg((F.sum(F.col("cross_entropy") * F.col("n")) / F.sum("n")).alias("mean"), F.avg("n").alias("most"))
    off = scored.join(F.broadcast(mean), "lang").withColumn("off", (F.col("cross_entropy") - F.col("mean")) * F.sqrt("n"))
    deviation = F.greatest(F.sqrt(F.avg(F.col("off") * F.col("off"))), F.lit(LEAST_DEVIATION))
    off = off.groupBy("lang", "mean", "most").agg(deviation.alias("deviation"), F.percentile("off", F.lit(OUTLIER)).alias("far"), F.count("*").alias("texts"))
    return {r.lang: (r["mean"], r.deviation, max(FLOOR, MARGIN * r.far / r.deviation) if r.texts >= LEAST * (1 - SHARE) else np.inf, r.most)
            for r in off.collect()}


def predict(docs: DataFrame, model: Model, keep: list[str], text: str) -> DataFrame:
    """``keep`` columns, lang_pred, score, n, cross_entropy, rejected for every row.

    A text that is null or has no letter is ``und`` with score 0, and rejected.
    Ties go to the language first in order.  ``score`` is the posterior of the
    predicted language under equal priors.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)    # size bounded by the fitted characters
    # The text is sent once, also where it is kept.
    at = keep.index(text) if text in keep else len(keep)
    sent = docs.select(*keep) if text in keep else docs.select(*keep, F.col(text).alias("_t"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, at):
                found = shared.value.predict(part.column(at).to_pylist())
                kinds = (pa.string(), pa.float64(), pa.int64(), pa.float64(), pa.bool_())
                added = [pa.array(found[c].to_numpy(), k, from_pandas=True) for c, k in zip(found.columns, kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns[:len(keep)], *added],
                                                 [*part.schema.names[:len(keep)], *found.columns])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return sent.mapInArrow(
        lean(work), f"{kinds}, lang_pred string, score double, n long, cross_entropy double, rejected boolean")


def identify(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, held_out, lang_pred, score, n, cross_entropy, rejected) for every row of
    ``docs``, learnt from the labelled rows that are not held out."""
    model = train(docs.filter(~held_out), text, lang, F.col(key))
    keyed = docs.select(F.col(key).alias("key"), held_out.alias("held_out"), F.col(text).alias("t"))
    return predict(keyed, model, ["key", "held_out"], "t").withColumnRenamed("key", key)
