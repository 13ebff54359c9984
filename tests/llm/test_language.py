import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from bandscape.llm import language as L
from bandscape.llm.workload import QUERIES


def slow_model(lines):
    """Textbook recursion over dictionaries."""
    counts = [None] * (L.ORDER + 1)
    counts[L.ORDER] = Counter((L.PAD + x + " ")[i:i + L.ORDER] for x in lines for i in range(len(x) + 1))
    for n in range(L.ORDER - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    stats, discounts = [None] * (L.ORDER + 1), [None] * (L.ORDER + 1)
    for n in range(1, L.ORDER + 1):
        once, twice = (sum(c == k for c in counts[n].values()) for k in (1, 2))
        discounts[n] = once / (once + 2 * twice) if once and twice else 0.5
        stats[n] = defaultdict(lambda: [0, 0])
        for g, c in counts[n].items():
            stats[n][g[:-1]][0] += c
            stats[n][g[:-1]][1] += 1

    def p(g):
        if not g:
            return 1 / L.ALPHABET
        n = len(g)
        if g[:-1] not in stats[n]:
            return p(g[1:])
        total, kinds = stats[n][g[:-1]]
        return max(counts[n][g] - discounts[n], 0) / total + discounts[n] * kinds / total * p(g[1:])
    return p


LINES = ["the cat sat on the mat", "the dog and the cat", "thée öre"]


def tables(lines):
    counts = Counter((L.PAD + x + " ")[i:i + L.ORDER] for x in lines for i in range(len(x) + 1))
    grams = sorted(counts)
    orders = L.fit(L._codes("".join(grams)).reshape(-1, L.ORDER), np.array([counts[g] for g in grams]))
    return [a.tobytes() for o in orders for a in o]


@pytest.mark.parametrize("chars", [1 << 21, 7])
def test_model_equals_textbook(monkeypatch, chars):
    monkeypatch.setattr(L, "CHARS", chars)
    p, model = slow_model(LINES), L.Model({"xx": tables(LINES)})
    texts = ["The mat!", "zebra 12 q", "", None, "123", "öre thé", "a" * 50]
    sizes, sums = model.entropies(texts)
    for text, n, total in zip(texts, sizes, sums[0]):
        line = L.letters(text)
        padded = L.PAD + line + " "
        want = -sum(math.log(p(padded[i:i + L.ORDER])) for i in range(len(line) + 1)) if line else 0
        assert n == (len(line) + 1 if line else 0) and math.isclose(total, want, abs_tol=1e-9)


def test_probabilities_sum_to_one():
    model, seen = L.Model({"xx": tables(LINES)}), sorted(set("".join(LINES) + " "))
    for context in ("    ", "the ", "zzzz", " cat"):
        grams = L._codes("".join(context + c for c in [*seen, "~"])).reshape(-1, L.ORDER)
        p = np.exp(L.log_probability(model.orders[0], grams))
        assert math.isclose(p[:-1].sum() + p[-1] * (L.ALPHABET - len(seen)), 1)


def test_held_out_accuracy_and_rejection(spark):
    rows = QUERIES["op3_language"](spark, DATA).toPandas()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang", "text").toPandas()
    both = rows.merge(docs, on="doc_id")
    assert len(both) == len(docs)
    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) for d, h in zip(both.doc_id, both.held_out))
    held = both[both.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95 and both.score.between(0, 1).all()


def test_edge_cases(spark):
    english, german = "the cat sat on the mat and the dog ran ", "der hund und die katze sind auf der matte "
    rows = [(i, english * 3, "en") for i in range(90)] + [(100 + i, german * 3, "de") for i in range(90)]
    rows += [(300, None, "en"), (301, "", "de"), (302, "123 ... ²½", None), (303, "Die Katze", None), (304, "漢字かな" * 80, None),
             (305, "the dog", None), (None, "the dog", "en"), (305, "the dog", None), (306, english * 3000, None)]
    docs = spark.createDataFrame([(d, t, x, 1, 2) for d, t, x in rows], "doc_id long, text string, lang string, n int, held int")
    got = L.identify(docs, F.lit(False)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and by[i].rejected for i in (300, 301, 302))
    assert by[303].lang_pred == "de" and by[305].lang_pred == by[306].lang_pred == "en" and not by[306].rejected
    assert by[304].rejected and by[304].lang_pred in ("de", "en")
    assert not any(by[i].rejected for i in range(90))
    assert L.identify(docs.limit(0), F.lit(False)).count() == 0
    assert {r.lang_pred for r in L.identify(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(False)).collect()} == {"und"}


def test_clean_long_texts_stay(spark):
    docs = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text", "lang")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    model = L.train(docs.filter(~held), "text", "lang", F.col("doc_id"))
    clean = [r.text for r in docs.filter(held & (F.col("lang") == "en") & (F.length("text") >= 400)).orderBy("doc_id").limit(40).collect()]
    passages = [t[:400] + " " for t in clean]
    assert len(passages) == 40 and not model.predict(passages).rejected.any()
    for passage in passages:
        assert not model.predict([passage * 2500]).rejected.any(), passage
    noise = "".join(np.random.default_rng(1).choice(list("abcdefghijklmnopqrstuvwxyz "), 1_000_000))
    assert model.predict([noise, noise[:1000], "漢字かな" * 250_000]).rejected.all()
