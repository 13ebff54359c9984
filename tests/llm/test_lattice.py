import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandscape.llm import lattice as L
from bandscape.llm.pieces import SPACE, load


def slow(word, p, byte, stop):
    total = [1.0] + [0.0] * len(word)
    for e in range(1, len(word) + 1):
        total[e] = total[e - 1] * byte ** len(word[e - 1].encode())
        for j in range(e):
            total[e] += total[j] * p.get(word[j:e], 0.0)
    return total[-1] * stop


def enumerate_(word, p, byte):
    if not word:
        return [((), 1.0)]
    out = [((None,) + s, q * byte ** len(word[0].encode())) for s, q in enumerate_(word[1:], p, byte)]
    for j in range(1, len(word) + 1):
        if word[:j] in p:
            out += [((word[:j],) + s, q * p[word[:j]]) for s, q in enumerate_(word[j:], p, byte)]
    return out


PIECES = {"a": .1, "b": .1, "ab": .2, "ba": .05, "aba": .1, "é": .02, SPACE: .05, SPACE + "a": .1}


def model():
    return L.Lattice(list(PIECES), np.log(list(PIECES.values())), math.log(0.001), math.log(0.2))


def test_sums_all_segmentations():
    words = ["a", "ab", "abab", "ababa", "xé", "日", SPACE + "aba", "ab" * 30, "z"]
    got = np.exp(model().log_probability(words))
    assert np.allclose(got, [slow(w, PIECES, 0.001, 0.2) for w in words], rtol=1e-9)
    for w in words[:6]:
        assert math.isclose(slow(w, PIECES, 0.001, 1), sum(q for _, q in enumerate_(w, PIECES, 0.001)))


def test_expected_uses():
    words, weight = ["ababa", "xa", "é日"], np.array([1.0, 3.0, 2.0])
    uses, single = model().expected(words, weight)
    want, bytes_ = Counter(), 0.0
    for w, c in zip(words, weight):
        all_ = enumerate_(w, PIECES, 0.001)
        z = sum(q for _, q in all_)
        for s, q in all_:
            at = 0
            for piece in s:
                size = 1 if piece is None else len(piece)
                if piece is None:
                    bytes_ += c * q / z * len(w[at].encode())
                else:
                    want[piece] += c * q / z
                at += size
    assert np.allclose(uses, [want[p] for p in PIECES]) and math.isclose(single, bytes_)


def is_held():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2, F.lit(False))


def test_documents(spark):
    rng = np.random.default_rng(0)
    vocabulary = ["the", "of", "Ände", "tion", "x" * 40] + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(vocabulary, 30))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "NEW new\tNew"), (62, "NEW new\tNew"), (None, "the the"), (63, "the of 　"),
             (64, "word " * 3000)]
    docs = spark.createDataFrame([(d, t, [None, "x", "y"][i % 3], "c") for i, (d, t) in enumerate(rows)],
                                 "doc_id long, text string, n string, word string")
    got = L.score(docs, "doc_id", "text", is_held(), F.col("n")).collect()
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    counts = Counter()
    for (_, t), h in zip(rows, held):
        if not h:
            counts.update(L.tokens(t))
            counts[b""] += 1
    n, v = sum(counts.values()), len(counts)
    want = []
    for (d, t), h in zip(rows, held):
        own = [*L.tokens(t), b""]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        want.append((d, h, len(own), sum(counts[w] > 0 for w in own), n, round(base, 6)))
    assert sorted([(r.key, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got], key=repr) == sorted(want, key=repr)
    assert all(-1e5 < r.score < 0 for r in got)
    by = {r.key: r.score / r.n_tokens for r in got}
    assert by[64] > by[62]


def test_score_is_the_mixture_of_discounted_words(spark):
    rng = np.random.default_rng(1)
    vocabulary = ["the", "of", "Ände", "tion", "日本", "x" * 40] + [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(vocabulary, 1 + i % 20)), [None, "x", "y", "y"][i % 4]) for i in range(80)]
    rows += [(80, None, "x"), (81, "", None), (82, "unseen words", "x"), (82, "unseen words", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    named = L.classes(docs, F.col("lang"), is_held())
    own = [name for name, _ in named]
    held = [zlib.crc32(str(d).encode()) % 7 == 2 for d, _, _ in rows]
    counts = [Counter() for _ in own]
    for (_, t, lang), h in zip(rows, held):
        if not h:
            counts[own.index(lang)].update([w.decode() for w in L.tokens(t)] + [L.END])
    every = sum(counts, Counter())
    n, v = every.total(), len(every)
    n1, n2 = (sum(c == i for c in every.values()) for i in (1, 2))
    discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    table = spark.createDataFrame([(w, *[c[w] for c in counts]) for w in every],
                                  "word string, " + ", ".join(f"c{k} long" for k in range(len(own))))
    pieces = load().pieces
    ways = [({p: math.exp(x) for p, x in zip(pieces, m.log_p)}, math.exp(m.byte), math.exp(m.stop)) for m in L.train(table, len(own))]

    def word(w, k):
        below = 0 if w == L.END else slow(SPACE + w, *ways[k])
        below = max(every[w] - discount, 0) / n + discount * v / n * below
        c = counts[k]
        return max(c[w] - discount, 0) / c.total() + discount * len(c) / c.total() * below

    texts = sum(size for _, size in named)
    want = []
    for d, t, _ in rows:
        words = [w.decode() for w in L.tokens(t)] + [L.END]
        logs = [math.log10(size / texts) + sum(math.log10(word(w, k)) for w in words) for k, (_, size) in enumerate(named)]
        want.append((d, max(logs) + math.log10(sum(10 ** (x - max(logs)) for x in logs))))
    got = sorted((r.key, r.score) for r in L.score(docs, "doc_id", "text", is_held(), F.col("lang")).collect())
    assert [d for d, _ in got] == [d for d, _ in sorted(want)]
    assert np.allclose([s for _, s in got], [s for _, s in sorted(want)], rtol=1e-9)


def test_long_words_beside_short_ones():
    words = ["a", "", "ab" * 400, "b", "abx", "ab" * 399 + "é"]
    got = model().log_probability(words)
    assert np.allclose(np.exp(got[[0, 1, 3, 4]]), [slow(words[i], PIECES, 0.001, 0.2) for i in (0, 1, 3, 4)], rtol=1e-9)
    assert all(got[i] == model().log_probability([words[i]])[0] for i in range(len(words)))


def test_probabilities_sum_to_less_than_one(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "a", "b a", "ab a", "b"] * 3)], "doc_id long, text string")
    probe = [(100, ""), *[(101 + i, t) for i, t in enumerate(["a", "b", "ab", "c", "a b", "a a", "b a", "b b", "ab ab"])]]
    every = docs.unionByName(spark.createDataFrame(probe, "doc_id long, text string"))
    for label in (None, (F.col("doc_id") % 2).cast("string")):
        got = L.score(every, "doc_id", "text", F.col("doc_id") >= 100, label).filter("held_out").collect()
        assert 0.2 < sum(10 ** r.score for r in got) < 1


def test_held_out_texts_are_likelier_than_under_the_base(spark):
    from bandscape.llm.workload import QUERIES
    got = QUERIES["op1_lattice"](spark, "/root/testdata/sf0.1").toPandas()         # enough text for the words to recur
    held = got[got.held_out]
    assert len(got) == 10_000 and held.score.sum() > held.base_score.sum()


@pytest.mark.parametrize("held", [True, False])
def test_without_texts(spark, held):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert L.score(none, "doc_id", "text", F.lit(held)).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    got = L.score(one, "doc_id", "text", F.lit(held)).collect()
    assert got[0].n_tokens == 3 and got[0].n_known == (0 if held else 3) and got[0].score < 0
