import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from bandscape.llm import repeats as R
from bandscape.llm.common import numbered


def slow(texts, span, first=False):
    data = [(t or "").encode() for t in texts]
    seen = defaultdict(list)
    for i, d in enumerate(data):
        for s in range(len(d) - span + 1):
            seen[d[s:s + span]].append((i, s))
    out = []
    for i, d in enumerate(data):
        gone = bytearray(len(d))
        for s in range(len(d) - span + 1):
            places = seen[d[s:s + span]]
            if len(places) > 1 and not (first and places[0] == (i, s)):
                gone[s:s + span] = b"\1" * span
        rest = bytes(b for b, g in zip(d, gone) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(d), sum(gone), runs, hashlib.sha256(rest).hexdigest()))
    return out


def corpus(seed, n=60, letters="ab cdéf"):
    rng = np.random.default_rng(seed)
    text = lambda k: "".join(rng.choice(list(letters), k))
    shared = [text(int(rng.integers(15, 120))) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = [text(int(rng.integers(0, 60))) for _ in range(int(rng.integers(0, 4)))]
        parts += [shared[i] for i in rng.integers(0, 6, int(rng.integers(0, 3)))]
        rng.shuffle(parts)
        out.append("".join(parts))
    out += [out[0], out[0], None, "", None, "aaaaaaaaaa" * 30, "abababab" * 20, "babababa" * 9, "a" * 19, "a" * 20, "zq" * 10,
            *["".join(rng.choice(list("uvwxyz"), k)) * int(60 / k) for k in (2, 3, 5, 7, 11, 13, 17, 19, 21, 29)], "Heer " * 30 + "Ab " * 20]
    return out


@pytest.mark.parametrize("seed,first,crowded,most,sent", [(0, False, 2000, 10**6, 10**6), (1, True, 2000, 10**6, 0), (2, False, 1, 10**6, 0),
                                                          (3, True, 1, 10**6, 10**6), (4, False, 2000, 60, 10**6), (5, True, 2000, 60, 0)])
def test_equals_brute_force(spark, monkeypatch, seed, first, crowded, most, sent):
    monkeypatch.setattr(R, "CHUNK", 64)
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, 1, "n") for i, t in enumerate(texts)], "doc_id long, text string, lo int, row string")
    docs = numbered(docs, "_row")
    got = R.digest(docs, "_row", "doc_id", "text", first, span=20, gram=8, crowded=crowded, most=most, sent=sent).collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sorted(got, key=lambda r: r.key)] == slow(texts, 20, first)


def test_long_texts_at_full_width(spark):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefgh"), 7)) for _ in range(4000)]
    texts = [" ".join(rng.choice(words, 400)) for _ in range(8)]
    texts += [texts[0][:1500] + texts[1][700:1900], texts[2][5:204], texts[2][5:205], "x" + texts[3], texts[4][:300] * 2]
    docs = numbered(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "_row")
    for first in (False, True):
        got = R.digest(docs, "_row", "doc_id", "text", first).collect()
        assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sorted(got, key=lambda r: r.key)] == slow(texts, 200, first)


def test_long_periodic_texts_among_many(spark):
    texts = ["-" * 400_000, "-" * 250_000 + "x", "ab" * 150_000, "-" * 150, "-" * 200, "plain", *["-" * (199 + i) for i in range(40)]]
    docs = numbered(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "_row")
    got = {r.key: (r.n_removed, r.n_spans) for r in R.digest(docs, "_row", "doc_id", "text").collect()}
    want = [(len(t), 1) if len(t) >= 200 and t[0] in "-a" else (0, 0) for t in texts]
    want[1] = (250_000, 1)
    assert [got[i] for i in range(len(texts))] == want


def test_earlier_and_later_matches():
    rng = np.random.default_rng(1)
    for _ in range(30):
        parts = [bytes(rng.integers(97, 99, int(k)).astype(np.uint8)) for k in rng.integers(9, 30, 6)]
        windows = [[p[i:i + 9] for i in range(len(p) - 8)] for p in parts]
        line = [w for part in windows for w in part]
        for first, hits in [(False, [line.count(w) > 1 for w in line]), (True, [w in line[:i] for i, w in enumerate(line)])]:
            assert np.concatenate(R.repeated_windows(parts, 9, first)).tolist() == hits


def test_suffix_order_and_longest_previous():
    rng = np.random.default_rng(0)
    for span in (8, 9, 20, 31, 200):
        data = rng.integers(97, 99, 400).astype(np.uint8)
        data[200:390] = data[5:195]
        text, starts = data.tobytes(), np.arange(len(data) - span + 1)
        order, common = R.suffix_order(data, starts, span)
        windows = [text[s:s + span] for s in starts]
        assert order.tolist() == sorted(starts.tolist(), key=lambda s: (windows[s], s))

        def lcp(a, b):
            return next((i for i in range(span) if windows[a][i] != windows[b][i]), span)
        assert common.tolist() == [0] + [lcp(a, b) for a, b in zip(order[:-1], order[1:])]
        want = [max((lcp(i, j) for j in range(i)), default=0) for i in starts]
        assert R.longest_previous(order, common).tolist() == want


def test_cut_texts_keep_whole_characters(spark):
    shared = "éabßcüdefghñijöklmøno"
    texts = ["a" + shared + "b", "é" + shared + "c", None, "", "plain", shared]
    docs = numbered(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, cut string"), "_row")
    got = {r.doc_id: r.text for r in R.without_repeats(docs.drop("cut"), "_row", "doc_id", "text", span=20, gram=8).collect()}
    assert got == {0: texts[0], 1: "éc", 2: None, 3: "", 4: "plain", 5: ""}


def test_nothing(spark):
    docs = numbered(spark.createDataFrame([], "doc_id long, text string"), "_row")
    assert R.digest(docs, "_row", "doc_id", "text").count() == 0


def test_contexts_cover_all_windows_once():
    data = np.random.default_rng(0).integers(0, 3, 5000).astype(np.uint8)
    _, _, first, n, _ = R.contexts(data, R.Rolling())
    assert first[0] == 0 and (first[1:] == (first + n)[:-1]).all() and first[-1] + n[-1] == 4801
    assert max(Counter(n.tolist())) <= R.SPAN
