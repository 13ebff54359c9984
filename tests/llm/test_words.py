import hashlib
import re
import time

from bandscape.llm import contamination, licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow_contamination(docs, items):
    out = []
    for key, text in docs:
        w, hit, names = words(text), set(), set()
        for item, t in items:
            v = words(t)
            for at in range(max(len(v) - 13, 0) + 1) if v else []:
                window = v[at:at + 13]
                for s in range(len(w) - len(window) + 1):
                    if w[s:s + len(window)] == window:
                        hit |= set(range(s, s + len(window)))
                        names.add(str(item))
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((key, len(w), len(hit), len(names), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


long_item = " ".join(f"q{i}" for i in range(30))
ITEMS = [(1, long_item), (2, "one two"), (3, "Solo"), (10, " ".join(f"q{i}" for i in range(5, 25))), (4, None), (5, "..."),
         (6, "a b a b a b a b a b a b a b a")]
DOCS = [(1, None), (2, ""), (3, "Solo. solo!"), (4, "x " * 50 + long_item.upper() + " y" * 100), (5, "one two one TWO"),
        (6, "a b " * 20), (7, "É one, two é"), (8, " ".join(f"q{i}" for i in range(3, 17)) + " z" * 20), (8, "two one"),
        (8, "two one"), (None, "solo " + "w " * 400), (9, long_item + " " + long_item), (11, "... ---")]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_contamination_equals_brute_force(spark):
    docs = frame(spark, [(k, t, 1, "x", "y") for k, t in DOCS], "doc_id long, text string, row int, id string, words string")
    items = frame(spark, ITEMS, "item_id long, text string")
    for block in (100_000, 3):
        got = contamination.contamination(docs, items, block=block)
        assert sorted((tuple(r)[1:] for r in got.collect()), key=repr) == slow_contamination(DOCS, ITEMS)


def test_contamination_of_nothing(spark):
    docs, items = frame(spark, DOCS, "doc_id long, text string"), frame(spark, [], "item_id long, text string")
    got = contamination.contamination(docs, items).collect()
    assert len(got) == len(DOCS) and not any(r.contaminated for r in got)
    assert contamination.contamination(items.selectExpr("item_id as doc_id", "text"), items).count() == 0


def test_licenses(spark):
    mit = dict(licenses.TEMPLATES[::-1])["mit"]
    long_mit = licenses.TEMPLATES[1][1]
    edited = long_mit.split(" ")
    edited = " ".join(edited[:20] + ["really"] + edited[20:50] + edited[51:])
    rows = [(1, None), (2, ""), (3, "w " * 40 + "Under the MIT licence, under the mit LICENSE, cc-by-nc"), (4, "a b c " + edited),
            (5, "This work is licensed under the GNU General Public License, version 3."), (6, mit), (6, mit), (None, "zz"),
            (7, long_mit[:200]), (8, "x " * 90_000 + "Apache License, Version 2")]
    got = licenses.licenses(frame(spark, [(k, t, 0) for k, t in rows], "doc_id long, text string, label int")).collect()
    assert len(got) == len(rows)
    by = {r.key: r for r in got}
    assert (by[3].n_base, by[3].first_word, by[3].last_word, by[3].base_labels) == (2, 44, 48, "cc-by-nc,mit")
    assert by[4].n_base == 0 and by[4].labels == "mit" and 0.9 < by[4].score < 1 and by[4].spans[0].first_word == 3
    assert by[5].labels == "gpl-3" and by[5].base_labels == "" and by[5].score == 1 and by[5].n_base == 0
    assert by[7].labels == "" and 0 < by[7].score < 0.8
    assert by[8].first_word == by[8].last_word == 90_000 and by[8].labels == "apache-2"
    for k in (1, 2, None):
        assert (by[k].n_base, by[k].first_word, by[k].labels, by[k].score) == (0, None, "", 0.0)
    assert licenses.licenses(frame(spark, [], "doc_id long, text string")).count() == 0


def test_a_text_of_a_million_words(spark):
    started = time.monotonic()
    notice = "Licensed under CC BY-NC 4.0. "
    text = ("lorem ipsum " * 1_000 + "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11 q12 q13 q14 " + notice) * 500
    n = len(words(text))
    assert n > 1_000_000
    docs = frame(spark, [(1, text), (2, "q1 q2"), (3, text[::-1])], "doc_id long, text string")
    items = frame(spark, [(7, " ".join(f"q{i}" for i in range(1, 14))), (8, "q14 q13"), (9, "lorem ipsum " * 7)], "item_id long, text string")
    by = {r.key: r for r in contamination.contamination(docs, items).collect()}
    assert (by[1].n_words, by[1].n_hit, by[1].n_items, by[1].contaminated) == (n, 500 * 2013, 2, True)
    assert by[2].n_hit == by[3].n_hit == 0
    by = {r.key: r for r in licenses.licenses(docs).collect()}
    assert (by[1].n_base, by[1].first_word, by[1].last_word) == (500, 2016, n - 5) and by[1].base_labels == "cc-by-nc"
    assert by[3].n_base == 0 and by[3].labels == ""
    assert time.monotonic() - started < 180
