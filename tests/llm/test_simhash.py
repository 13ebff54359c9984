import numpy as np
import pytest
import xxhash

from bandscape.llm import simhash


def slow_fingerprint(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", "".join(
        c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    if not grams:
        return 0
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    label = list(range(len(fps)))
    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


TEXTS = ["", None, " \t\n", "one", "one two", "a b c", "A  B\tC", "É é É é", "x " * 5000,
         "a b c d e f", " ".join(f"w{i}" for i in range(80_000))]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def family(seed, n):
    rng = np.random.default_rng(seed)
    bases = rng.integers(0, 2**64, 6, dtype=np.uint64)
    out = []
    for i in range(n):
        value = int(bases[i % 6])
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            value ^= 1 << int(bit)
        out.append(value)
    return out


def pairs(fps):
    return {(i, j) for j in range(len(fps)) for i in range(j) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 2}


@pytest.mark.parametrize("step", [1 << 16, 16])
def test_search_finds_every_pair_once(monkeypatch, step):
    monkeypatch.setattr(simhash, "STEP", step)
    for values in (family(1, 300), family(2, 9), [5], [1 << b for b in range(64)]):
        fp = np.array(sorted(set(values)), np.uint64)
        fp = fp[np.argsort(simhash.gray_rank(fp))]
        found = [p for a, b in simhash.search(np.zeros(len(fp), int), fp) for p in zip(a.tolist(), b.tolist())]
        assert len(found) == len(set(found)) and set(found) == pairs(fp)


def components_of(links, nodes):
    at = {n: i for i, n in enumerate(nodes)}
    label = np.arange(len(nodes))
    if links:
        simhash._unite(label, *(np.array([at[x[k]] for x in links]) for k in (0, 1)))
    return label.tolist()


@pytest.mark.parametrize("crowded", [4096, 2, 8])
def test_links_keep_the_components(spark, crowded):
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 2**63))                      # the dense ones agree on 44 bits: crowded at every level
    dense = {base ^ int(x) for x in rng.integers(0, 2**20, 300)}
    fps = sorted(set(family(1, 300)) | dense)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    got = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), crowded).collect()]
    assert all(((a ^ b) % 2**64).bit_count() < 40 for a, b in got)
    assert components_of(got, signed) == components_of([(signed[i], signed[j]) for i, j in pairs(fps)], signed)


def test_documents(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(500)]
    texts = [" ".join(rng.choice(words, 200)) for _ in range(20)]
    texts += [t + " tail" for t in texts[:10]] + [texts[0]] * 30 + TEXTS[:9]
    rows = [(i * 3 % 997, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.near_duplicates(docs).collect()
    fps = [slow_fingerprint(t) for _, t, _ in rows]
    root = slow_components(fps)
    want = {}
    for i, (doc, _, _) in enumerate(rows):
        want[doc] = min(rows[j][0] for j in range(len(rows)) if root[j] == root[i])
    assert {r.doc_id: r.component for r in got} == want and len(got) == len(rows)
    assert {r.doc_id: r.fp % 2**64 for r in got} == {d: f for (d, _, _), f in zip(rows, fps)}


def test_empty_repeated_and_null_keys(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, "z")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.component or -1) for r in simhash.near_duplicates(docs).collect()) == [
        (-1, -1), (-1, 1), (1, 1), (1, 1)]


def test_chain_is_one_component(spark):
    from bandscape.llm.common import components
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(900, 901)], "a long, b long")
    got = {r.node: r.label for r in components(edges, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 900: 900, 901: 900}
