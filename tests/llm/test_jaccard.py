"""Operator 11 against all pairs of texts."""

import random
import re

import numpy as np
import pytest

from larkspan.llm import jaccard

DOCS = "doc_id long, text string, size string, row string, n string"


def plain_set(text):
    ws = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def plain(rows):
    """[(doc_id, n_shingles, component_id)] of rows (doc_id, text), by all pairs."""
    sets = [plain_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return [(doc, len(s), least.get(root(i))) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))]


def made(seed):
    """Texts of many lengths; near copies around the threshold; a passage that many hold; texts that are little more."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyzw") + str(rng.randrange(60))
    passage = [word() for _ in range(30)]
    out = [None, "", " \n", "one", "One two", "one two", "a b c d e", "A b\tc d  e"]
    for _ in range(25):
        base = [word() for _ in range(rng.choice([6, 12, 40, 120]))]
        out.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            near = list(base)
            for _ in range(rng.randrange(1, 1 + len(base) // 20 + 1)):
                near[rng.randrange(len(near))] = word()
            out.append(" ".join(near[: len(near) - rng.randrange(len(near) // 5)]))
    out += [" ".join(passage + [word() for _ in range(rng.choice([1, 2, 3, 8, 60]))]) for _ in range(25)]
    long = [word() for _ in range(150)]
    out += [" ".join(long[:i] + [word()] + long[i + 1 :]) for i in range(0, 150, 7)]
    out += out[8:12] * 3
    rng.shuffle(out)
    return [(i if i % 11 else None, t) for i, t in enumerate(out)]


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_pieces_of_the_method():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 300)))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 62, rng.integers(1, 40)))))
        both = len(np.intersect1d(a, b))
        link = 100 * both >= 80 * (len(a) + len(b) - both)
        assert jaccard.linked(a, [b, a]).tolist() == [link, True]
        words = min(len(jaccard.bitmap(a)), len(jaccard.bitmap(b)))
        apart = int(np.bitwise_count(jaccard.folded(jaccard.bitmap(a), words) ^ jaccard.folded(jaccard.bitmap(b), words)).sum())
        assert apart <= len(a) + len(b) - 2 * both  # the bound from bits
        pairs = list(jaccard.candidates(np.array([len(a), len(b)]), [jaccard.bitmap(a), jaccard.bitmap(b)], np.array([0, 1])))
        if link:
            assert pairs
            assert set(a[: jaccard.prefix(len(a))]) & set(b[: jaccard.prefix(len(b))])
            assert jaccard.forest(np.array([5, 6]), [a, b])
            assert [sorted(x) for x in jaccard.bridges(5, np.array([7, 8]), np.array([5, 6]), [a, b])] == [[7, 8]]
    n = np.arange(1, 20000)
    assert (np.abs(jaccard.band(n * 5) - jaccard.band(n * 4)) <= 1).all()


@pytest.mark.parametrize(("seed", "block", "weight"), [(1, 2048, 1 << 22), (1, 8, 200), (2, 3, 100), (3, 20, 1 << 22)])
def test_join_by_all_pairs(spark, seed, block, weight):
    """With groups of any size in one tile, and with frequent shingles demoted and tiles dealt over cells."""
    rows = made(seed)
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS)
    assert got(jaccard.jaccard_join(frame, block, weight)) == sorted(plain(rows), key=repr)


def test_frequent_shingles_go_last_and_are_never_dealt_out(spark, monkeypatch):
    """A passage in over `block` rows, and another in less: prefixes hold the rarest, and what shingles are handed on to
    find this grows with the sample and the prefixes, not with the rows that hold frequent ones."""
    own = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    passage, other = own("p", 60), own("q", 60)
    rows = [(i, f"{own(i, 30)} {passage}" + (f" {other}" if i % 8 == 0 else "")) for i in range(160)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    level = jaccard.levels(frame, 128)
    at = lambda text: level[jaccard.shingles(text.encode()).view(np.uint64) >> np.uint64(64 - jaccard.ADDRESS)]
    assert (at(passage) > 0).all() and not at(own(3, 30)).any() and not at(other).any()
    made = {r.doc_id: set(r["keys"]) for r in jaccard.prints(frame, 128).collect()}
    late = set(jaccard.shingles(passage.encode()).tolist())
    assert all(keys and not keys & late for keys in made.values())
    explain = []
    real = jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda df, name: (explain.append(df._jdf.queryExecution().optimizedPlan().toString()), real(df, name))[1])
    assert got(jaccard.jaccard_join(frame, 128)) == sorted(plain(rows), key=repr)
    assert not any("explode(held" in x for x in explain)  # no row's whole set is dealt out by shingle


def test_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert got(jaccard.query(spark, "/root/testdata/sf0.001")) == sorted(plain(rows), key=repr)


def test_odd_rows_and_empty_tables(spark):
    word = "w" * 1_000_000
    rows = [(3, word), (4, word), (5, "a b c " * 60_000), (6, None), (7, ""), (None, ""), (None, "x y"), (None, "x y"), (9, "x y")]
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS)
    want = [(3, 1, 3), (4, 1, 3), (5, 3, 5), (6, 0, 6), (7, 0, 7), (None, 0, None), (None, 1, 9), (None, 1, 9), (9, 1, 9)]
    assert got(jaccard.jaccard_join(frame)) == sorted(want, key=repr)
    assert jaccard.jaccard_join(frame.limit(0)).collect() == []
