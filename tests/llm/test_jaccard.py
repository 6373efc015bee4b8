"""The heavy-light Jaccard join against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from terraloc.llm import jaccard

DOCS = "doc_id long, text string, node long, n int, token long, hi long, sketch string"


def plain(rows):
    kept = [(i, t) for i, t in rows if i is not None]
    sets = []
    for _, t in kept:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets.append(frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(kept)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = sorted((top(i), top(j)), key=lambda k: (kept[k][0], k))
                root[y] = x
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(kept):
        least[top(i)] = min(d, least.get(top(i), d))
    return sorted((d, len(sets[i]), least[top(i)]) for i, (d, _) in enumerate(kept))


def near_copies(seed: int):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 4)))
    passage = [word() for _ in range(60)]
    rows = [None, "", " \t\n", "one", "ONE", "one two", "a b c d e", "A  b\nc d e", "x" * 100_000]
    for size in (*range(1, 30), 40, 80, 150, 400, 6000):
        base = [word() for _ in range(size)]
        for _ in range(5):
            own = list(base)
            for _ in range(r.choice([0, 1, 1, 2, max(1, size // 50)])):
                k = r.randrange(len(own))
                own[k : k + r.randrange(2)] = [word()] * r.randrange(2) if len(own) > 1 else [word()]
            rows.append(" ".join(own))
        rows.append(" ".join(base[: size * 9 // 10] + passage))  # shared by many, alike or not
        rows.append(" ".join(passage + [word() for _ in range(size)]))
    rows += [rows[20], rows[30], rows[-3]]
    ids = list(range(len(rows)))
    r.shuffle(ids)
    return [*zip(ids, rows, strict=True), (3, rows[40]), (3, rows[40]), (5, rows[60]), (None, "one two")]


@pytest.mark.parametrize("most", [None, 0, 12])
def test_components_are_those_of_brute_force(spark, most, monkeypatch):
    monkeypatch.setattr(jaccard, "WINDOW", 3000)  # the passage's shingles are frequent
    monkeypatch.setattr(jaccard, "GROUP_ROWS", 16)
    rows = near_copies(most or 1)
    df = spark.createDataFrame([(i, t, 1, 2, 3, 4, "s") for i, t in rows], DOCS).repartition(3)
    found = jaccard.jaccard_components(df, most)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, found.collect())) == plain(rows)


def test_shuffled_text_join_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    rows = near_copies(5)[:120]
    df = spark.createDataFrame([(i, t, 1, 2, 3, 4, "s") for i, t in rows], DOCS)
    assert sorted(map(tuple, jaccard.jaccard_components(df).collect())) == plain(rows)


def test_empty_tables(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0
    assert jaccard.jaccard_components(spark.createDataFrame([(None, "a", 1, 2, 3, 4, "s")], DOCS)).count() == 0


def test_first_shingles_and_subsets_meet():
    r = np.random.default_rng(3)
    hot = np.sort(r.integers(0, 1 << 62, 40).astype(np.uint64))
    counts = r.integers(1, 9, 40)
    for _ in range(3000):
        n = int(r.integers(1, 40))
        both = np.concatenate((r.integers(0, 1 << 62, n).astype(np.uint64), r.choice(hot, int(r.integers(0, 9)), replace=False)))
        a, b = (np.unique(np.concatenate((both, r.integers(0, 1 << 62, int(r.integers(0, n // 5 + 2))).astype(np.uint64)))) for _ in range(2))
        linked = 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
        if linked:
            assert np.intersect1d(jaccard._first(a, hot, counts), jaccard._first(b, hot, counts)).size
        if max(len(a), len(b)) <= 14:
            s, t = ({k[:2] for k in zip(*(x.tolist() for x in jaccard.subsets(y, 14)), strict=True) if k[2] == -len(other)} for y, other in ((a, b), (b, a)))
            assert bool(s & t) == linked


def test_boundary_is_that_of_least_cost():
    sizes = {n: 1000 for n in range(1, 26)}
    assert jaccard.boundary({}, 0.0) in range(jaccard.LIGHT_MOST + 1)
    assert 0 < jaccard.boundary(sizes, 0.0) <= jaccard.boundary(sizes, 0.01) <= jaccard.LIGHT_MOST


def test_lists_keep_what_is_shared_over_batches():
    rows = [(1, 0, 1), (2, 0, 2), (2, 0, 3), (3, 0, 4), (3, 1, 5), (4, 2, 6), (5, 0, 7), (5, 0, 8), (6, 0, 9)]
    for cut in range(1, len(rows)):
        batches = [pa.record_batch([pa.array([x[k] for x in some]) for k in range(3)] + [pa.array([1] * len(some))], names=["token", "part", "node", "pos"]) for some in (rows[:cut], [], rows[cut:]) if some]
        kept = [n for b in jaccard._shared(iter(batches)) for n in b.column("node").to_pylist()]
        assert kept == [2, 3, 5, 6, 7, 8]


def test_words_are_told_apart_by_all_their_bytes():
    r = random.Random(2)
    words = {bytes(r.choices(range(33, 127), k=r.randrange(1, 24))).lower() for _ in range(3000)} | {b"a" * k for k in range(1, 40)} | {b"a" * k + b"\x00" for k in range(1, 20)}
    words = sorted(words)
    h = jaccard.word_hashes(b"\t\n" + b" \x0b\r ".join(words).upper())
    assert len(h) == len(words) and len(set(h.tolist())) == len(words)
    for w, x in zip(words[:300], h.tolist(), strict=False):
        assert jaccard.word_hashes(w).tolist() == [x]
    assert not len(jaccard.word_hashes(b"")) and not len(jaccard.word_hashes(b" \n"))
