"""Hard negatives and the conversation trie against brute force."""

import hashlib
import random
import zlib

import pytest

from pyspark.sql import functions as F

from terraloc.llm import conversation_trie as trie
from terraloc.llm import hard_negatives as hard
from terraloc.llm.common import save

TURNS = "conv_id long, turn long, role string, text string, cls string, id int"


def plain_trie(rows: list[tuple], base: int, shared: int) -> set[tuple]:
    convs: dict[int, list] = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(own)] for c, own in convs.items()}
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % shared
        b = c - (abs(c) % base) * (1 if c > 0 else -1)
        made[c] = convs.get(b, [])[:h] + own[h:]
    nodes: dict[tuple, list[int]] = {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    kids: dict[tuple, list[tuple]] = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    out, leaves, saved = set(), {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        saved[p] = sum(saved[k] for k in kids.get(p, [])) + ((len(nodes[p]) - 1) * len(p[-1][1]) if p else 0)
        ends = ",".join(str(c) for c in sorted(nodes[p]) if len(made[c]) == len(p))
        out.add((min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations(seed: int, n: int) -> list[tuple]:
    """Few distinct turns, so that prefixes are shared; copies; a long pair; nulls."""
    r = random.Random(seed)
    rows = []
    for c in [*range(-4, n), 1000, 1001, 1007]:
        own = [(r.choice(["user", "assistant", None]), r.choice(["a", "bé", None, "", "c c"])) for _ in range(r.randrange(8))]
        rows += [(c, t if r.random() < 0.9 else None, *x, "x", 1) for t, x in enumerate(own)]
    for c in range(2000, 2040):  # copies and near copies of one deep conversation
        rows += [(c, t, "user", f"deep {t}", "x", 1) for t in range(40 - c % 3)]
        rows.append((c, 100, "user", str(c % 5), "x", 1))
    r.shuffle(rows)
    return [*rows, (None, 1, "user", "no conversation", "x", 1)]


@pytest.mark.parametrize("local", [5, 60, 100_000])
def test_trie_is_that_of_brute_force(spark, local):
    rows = conversations(local, 30)
    df = spark.createDataFrame(rows, TURNS)
    found = trie.prefix_trie(df, base=10, shared=4, local_turns=local).collect()
    assert len(found) == len(set(map(tuple, found)))
    assert {tuple(x) for x in found} == plain_trie(rows, 10, 4)


def test_trie_of_turnless_and_of_no_conversations(spark):
    assert trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    rows = [(c, 1, "user", "x" * 100_000, "x", 1) for c in range(1, 12)]  # bases are absent: some keep their turn, some have none
    found = trie.prefix_trie(spark.createDataFrame(rows, TURNS)).collect()
    assert {tuple(x) for x in found} == plain_trie(rows, 100, 6)


def test_ends_are_hashed_over_batches():
    import pyarrow as pa

    batches = [pa.record_batch([pa.array(a), pa.array(b)], names=["cls", "conv"]) for a, b in (([1, 1], [1, 2]), ([1], [10]), ([], []), ([1, 4], [11, 4]), ([4], [40]))[:2]]
    batches += [pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["cls", "conv"]) for a, b in (([], []), ([1, 4], [11, 4]), ([4], [40]))]
    got = [tuple(x.values()) for b in trie._ends(iter(batches)) for x in b.to_pylist()]
    assert got == [(1, hashlib.sha256(b"1,2,10,11").hexdigest()), (4, hashlib.sha256(b"4,40").hexdigest())]


def plain_negatives(rows, every, k, n):
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    known = [(i, c, label, v) for i, (c, label, v) in enumerate(rows) if c is not None and label is not None and v is not None and all(x is not None and abs(x) < float("inf") for x in v)]
    known = [(i, c, label, [int(256 * x // 1) for x in v]) for i, c, label, v in known]
    for i, c, label, v in known:
        if c % every == 0:
            others = [(-dot(v, u), d, m) for j, d, m, u in known if j != i and len(u) == len(v)]
            for p, d, _ in sorted(x for x in others if x[2] == label)[:k]:
                some = sorted(x for x in others if x[2] != label and 30 * -p <= 100 * -x[0] <= 90 * -p)[:n]
                out += [(c, d, r + 1, x[1], -p, -x[0]) for r, x in enumerate(some)]
    return sorted(out)


@pytest.mark.parametrize("block", [200, 1 << 20])
def test_negatives_are_those_of_brute_force(spark, block):
    r = random.Random(block)
    rows = [(r.choice([c, c, r.randrange(60)]), r.choice([0, 1, 1, 1, 2, None]), [float(r.randrange(-2, 3)) / 4 for _ in range(3)]) for c in range(150)]
    rows += [(4, 1, [0.25, 0.5, 0.5])] * 3 + [(None, 1, [0.0] * 3), (8, 1, None), (12, 1, [1.0, None, 0.0]), (16, 1, [float("nan"), 0.0, 0.0]), (20, 1, [float("inf"), 0.0, 0.0])]
    rows += [(24, 1, []), (28, 2, []), (32, 1, [1.0]), (36, 2, [0.5]), (40, 1, [2.0])]
    df = spark.createDataFrame([(*x, "x") for x in rows], "vec_id long, label int, embedding array<float>, own string")
    data = save(hard.labelled(df, F.col("label")), "test")
    found = hard.mine(data, data.filter("vec_id % 4 = 0"), 3, 4, block_bytes=block)
    assert sorted(map(tuple, found.collect())) == plain_negatives(rows, 4, 3, 4)


def test_negatives_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    data = save(hard.labelled(df, F.col("label")), "test")
    assert hard.mine(data, data).count() == 0


def test_score_windows_are_exact():
    import numpy as np

    p = np.array([*range(-1500, 1500), (1 << 63) - 1, 1 - (1 << 63)])
    low, high = hard.score_windows(p)
    assert low.tolist() == [-(-30 * int(x) // 100) for x in p]
    assert high.tolist() == [90 * int(x) // 100 for x in p]
