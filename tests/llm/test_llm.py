"""The corpus operators against brute force, over tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from terraloc.llm import bpe, common, knn, media, packing, registry, simhash, suffixes, token_counts, toxicity, urls, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, g int, fp long, node long, h long, part int, place long, bucket int, kind int"
rng = np.random.default_rng(7)
WORDS = ["alpha", "beta", "gamma", "delta", "été", "naïve", "don't", "x1", "42", "日本", "über", "foo,", "bar."]


def prose(n):
    return " ".join(rng.choice(WORDS, n).tolist())


BASE = prose(400)
TEXTS = [None, "", " \n\t ", "word", "word", BASE, BASE, BASE + " tail", prose(20) + BASE[300:700] + prose(9), prose(40), "a" * 130, "a" * 49, "é" * 60, prose(120_000), "<|endoftext|>hi  there\n\n", "three words here"]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(5, BASE), (3, "word")]


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "r", 1, 2, 3, 4, 5, 6, 7, 8) for i, t in rows], DOCS)


def test_suffix_array():
    for n in (0, 1, 5, 16, 17, 100, 1000):
        for a in (1, 2, 50):
            t = rng.integers(1, a + 1, n)
            assert suffixes.suffix_array(t).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())


def test_suffix_array_of_wide_names():
    t = rng.integers(1, 1 << 20, 3_300_000)  # two thirds of these have names and ranks over 2 ** 21
    order = suffixes.suffix_array(t)
    s = np.append(t, np.zeros(8, np.int64))
    assert (np.bincount(order, minlength=len(t)) == 1).all()
    a, b = order[:-1], order[1:]
    less, tied = np.zeros(len(a), bool), np.ones(len(a), bool)
    for k in range(8):
        less |= tied & (s[a + k] < s[b + k])
        tied &= s[a + k] == s[b + k]
    assert less.all()


def test_a_minimizer_of_many_strings_is_dealt_by_window():
    phrase = "a phrase that every line of this log begins with, "
    texts = ["".join(f"{phrase}{i * 5 + k:030d} " for k in range(5)) for i in range(1200)]  # few documents, many strings
    kind = pa.struct([("doc_id", pa.int64()), ("text", pa.string())])
    told = [suffixes._tell(1)((pa.scalar(g),), pa.table({"row": pa.array([{"doc_id": i, "text": t} for i, t in enumerate(texts) if i % 2 == g], kind)})) for g in (0, 1)]
    answered = suffixes._answer(pa.concat_tables(told))
    known, hot = suffixes._repeated(answered)
    sizes = Counter()
    for c in suffixes.chunks([t.encode() for t in texts]):
        sizes.update(c.h.tolist())
    assert max(sizes.values()) > suffixes.HOT and suffixes.HOT * (suffixes.LONGEST + 1) <= suffixes.SORTED
    assert {h for h, x in zip(known.tolist(), hot.tolist(), strict=True) if x} == {h for h, n in sizes.items() if n > suffixes.HOT}


def brute_removed(rows):
    seen: dict[bytes, int] = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            seen[b[k : k + 50]] = min(i, seen.get(b[k : k + 50], i))
    for i, t in rows:
        b = (t or "").encode()
        edge = np.zeros(len(b) + 1, int)
        for k in range(len(b) - 49):
            if seen[b[k : k + 50]] < i:
                edge[k] += 1
                edge[k + 50] -= 1
        c = np.cumsum(edge)[: len(b)] > 0
        yield i, len(b), int(c.sum()), int((np.diff(np.concatenate(([0], c.astype(int)))) > 0).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~c])).hexdigest()


@pytest.mark.parametrize("hot", [4000, 1])
def test_removed(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    rows = [r for r in ROWS if len(r[1] or "") < 100_000] + [(77, "Ω" * 20 + BASE[:200]), (78, "q" + "Ω" * 30 + BASE[:200])]
    got = [tuple(r)[:5] for r in suffixes.removed(docs(spark, rows)).collect()]
    assert sorted(got) == sorted(brute_removed(rows))


def test_removed_equals_sql(spark, tmp_path):
    import duckdb

    rows = [*((i, t and t[:120_000]) for i, t in ROWS), (77, "Ω" * 20 + BASE[:200]), (78, "q" + "Ω" * 30 + BASE[:200]), (79, prose(3) + TEXTS[13][50_000:110_000]), (None, BASE), (-4, "b" * 200 + BASE[100:151])]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want, got = con.sql(suffixes.OP2_SQL), suffixes.op2_suffix_dedup(spark, str(tmp_path))
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_long_text_is_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", 1000)
    rows = [(1, BASE * 3), (2, "x" + BASE * 2)]
    assert sorted(tuple(r)[:5] for r in suffixes.removed(docs(spark, rows)).collect()) == sorted(brute_removed(rows))


def test_dedup_keeps_rows_and_columns(spark):
    d = docs(spark, [*ROWS, (None, BASE)])
    out = suffixes.dedup(d)
    assert out.schema.simpleString() == d.schema.simpleString() and out.count() == d.count()
    by = {(r.doc_id, r.n_chars): r.text for r in out.collect()}
    assert by[6, 0] == "" and by[5, len(BASE)] == BASE and by[0, 0] is None and by[None, len(BASE)] == BASE


def brute_components(fps):
    ids = sorted(fps)
    comp = {i: i for i in ids}
    for i in ids:
        for j in ids:
            if j > i and (fps[i] ^ fps[j]).bit_count() <= 4 and comp[i] != comp[j]:
                a, b = sorted((comp[i], comp[j]))
                comp = {k: a if v == b else v for k, v in comp.items()}
    return comp


def test_fingerprint():
    def brute(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", t.lower())
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    for t in TEXTS[:13]:
        assert simhash.fingerprint((t or "").encode()) == brute((t or "").encode())


def test_every_close_pair_meets_at_an_anchor():
    a = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    b = a.copy()
    for k in range(len(b)):
        for bit in rng.choice(64, 4, replace=False):
            b[k] ^= np.uint64(1) << np.uint64(bit)
    rows, keys = simhash.anchors(np.concatenate((a, b)))
    at = [set() for _ in range(600)]
    for r, k in zip(rows.tolist(), keys.tolist(), strict=True):
        at[r].add(k)
    assert all(at[k] & at[k + 300] for k in range(300))


@pytest.mark.parametrize("most", [4096, 8])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "GROUP_ROWS", most)
    center = int(rng.integers(0, 1 << 62))
    fps = [center ^ sum({1 << int(b) for b in rng.choice(64, rng.integers(0, 5))}) for _ in range(60)] + [int(x) for x in rng.integers(0, 1 << 62, 40)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    unique = {x: i for i, x in reversed(list(enumerate(fps)))}
    nodes = spark.createDataFrame([(signed(x), i) for x, i in unique.items()], "fp long, node long")
    got = {r.u: r.component for r in simhash.components(simhash.links(nodes)).collect()}
    assert {i: got.get(i, i) for i in unique.values()} == brute_components({i: x for x, i in unique.items()})


def test_near_dedup(spark):
    d = docs(spark, [*ROWS, (None, BASE)])
    out = simhash.near_dedup(d)
    kept = Counter(r.doc_id for r in out.collect())
    assert out.columns == d.columns and kept[None] == 1 and kept[5] == 2 and 6 not in kept and 4 not in kept and kept[0] == 1 and 1 not in kept


def test_near_dedup_judges_texts_of_one_id_by_themselves(spark):
    other = prose(300)
    d = spark.createDataFrame([(1, BASE, 0, 0), (2, BASE, 0, 0), (2, other, 0, 0), (3, other + " x", 0, 0), (4, BASE, 0, 0), (1, BASE + " y", 0, 0)], "doc_id long, text string, gone_id long, GONE_HASH long")
    out = simhash.near_dedup(d)
    assert out.columns == d.columns
    texts = Counter((r.doc_id, r.text[-2:]) for r in out.collect())
    assert sum(texts.values()) == 2 and (2, other[-2:]) in texts and sum(n for (i, _), n in texts.items() if i == 1) == 1


def test_rows_without_ids_are_not_held_out(spark):
    rows = [(None, "x"), (1, "x"), (2, "x"), (3, "x")]
    got = {r.doc_id: r.h for r in spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", toxicity.held_out().alias("h")).collect()}
    assert got == {None: False} | {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in (1, 2, 3)}


def test_saved_tables_need_a_shared_folder(monkeypatch):
    class Far:
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("Context", (), {"getCheckpointDir": staticmethod(lambda: None), "master": "spark://host:7077"})  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Far)


def test_toxicity_learns_sentences(spark):
    rows, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        parts = [prose(6) for _ in range(6)]
        if bad:
            parts[int(rng.integers(6))] = "you utter numskull"
        rows.append((i, ". ".join(parts)))
        labels.append((i, int(bad), None))
    d = docs(spark, [*rows, (900, None), (901, "")])
    model = toxicity.train(d, spark.createDataFrame([*labels, (3, None, None), (None, 1, None)], "doc_id long, toxic int, text string"))
    got = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    out = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((got[i].score >= 0.7) == (i % 5 == 0) for i in out) >= 0.98 * len(out)
    assert got[900].score == got[901].score == 0.0 and all(0 <= r.score <= 1 for r in got.values())
    assert all("numskull" in dict(rows)[i][got[i].worst_start : got[i].worst_end] for i in out if i % 5 == 0)
    assert {r.doc_id % 5 for r in toxicity.offending_sentences(d, model).collect()} == {0}
    kept = toxicity.filter_toxic(d, model)
    assert kept.columns == d.columns and kept.count() > 230


def test_long_clean_texts_are_not_toxic():
    def text(n, bad):
        parts = [prose(6) for _ in range(n)]
        if bad:
            parts[int(rng.integers(n))] = "you utter numskull"
        return ". ".join(parts)

    model = toxicity.fit([(text(8, i % 5 == 0), int(i % 5 == 0)) for i in range(300)])
    hits, plain = toxicity._Hits(model.weights), prose(6) + ". "
    for size in (100_000, 1_000_000, 5_000_000):
        clean = plain * (size // len(plain))
        assert toxicity.score_text(clean, model, hits)[0] < toxicity.THRESHOLD
        assert toxicity.score_text(clean + "you utter numskull. " + clean, model, hits)[0] >= toxicity.THRESHOLD


def test_long_labelled_texts_are_learnt_whole(spark, monkeypatch):
    filler = [prose(6) + ". " for _ in range(50)]
    text = lambda i: "".join(rng.choice(filler, 2200)) + ("you utter numskull. " if i % 3 == 0 else "")
    rows = [(i, text(i)) for i in range(60)]
    assert min(len(t) for _, t in rows) > 50_000
    d, labels = docs(spark, rows), spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.train(d, labels)
    hits = toxicity._Hits(model.weights)
    assert [toxicity.score_text(t, model, hits)[0] >= toxicity.THRESHOLD for _, t in rows] == [i % 3 == 0 for i, _ in rows]
    seen = []
    monkeypatch.setattr(toxicity, "fit", seen.extend)
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 500_000)
    toxicity.train(d, labels)
    assert 3 <= len(seen) and sum(len(t.encode()) for t, _ in seen) <= 500_000 and {t for t, _ in seen} <= {t for _, t in rows}


def test_each_sample_is_in_a_frame(monkeypatch):
    for n in (1, 2, 5):
        x = np.zeros(media.UNIT * n * media.UP // media.DOWN, np.float32)
        x[-1] = 1.0
        frames = media.log_mel(x)
        assert len(frames) == max(1, -(-(len(x) - media.FRAME) // media.HOP) + 1) and (frames[-1] > frames[0]).any() == (n > 0)
    samples = rng.integers(0, 256, media.UNIT * 40, np.uint8).astype(np.uint8).tobytes()
    whole = media.features(samples)[0]
    monkeypatch.setattr(media, "PIECE", 4096)
    assert np.allclose(media.features(samples)[0], whole, atol=1e-4) and len(media.features(samples)[0]) == len(whole)


def test_stored_tensors_give_the_features(spark, tmp_path):
    docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    before = set(Path(media.save(spark.range(1), "probe").inputFiles()[0].removeprefix("file:")).parents[1].iterdir())
    got = sorted(tuple(r) for r in media.op8_media(spark, str(tmp_path)).collect())
    assert got == sorted(tuple(r) for r in media.digests(media.media(docs(spark))).collect())
    base = Path(media.save(spark.range(1), "probe").inputFiles()[0].removeprefix("file:")).parents[1]
    written = [p for p in set(base.iterdir()) - before if "media" in p.name]
    stored = spark.read.parquet(f"file://{written[0]}").selectExpr("doc_id", "inline(tensors)")
    want = media.audio_tensors(media.media(docs(spark))).drop("piece")
    assert Counter(map(str, stored.collect())) == Counter(map(str, want.collect()))
    assert media.as_tensors(stored.toArrow()).column("values").type.shape == [media.FRAMES, media.BANDS]


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    lib, codec = Tokenizer.from_file(bpe.default_vocabulary()), bpe.Codec(bpe.default_vocabulary())
    texts = [t or "" for t in TEXTS] + ["a\x1cb\x85c d", "aaaaaaa aaaaab", "  lead", "😀" * 9, "I'll'VE", "​x"]
    for t, (ids, digits) in zip(texts, codec.encode(texts), strict=True):
        want = lib.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == want and digits == "".join(f"{i}," for i in want).encode()
        assert codec.decode(ids) == lib.decode(want, skip_special_tokens=False)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        bpe.Codec(packing.default_vocabulary())
    with pytest.raises(ValueError):
        packing.Encoder(bpe.default_vocabulary())


def test_packing(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(packing.default_vocabulary())
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(99, "İstanbul ǅ “q” ½ ² e\u0301")]
    got = packing.pack(docs(spark, rows)).toPandas()
    for i, t in rows:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        own = got[got.doc_id == i].sort_values("start")
        assert own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() == len(ids) == own.doc_tokens.iloc[0]
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own.start, own.length, strict=True)] == own.ids_crc32.tolist()
    g = got.sort_values(["sequence_id", "offset"])
    assert ((g.groupby("sequence_id").length.cumsum() - g.length) == g.offset).all() and g.groupby("sequence_id").length.sum().max() <= 2048


def check_packing(got, texts: dict) -> None:
    """Pieces tile their documents and their sequences, and hold the library's ids."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(packing.default_vocabulary())
    for i, own in got.sort_values("start").groupby("doc_id"):
        ids = np.array([*lib.encode(texts[i], add_special_tokens=False).ids, 1], "<u4")
        assert own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() == len(ids)
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own.start, own.length, strict=True)] == own.ids_crc32.tolist()
    assert set(got.doc_id) == set(texts)
    g = got.sort_values(["sequence_id", "offset"])
    assert ((g.groupby("sequence_id").length.cumsum() - g.length) == g.offset).all() and g.groupby("sequence_id").length.sum().max() <= 2048


@pytest.mark.parametrize("words", [[699], [1199, 899], [1024, 511], [1500, 1400, 1300], [700, 680, 30, 3000]])
def test_middling_lengths_are_poured_into_gaps(spark, words):
    texts = {i: " ".join(["the"] * (words[i % len(words)] + i % 3)) for i in range(120)}
    got = packing.pack(docs(spark, texts.items()).repartition(3)).toPandas()
    check_packing(got, texts)
    assert got.sequence_id.nunique() == got.sequence_id.max() + 1
    assert 2048 * got.sequence_id.nunique() - got.length.sum() < 0.01 * 2048 * got.sequence_id.nunique() + 2048


@pytest.mark.parametrize("counts", [{700: 1000}, {1200: 1000, 900: 1000}, {1025: 500, 512: 1000}, {2048: 3}, {5: 1}, {}])
def test_few_sequences_for_middling_lengths(counts):
    patterns = packing.pack_histogram(counts)
    kept, loose = packing.given_up(patterns)
    tokens, packs = sum(k * n for k, n in counts.items()), sum(n for _, n in kept)
    assert sum(sum(p) * n for p, n in kept) + sum(k * n for k, n in loose.items()) == tokens
    assert packs * 2048 - tokens <= max(0.03 * packs * 2048, 2047)
    gaps, at, seen = packing.Gaps(kept), 0, {}
    for length, n in loose.items():
        for _ in range(n):
            for seq, offset, size in gaps.spans(at, length):
                assert 0 <= seq < packs and seen.setdefault(seq, offset) == offset
                seen[seq] = offset + size
                at += size
    assert all(v <= 2048 for v in seen.values())


def test_histogram_packing_uses_all_pieces():
    counts = {int(k): int(v) for k, v in zip(rng.integers(1, 2049, 300), rng.integers(1, 50, 300), strict=True)}
    patterns = packing.pack_histogram(counts)
    used = Counter()
    for lengths, n in patterns:
        assert sum(lengths) <= 2048
        for x in lengths:
            used[x] += n
    assert used == counts


def test_pieces_of_one_length_share_sequences():
    def sequences(counts):
        return sum(n for _, n in packing.pack_histogram(counts))

    assert sequences({300: 1000}) == -(-1000 // 6)
    counts = Counter(rng.integers(20, 1200, 2000).tolist()) + Counter({60: 1000})
    assert sequences(counts) * 2048 <= 1.03 * sum(k * v for k, v in counts.items())
    patterns = packing.pack_histogram({300: 1000, 100: 7})
    places, found = set(), packing.slots(patterns)
    for length, total in ((300, 1000), (100, 7)):
        for rank in range(total):
            _, first, base, offset = found[(found[:, 0] == length) & (found[:, 1] <= rank)][-1].tolist()
            places.update((base + rank - first, offset + k) for k in range(length))
    assert len(places) == 300 * 1000 + 100 * 7 and max(p for _, p in places) < 2048


@pytest.mark.parametrize("cached", [token_counts.CACHED_CHARACTERS, 10])
def test_token_counts(monkeypatch, cached):
    monkeypatch.setattr(token_counts, "CACHED_CHARACTERS", cached)
    scores, byte = token_counts.vocabulary_scores(token_counts.default_vocabulary())
    assert abs(sum(map(np.exp, scores.values())) + 256 * np.exp(byte) - 1) < 1e-9
    counter, longest = token_counts.Counter(scores, byte), max(map(len, scores))

    def brute(w):
        best = [(0.0, 0)]
        for d in range(1, len(w) + 1):
            u = len(w[d - 1].encode())
            s, n = best[d - 1][0] + byte * u, best[d - 1][1] + u
            for k in range(1, min(d, longest) + 1):
                if w[d - k : d] in scores and best[d - k][0] + scores[w[d - k : d]] > s:
                    s, n = best[d - k][0] + scores[w[d - k : d]], best[d - k][1] + 1
            best.append((s, n))
        return best[-1]

    texts = [t or "" for t in TEXTS] + ["the" * 300 + " 日本" * 5 + "日本語😀" * 200 + "\u07ff\u0800\uffff" * 30, "日本" * 99, "".join(prose(12_000).split()), "the theme then they thin"]
    own = {}
    for k in range(0, len(texts), 6):
        for t, (n, tokens, score) in zip(texts[k : k + 6], counter.texts(texts[k : k + 6]), strict=True):
            words = [token_counts.MARK + w for w in t.split()]
            own.update((w, brute(w)) for w in set(words).difference(own))
            assert n == len(words) and tokens == sum(own[w][1] for w in words) and abs(score - sum(own[w][0] for w in words)) <= 1e-9 * abs(score)


def brute_knn(rows, k=5):
    q = []
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(256 * x) for x in v):
            q.append((i, [int(np.floor(256 * x)) for x in v]))
    want = []
    for n, (i, a) in enumerate(q):
        if i % 50 == 0:
            scores = [(min(max(sum(x * y for x, y in zip(a, b, strict=True)), -(2**63) + 1), 2**63 - 1), j) for m, (j, b) in enumerate(q) if m != n and len(a) == len(b)]
            want += [(i, r, j, s) for r, (s, j) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:k], 1)]
    return sorted(want)


@pytest.mark.parametrize("per", [512, 3])
def test_knn(spark, monkeypatch, per):
    monkeypatch.setattr(knn, "GROUP_QUERIES", per)
    monkeypatch.setattr(knn, "CELL_ROWS", per)
    monkeypatch.setattr(knn, "SLICE_ROWS", 20 * per)
    vectors = [[float(v) for v in rng.normal(size=8)] for _ in range(400)]
    vectors[7] = vectors[8] = vectors[50]
    rows = [(i, v, "x", 1) for i, v in enumerate(vectors)] + [(500, None, "x", 1), (501, [1.0, None] + [0.0] * 6, "x", 1), (502, [float("nan")] * 8, "x", 1), (503, [float("inf")] * 8, "x", 1), (550, [1.0, 2.0], "x", 1), (551, [1.0, 2.0], "x", 1), (600, [], "x", 1), (650, [], "x", 1), (None, vectors[0], "x", 1), (3, vectors[3], "x", 1), (3, vectors[4], "x", 1), (100, vectors[9], "x", 1), (700, [0.0] * 8, "x", 1)]
    data = knn.save(knn.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell string, dim int")), "vectors")
    for pivots in (None, 3):
        assert sorted(tuple(r) for r in knn.topk_join(data, data.filter("vec_id % 50 = 0"), pivots=pivots).collect()) == brute_knn(rows)


def test_knn_of_large_numbers(spark):
    import duckdb

    rows = [(50, [1e7, 1.0]), (1, [2e7, 1.0]), (2, [1.0, 1.0]), (100, [-1.0, 0.0]), (50, [3.0, 4.0]), (50, [1.0, 0.5]), (150, [0.0, 0.0]), (200, [1e15, -1e15]), (201, [1e3, -1e15]), (300, None), (300, []), (9, [1.0]), (9, [1e308])]
    for some in (rows, [*rows, (7, [1e30, 1.0]), (250, [-1e200, 3.0]), (8, [1e299, 1e307])]):
        data = knn.save(knn.quantized(spark.createDataFrame(some, "vec_id long, embedding array<double>")), "vectors")
        assert sorted(tuple(r) for r in knn.topk_join(data, data.filter("vec_id % 50 = 0")).collect()) == brute_knn(some)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows[:-1])
    assert sorted(con.sql(knn.OP1_SQL).fetchall()) == brute_knn(rows[:-1])


def test_urls(spark):
    rows = [(1, "http://WWW.Example.com/en/1"), (2, "https://b.example.com/en/2?x"), (3, "http://a.net/fr/9"), (4, "http://a.net"), (5, None), (6, "nothing"), (7, "x://"), (8, "http://notcom/en/"), (8, "http://a.org/de/1#f")]
    got = {(r.page_id, r.host): r for r in urls.judge(spark.createDataFrame([(i, u, "h", "t") for i, u in rows], "page_id long, url string, host string, shape string")).collect()}
    assert len(got) == 9
    assert (got[1, "www.example.com"].rule, got[1, "www.example.com"].verdict, got[1, "www.example.com"].path) == ("www.example.com/en/", "allow", "/en/1")
    assert (got[2, "b.example.com"].rule, got[2, "b.example.com"].verdict) == ("example.com/en/", "block")
    assert got[3, "a.net"].rule == "net/fr/" and got[4, "a.net"].rule is None and got[4, "a.net"].path == ""
    assert got[5, ""].path == got[6, ""].path == got[7, ""].path == "" and got[8, "notcom"].rule is None


def test_url_templates_learn_from_rules(spark):
    rows = [(i, f"http://h.net/{'fr' if i % 2 else 'en'}/{i}") for i in range(60)] + [(100 + i, f"http://s.net/fr/p{i}") for i in range(5)]
    pages = spark.createDataFrame([(i, u) for i, u in rows], "page_id long, url string")
    by = {(r.host, r.template): r.purity for r in urls.judge(pages).collect()}
    assert by["h.net", "/fr/{n}"] >= by["h.net", "/en/{n}"] and ("s.net", "/fr/p{n}") in by


def brute_templates(urls_):
    """(host, path): template and purity, by plain recursion."""

    def shaped(path):
        path = path.replace("{", "{{")
        for pattern, to in ((r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "{uuid}"), (r"\d{4}-\d{2}-\d{2}", "{date}"), (r"(?<![0-9a-zA-Z])(?=[0-9a-f]*\d)[0-9a-f]{16,}(?![0-9a-zA-Z])", "{hex}"), (r"\d+", "{n}"), (r"[^/]{40,}", "{long}")):
            path = re.sub(pattern, to, path)
        return path

    def label(host, path):
        fits = [(len(h + p), kind) for kind, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1] if fits else None

    labels = [label(h, p) for h, p in urls_]
    known = [x for x in labels if x]
    overall = known.count("block") / len(known) if known else 0.0
    template = {}

    def grow(rows, prefix):
        """rows: index and segments left, all of one node."""
        live = [(i, r) for i, r in rows if r]
        for i, r in rows:
            if not r:
                template[i] = prefix
        sizes = Counter(r[0] for _, r in live)
        below = {}
        for i, r in live:
            literal = sizes[r[0]] >= urls.LEAST and sizes[r[0]] >= urls.KEEP * len(live)
            below.setdefault(r[0] if literal else urls.ANY, []).append((i, r[1:]))
        for segment, some in below.items():
            grow(some, f"{prefix}/{segment}")

    purity = {}
    for host in {h for h, _ in urls_}:
        grow([(i, shaped(p).split("/")[1:]) for i, (h, p) in enumerate(urls_) if h == host], "")
        tree = {}
        for i, (h, _) in enumerate(urls_):
            if h == host and labels[i]:
                l, b = tree.get(template[i], (0, 0))
                tree[template[i]] = l + 1, b + (labels[i] == "block")
        unit = {t: (t,) for t in tree}  # of each template: those it has merged with
        paths = {t: (*t.split("/")[1:], urls.END) for t in tree}
        for depth in range(max(map(len, paths.values()), default=0), 0, -1):
            nodes = {}
            for t, p in paths.items():
                if len(p) >= depth:
                    nodes.setdefault(p[:depth], []).append(t)
            whole = {}
            for node, ts in nodes.items():
                if len({unit[t] for t in ts}) == 1:
                    l, b = (sum(tree[t][k] for t in ts) for k in (0, 1))
                    whole.setdefault(node[:-1], []).append((b / l, "/".join(node), l, ts))
            for some in whole.values():
                held, last = [], None
                for p, _, l, ts in sorted(some, key=lambda x: x[:2]):
                    if last:
                        both = (p * l + last[0] * last[1]) / (l + last[1])
                        if (p - last[0]) / (max(both * (1 - both), 1e-4) * (1 / l + 1 / last[1])) ** 0.5 >= urls.MERGE_Z:
                            unit |= {t: tuple(held) for t in held}
                            held = []
                    held += ts
                    last = p, l
                unit |= {t: tuple(held) for t in held}
        for t, of in unit.items():
            l, b = (sum(tree[x][k] for x in of) for k in (0, 1))
            purity[host, t] = (b + urls.PRIOR * overall) / (l + urls.PRIOR)
    return [(template[i], purity.get((h, template[i]), overall)) for i, (h, _) in enumerate(urls_)]


def test_url_templates_equal_brute_force(spark):
    pick = lambda *x: str(rng.choice(x))
    paths = [f"/{pick('en', 'fr', 'es', 'de')}/{pick('a', 'b', '*', '{n}', '{*}')}/{rng.integers(99)}/{pick('x', 'y', 'z')}" for _ in range(500)]
    paths += [f"/{pick('fr', 'en')}/{'deep/' * int(rng.integers(9))}p{rng.integers(3)}{pick('', '/', '//x')}" for _ in range(300)]
    paths += [f"/wiki/{rng.integers(1 << 40):x}g/{pick('talk', 'history', '')}" for _ in range(300)] + ["", "/", "//", "/2024-01-02/" + "s" * 50, "/" + "t/" * 9, "/0123456789abcdef0/1"] * 2
    made = [(pick("h.net", "a.example.com", "www.example.com", "k.org"), p) for p in paths]
    pages = spark.createDataFrame([(i, f"http://{h}{p}") for i, (h, p) in enumerate(made)], "page_id long, url string")
    got = {r.page_id: (r.template, r.purity) for r in urls.judge(pages).collect()}
    for i, (t, p) in enumerate(brute_templates(made)):
        assert got[i][0] == t and abs(got[i][1] - p) < 1e-12, (made[i], got[i], (t, p))


def test_hot_join_deals_hot_keys(spark):
    left = spark.range(40_000).selectExpr("id", "if(id % 3 = 0, 0, id) AS k")
    right = common.save(left.groupBy("k").agg(F.count("*").alias("rows")).withColumn("v", F.col("k") * 2), "right")
    out = common.hot_join(left, right, ["k"])
    assert out.count() == 40_000 and out.filter("v != 2 * k").count() == 0 and out.columns == ["k", "id", "v"]


def test_media(spark):
    out = {(r.doc_id, r.n_bytes): r for r in media.digests(media.media(docs(spark))).collect()}
    for i, t in ROWS:
        b = (t or "").encode()
        pad = b + b"\xff" * (576 - len(b) if not b else -len(b) % 576)
        r = out[i, len(b)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-32:])) and r.media_bytes == len(pad) + 44
    assert out[5, len(BASE.encode())].feature == out[6, len(BASE.encode())].feature
    tensors = media.audio_tensors(media.media(docs(spark))).toArrow()
    assert media.as_tensors(tensors).column("values").type.shape == [media.FRAMES, media.BANDS]


def test_log_mel_equals_direct_sums():
    x = rng.normal(size=700).astype(np.float32)
    rate, n = media.RATE * media.UP / media.DOWN, media.FRAME
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1))
    turn = np.exp(-2j * np.pi * np.outer(np.arange(n // 2 + 1), np.arange(n)) / n)
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = [700 * (10 ** (top * k / (media.BANDS + 1) / 2595) - 1) for k in range(media.BANDS + 2)]
    want = []
    for a in range(0, len(x) - n + media.HOP, media.HOP):
        frame = np.zeros(n)
        frame[: len(x[a : a + n])] = x[a : a + n]
        power = np.abs(turn @ (frame * window)) ** 2
        row = []
        for low, mid, high in zip(edges, edges[1:], edges[2:], strict=False):
            f = np.arange(n // 2 + 1) * rate / n
            gain = [max(0, min((v - low) / (mid - low), (high - v) / (high - mid))) for v in f]
            row.append(np.log(max(float(power @ gain), 1e-6)))
        want.append(row)
    assert np.allclose(media.log_mel(x), want, atol=2e-3)


def test_segments_equal_a_state_machine():
    for energy in (rng.normal(size=400).cumsum(), rng.normal(size=50), np.zeros(9), np.array([1.0]), np.zeros(0)):
        want, on = [], None
        if len(energy) and energy.std() >= 1e-4:
            high, low = energy.mean() + 0.5 * energy.std(), energy.mean() - 0.25 * energy.std()
            for k, v in enumerate(energy):
                if on is None and v > high:
                    on = k
                elif on is not None and v < low:
                    want.append((on, k))
                    on = None
            want += [(on, len(energy))] if on is not None else []
        assert [tuple(x) for x in media.segments(energy).tolist()] == want


def test_features_of_long_texts_equal_the_whole_signal():
    samples = bytes(rng.integers(0, 256, media.PIECE + 4096 + 64, np.uint8))
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    frames, found = media.features(samples)
    whole = media.log_mel(media.resample(x))
    assert frames.shape == whole.shape and np.allclose(frames, whole, atol=1e-3) and (found == media.segments(frames.mean(1))).all()


def test_resampling_is_upsample_filter_decimate():
    x = rng.normal(size=1000).astype(np.float32)
    h = np.zeros(media.UP * media.TAPS)
    for p in range(media.UP):
        h[p :: media.UP] = media.phases()[p][::-1]
    wide = np.zeros(len(x) * media.UP)
    wide[:: media.UP] = x
    want = np.convolve(wide, h)[: len(wide)][:: media.DOWN]
    assert np.allclose(media.resample(x)[: len(want)], want, atol=1e-4)


WARC_ROWS = [(1, "http://b.org/x", "same"), (2, "http://a.org/y z\r\n", "same"), (3, None, None), (4, "http://a.org/", ""), (5, "HTTP://A.org", "é" * 5000), (6, "http://b.org/x", "same"), (6, "http://b.org/x", "same"), (7, "://é.B.c?q#f", "\0\r\n"), (8, "a\x7f", "WARC/1.1\r\n\r\n")]


@pytest.mark.parametrize("size", [warc.ARCHIVE_BYTES, 1])
def test_warc(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", size)
    monkeypatch.setattr(warc, "RANGE_ROWS", 2)
    rows = [*WARC_ROWS, (None, "http://b.org/x", "same")]
    pages = spark.createDataFrame([(i, u, h, "t", 1) for i, u, h in rows], "page_id long, url string, html string, sha string, first int")
    warc.write_archives(pages, str(tmp_path / "w"))
    index = warc.merged_index(warc.save(warc.captures(warc.read_archives(spark, str(tmp_path / "w"))), "captures")).collect()
    assert len(index) == len(WARC_ROWS)
    first = {}
    for i, _, h in WARC_ROWS:
        first.setdefault(h or "", i)
    for r in index:
        h = dict((i, h or "") for i, _, h in WARC_ROWS)[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(h.encode()), warc.base32_sha1(h.encode()))
        assert (r.record_type, r.refers_to) == (("response", None) if first[h] == r.page_id else ("revisit", first[h]))
    assert sorted(r.position for r in index) == list(range(len(index)))
    keys = [(r.url_key, r.captured, r.page_id) for r in sorted(index, key=lambda r: r.position)]
    assert keys == sorted(keys)
    import gzip

    for f in (tmp_path / "w").glob("*.warc.gz"):  # whole gzip files, each with a warcinfo record first
        assert gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_warc_equals_sql(spark, tmp_path):
    import duckdb

    rows = [(10 * i, u, h) for i, (_, u, h) in enumerate(WARC_ROWS)] + [(10 * i + 1, f"http://h{i % 7}.org/{i}", f"{i % 5}") for i in range(300)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(warc.OP9_SQL)
    got = warc.op9_warc(spark, str(tmp_path))
    assert got.columns == want.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


def test_long_records_end_in_zero():
    payload = bytes(rng.integers(0, 256, 17 << 20, np.uint8))
    made = [warc.record(k, "http://a.org/", p, len(p), warc.base32_sha1(p), None) for k, p in enumerate((payload, b"x"))]
    assert made[0][-1] and not made[1][-1]
    data = b"".join(warc.line(m) + b"\0" for m in made)
    assert [len(b.partition(b"\r\n\r\n")[2]) for _, _, b in warc.records(data)] == [len(payload), 1]


def test_records_of_any_size_are_read():
    made = [(k, bytes(rng.integers(0, 256, n, np.uint8))) for k, n in enumerate((0, 10, 70_000, 5, 16_384, 300))]
    stored = [warc.record(k, f"http://a.org/{k}", p, len(p), warc.base32_sha1(p), None) for k, p in made]
    found = list(warc.records(b"".join(stored)))
    assert [b.partition(b"\r\n\r\n")[2] for _, _, b in found] == [p for _, p in made]
    assert [at for at, _, _ in found] == np.cumsum([0, *map(len, stored[:-1])]).tolist()
    with pytest.raises((ValueError, KeyError)):
        list(warc.records(b"".join(stored)[:-9]))


def test_loser_tree():
    lists = [sorted(rng.integers(0, 50, n).tolist()) for n in (0, 1, 7, 30, 4)]
    for k in range(6):
        assert list(warc.LoserTree(lists[:k])) == sorted(x for r in lists[:k] for x in r)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, tmp_path, name):
    docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert registry.QUERIES[name](spark, str(tmp_path)).collect() == []


def test_queries_keep_rows_without_ids(spark):
    d = docs(spark, [(None, BASE), (1, "a")])
    assert packing.pack(d).count() == 2 and bpe.digests(d).count() == 2 and token_counts.token_counts(d).count() == 2
    assert simhash.simhash_components(d).count() == 1 and suffixes.removed(d).count() == 1
    assert d.filter(F.col("doc_id").isNull()).count() == 1
