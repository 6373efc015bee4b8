"""The pipeline against plain versions of its stages, over nulls, empty tables, repeats and clashing columns."""

import zlib
from collections import Counter

import numpy as np
import pytest
import corpus_pipeline
from terraloc.llm import packing, simhash, suffixes, toxicity

rng = np.random.default_rng(11)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, g int, gone_id long, part int, score double"


def words(n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "été", "naïve", "日本", "über", "foo", "bar"], n).tolist())


def corpus():
    rows = []
    for i in range(240):
        parts = [words(int(rng.integers(5, 9))) for _ in range(12)]
        if i % 5 == 0:
            parts[int(rng.integers(12))] = "you utter numskull"
        rows.append((i, ". ".join(parts)))
    clean = [t for i, t in rows if i % 5]
    shared = "é" + words(60)
    rows += [(300, clean[3]), (301, clean[3] + " x"), (302, words(40) + shared + words(9)), (303, shared + words(30)), (304, None), (305, ""), (306, None), (307, "日" * 70), (308, "本" + "日" * 90), (7, rows[7][1]), (None, clean[4]), (None, None), (309, words(3000))]
    return [(i, t, "en", "s", None if t is None else len(t), "r", 1, 2, 3, 0.5) for i, t in rows]


def write(spark, folder, rows):
    labels = [(i, None, int(i % 5 == 0)) for i in range(240)] + [(None, 1, 1), (300, 1, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def plain(rows, model):
    """doc_id and text of what the first three stages keep."""
    hits = toxicity._Hits(model.weights)
    kept = [r[:2] for r in rows if toxicity.score_text(r[1] or "", model, hits)[0] < toxicity.THRESHOLD]
    nodes = [(i, simhash.fingerprint((t or "").encode())) for i, t in kept if i is not None]
    least = {}
    for i, fp in nodes:
        seen, todo = {fp}, [fp]
        while todo:
            at = todo.pop()
            near = {f for _, f in nodes if (f ^ at).bit_count() <= simhash.MAX_BITS} - seen
            seen |= near
            todo += near
        least[i] = min(j for j, f in nodes if f in seen)
    kept = [(i, t) for i, t in kept if i is None or least[i] == i]
    first = {}
    for i, t in kept:
        b = (t or "").encode()
        for k in range(len(b) - 49) if i is not None else ():
            first[b[k : k + 50]] = min(i, first.get(b[k : k + 50], i))
    out = []
    for i, t in kept:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - 49) if i is not None else ():
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = 1
        turn = np.diff(np.concatenate(([0], gone)))
        spans = suffixes.whole_characters(b, np.stack((np.nonzero(turn > 0)[0], np.nonzero(turn < 0)[0]), 1))
        out.append((i, suffixes.kept_bytes(b, spans).decode() if len(spans) else t))
    return out


def test_stages_equal_plain_versions(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = corpus()
    write(spark, tmp_path, rows)
    seen, docs = [], spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        docs = corpus_pipeline.save(out, name)
        seen.append(docs.count())
    want = plain(rows, model)
    assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=str) == sorted(want, key=str)
    assert [r for r in docs.collect() if r.text is not None and r.n_chars != len(r.text)] == []
    assert len(rows) > seen[0] > seen[1] == seen[2] and not {i for i, _ in want} & {300, 305, 306}
    lib = Tokenizer.from_file(packing.default_vocabulary())
    need = Counter()
    for i, t in want:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, packing.END], "<u4")
        need.update((i, a, len(ids[a : a + packing.SEQUENCE]), zlib.crc32(ids[a : a + packing.SEQUENCE].tobytes()), len(ids)) for a in range(0, len(ids), packing.SEQUENCE))
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    own = Counter((None if np.isnan(r.doc_id) else int(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got.itertuples())
    assert own == need
    g = got.sort_values(["sequence_id", "offset"])
    assert ((g.groupby("sequence_id").length.cumsum() - g.length) == g.offset).all() and g.groupby("sequence_id").length.sum().max() <= packing.SEQUENCE
    assert g.sequence_id.nunique() <= got.length.sum() / packing.SEQUENCE * 1.1 + 1


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None, None, None, None, None, None)]])
def test_pipeline_over_tables_without_texts(spark, tmp_path, rows):
    write(spark, tmp_path, rows)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(rows)


def test_near_dedup_broadcasts_no_table_that_grows_with_the_documents(spark):
    docs = spark.createDataFrame([(i, words(30)) for i in range(20)], "doc_id long, text string")
    plan = simhash.near_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
