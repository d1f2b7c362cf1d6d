"""Each stage of the pipeline on its own input against brute force."""

import pandas as pd
import pytest

import corpus_pipeline
from advisium.llm import decontam, pii, quality_cnn, sentencepiece_ac
from advisium.llm.common import documents, ready

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """The documents before the first stage and after each."""
    top = tmp_path_factory.mktemp("stages")
    docs = documents(spark, sf)
    out = [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"file://{top}/{name}")
        docs = spark.read.parquet(f"file://{top}/{name}")
        out.append(docs.toPandas())
    return out


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "pii", "sentencepiece"]


def test_columns(stages):
    assert all(list(x.columns) == COLUMNS for x in stages[:-1])


def test_quality(spark, sf, stages):
    before, after = stages[0], stages[1]
    net = quality_cnn.train(documents(spark, sf), documents(spark, sf, "labels"))
    good = net.score([t.encode() for t in before.text.fillna("")]) >= 0.5
    assert sorted(after.doc_id) == sorted(before.doc_id[good])
    labels = pd.read_parquet(f"{sf}/labels.parquet").set_index("doc_id").quality
    known = before[before.doc_id.isin(labels.index)]
    kept = known.doc_id.isin(after.doc_id)
    assert kept[known.doc_id.map(labels).to_numpy() == 1].mean() > 0.98 and kept[known.doc_id.map(labels).to_numpy() == 0].mean() < 0.2


def test_near_dedup(stages):
    """All pairs of shingle sets: five words, similarity of 0.8 or more."""
    before, after = stages[1], stages[2]
    sets = {}
    for i, t in zip(before.doc_id, before.text.fillna(""), strict=True):
        words = t.lower().split() if t.isascii() else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t).encode().split()
        words = [w.encode() if isinstance(w, str) else w for w in words]
        sets[int(i)] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    ids = sorted(sets)
    label = {i: i for i in ids}
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if 4 * len(sets[a]) <= 5 * len(sets[b]) and 4 * len(sets[b]) <= 5 * len(sets[a]) and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    assert sorted(after.doc_id) == sorted(set(label.values())) and len(after) < len(before)


def test_decontamination(sf, stages):
    before, after = stages[2], stages[3]
    bench = pd.read_parquet(f"{sf}/benchmark.parquet")
    items = decontam.Items([(i, decontam.words(t)) for i, t in zip(bench.item_id, bench.text, strict=True)])
    texts = [items.ids(t) for t in before.text]
    dirty = set()
    for item in items.words:
        best = decontam.align([item] * len(texts), texts) / (decontam.MATCH * len(item))
        dirty |= {int(i) for i, s in zip(before.doc_id, best, strict=True) if s >= decontam.THRESHOLD}
    assert sorted(after.doc_id) == sorted(set(before.doc_id) - dirty) and dirty


def test_private_data(stages):
    before, after = stages[3].set_index("doc_id").text, stages[4].set_index("doc_id")
    assert sorted(before.index) == sorted(after.index)
    for i, t in before.items():
        spans = [(s, e, pii.KINDS.index(k)) for k, found in pii.base(t).items() for s, e in found]
        assert after.text[i] == pii.masked(t, spans) and after.n_chars[i] == len(after.text[i])
        assert not any(pii.base(after.text[i]).values())


def test_pieces(stages):
    before, after = stages[4].set_index("doc_id").text, stages[5].set_index("doc_id")
    assert sorted(before.index) == sorted(after.index) and set(after.columns) >= {"n_pieces", "ids", "decoded"}
    assert (after.decoded == before.reindex(after.index).str.replace(sentencepiece_ac.SPACE, " ")).all()


def test_run(spark, sf, stages):
    got = corpus_pipeline.run(spark, sf).toPandas()
    assert sorted(got.doc_id) == sorted(stages[-1].doc_id)


def test_edges(spark, sf):
    ready(spark)
    rows = [(1, "Of the a", "en", "s", 8), (None, None, None, None, None), (2, "", "en", None, 0), (2, "", "en", None, 0), (3, "x" * 30_000, "de", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, frame, sf).columns == COLUMNS
            stage(spark, frame, sf).collect()
        corpus_pipeline.STAGES[-1][1](spark, frame, sf).collect()
