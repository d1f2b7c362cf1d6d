"""Edited copies of test items against alignment over whole texts."""

import numpy as np

from advisium.llm import common, decontam


def test_edited_copies(spark):
    r = np.random.default_rng(11)
    vocab = [f"w{i}" for i in range(600)]
    items = [(i, r.choice(vocab, n).tolist()) for i, n in enumerate((8, 9, 15, 20, 38, 59))]
    rows = []
    for _, item in items:
        for every in (1, 2, 3, 4, 5):
            changed = [f"new{k}" if k % every == every - 1 else w for k, w in enumerate(item)]
            inserted = [x for k, w in enumerate(item) for x in ([w, f"new{k}"] if k % every == every - 1 else [w])]
            dropped = [w for k, w in enumerate(item) if every == 1 or k % every]
            for part in (changed, inserted, dropped):
                rows.append((len(rows), " ".join(r.choice(vocab, 100).tolist() + part + r.choice(vocab, 60).tolist())))
        rows.append((len(rows), " ".join(item)))  # so intact n-grams are counted once more than edited ones
    ids = decontam.Items(items)
    whole = [ids.ids(t) for _, t in rows]
    want = set()
    for n, item in enumerate(ids.words):
        best = decontam.align([item] * len(whole), whole) / (decontam.MATCH * len(item))
        want |= {(i, n, round(float(s), 6)) for (i, _), s in zip(rows, best, strict=True) if s >= decontam.THRESHOLD}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(x.doc_id, x.item_id, round(x.score, 6)) for x in decontam.leaks(docs, bench).collect()}
    assert got == want and len(want) > 60


def frames(spark, rows, items):
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_short_items(spark):
    items = [(1, "paris france"), (2, "Yes."), (3, "one two three"), (4, "..."), (5, "a b c d"), (5, "e f g h")]
    rows = [(1, "in Paris, France it is"), (2, "paris and france"), (3, "yes"), (4, "yes no"), (5, "one two, three"), (6, "one two x three"), (7, "a b"), (8, "x b c y"), (9, "e f h"), (10, None), (11, "!")]
    got = {(x.doc_id, x.item_id, x.score) for x in decontam.leaks(*frames(spark, rows, items)).collect()}
    assert got == {(1, 1, 1.0), (3, 2, 1.0), (5, 3, 1.0), (7, 5, 0.5), (8, 5, 0.5), (9, 5, 0.625)}


def test_part_of_a_long_item(spark):
    r = np.random.default_rng(3)
    item = [f"v{k}" for k in range(300)]
    rows = [(s, " ".join([*r.choice(["x", "y", "z"], 40), *item[s : s + n], "x"])) for s, n in ((5, 140), (31, 24), (276, 24), (60, 20), (100, 12), (150, 300), (0, 10))]
    got = {x.doc_id: x.score for x in decontam.leaks(*frames(spark, rows, [(7, " ".join(item))])).collect()}
    assert set(got) == {5, 31, 276, 60, 150} and got[5] == 140 / 300 and got[150] == 0.5


def test_long_texts_in_blocks(monkeypatch):
    text = " ".join(f"Wörd{k % 50}aΣ" for k in range(900)) + " "
    whole = decontam.hashes(text)
    ids = decontam.Items([(1, ["wörd7aς", "wörd8aς"])]).ids(text)
    monkeypatch.setattr(common, "BLOCK", 50)
    assert (decontam.hashes(text) == whole).all() and len(whole) == 900 and len(decontam.hashes("")) == len(decontam.hashes(" \n ")) == 0
    assert (decontam.Items([(1, ["wörd7aς", "wörd8aς"])]).ids(text) == ids).all() and (ids > 0).sum() == 36


def test_recall_of_edits(spark):
    """Every alignment over the whole text that reaches the threshold is found, at each kind and rate of edit."""
    r = np.random.default_rng(8)
    vocab = [f"w{i}" for i in range(2000)]
    items = [(i, r.choice(vocab, int(r.integers(4, 45))).tolist()) for i in range(40)]
    rows = []
    for _, item in items:
        for every in range(2, 8):
            for kind in range(3):
                at = [k for k in range(len(item)) if k % every == every - 1]
                part = [x for k, w in enumerate(item) for x in ((w,) if k not in at else (("n",), (w, "n"), ())[kind])]
                rows.append((len(rows), " ".join(r.choice(vocab, 30).tolist() + part + r.choice(vocab, 30).tolist())))
    ids = decontam.Items(items)
    whole = [ids.ids(t) for _, t in rows]
    want = {(i, n) for n, w in enumerate(ids.words) for i, s in enumerate(decontam.align([w] * len(whole), whole)) if s >= decontam.THRESHOLD * decontam.MATCH * len(w)}
    got = {(x.doc_id, x.item_id) for x in decontam.leaks(*frames(spark, rows, [(i, " ".join(w)) for i, w in items])).collect()}
    assert got == want and len(want) > 550
