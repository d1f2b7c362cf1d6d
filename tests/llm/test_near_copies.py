"""The pipeline's near copies against all pairs."""

import numpy as np

import corpus_pipeline
from advisium.llm import near_copies, simhash


def sets(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """Smallest doc_id of each group that pairs of 0.8 or more join."""
    found = [(i, sets(t)) for i, t in rows]
    label = [i for i, _ in found]
    changed = True
    while changed:
        changed = False
        for a, (_, x) in enumerate(found):
            for b, (_, y) in enumerate(found):
                if label[b] < label[a] and 5 * len(x & y) >= 4 * len(x | y):
                    label[a], changed = label[b], True
    return label


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "length(text) AS n_chars")


def corpus():
    r = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(400)]
    line = r.choice(vocab, 30).tolist()  # a line that many hold
    rows = []
    for i in range(30):
        n = int(r.integers(1, 220))
        words = r.choice(vocab, n).tolist() + (line if i % 3 else [])
        rows.append((10 * i, " ".join(words)))
        for k in range(1, 5):
            for _ in range(max(1, n // 100)):
                words[int(r.integers(0, len(words)))] = f"new{i}{k}"
            if k == 3:
                words = words[: max(1, len(words) * 9 // 10)]
            rows.append((10 * i + k, " ".join(words)))
    return [*rows, (1000, None), (1001, ""), (1002, " \n"), (1003, "two words"), (1004, "TWO  words")]


def test_stage_takes_copies_of_four_fifths(spark):
    rows = corpus()
    want = sorted(set(brute(rows)))
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, frame(spark, rows), None).collect())
    assert got == want
    fps = {i: simhash.fingerprint(t or "") for i, t in rows}
    far = [i for i in fps if i not in want and all((fps[i] ^ fps[k]).bit_count() > 2 for k in fps if k != i)]
    assert far  # copies that no pair of fingerprints within two bits shows


def test_bands_hold_all_links():
    """Sets of similarity 0.8 share a key, but for fewer than one pair in a million; those of 0.1 nearly never do."""
    r = np.random.default_rng(6)
    for n in (5, 12, 40, 300):
        shared = 0
        for _ in range(300):
            pool = r.integers(0, 1 << 63, n + n, np.uint64)
            k = max(1, n // 10)  # n - k in common of n + k: just over 0.8
            a, b = np.unique(pool[:n]), np.unique(pool[k : n + k])
            assert not near_copies.alike(a, b) or np.intersect1d(near_copies.bands(a), near_copies.bands(b)).size
            c = np.unique(np.concatenate([pool[: n // 5], pool[n : n + n - n // 5]]))
            shared += bool(np.intersect1d(near_copies.bands(a), near_copies.bands(c)).size)
        assert n < 12 or shared < 10
    assert near_copies.bands(near_copies.shingles("")).size == 0 and near_copies.bands(near_copies.shingles("a")).size == near_copies.BANDS


def test_rows_not_ids(spark):
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, one), (2, one), (2, two), (3, two), (3, two), (None, one), (None, one)]
    got = sorted((r.doc_id or 0, r.text) for r in near_copies.deduplicate(frame(spark, rows)).collect())
    assert got == [(0, one), (0, one), (1, one), (2, two)]
    assert near_copies.deduplicate(frame(spark, [])).count() == 0


def test_large_components_in_blocks(spark, monkeypatch):
    """A group of copies of one text, edited apart, that is far over a block's weight."""
    monkeypatch.setattr(near_copies, "WEIGHT", 900)
    r = np.random.default_rng(9)
    text = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(60):
        words = list(text)
        for k in r.choice(120, int(r.integers(0, 5)), replace=False):
            words[k] = f"new{i}"
        rows.append((i, " ".join(words)))
    sets = spark.createDataFrame([(h, 100, 1) for h in range(50)], "h long, n int, root long")
    units = [(x.i, x.j, x.h) for x in near_copies._units(sets).collect()]
    together = {(a, b) for i, j, a in units for k, m, b in units if (i, j) == (k, m)}
    assert len(together) == 50 * 50 and max(sum(u[:2] == (i, j) for u in units) for i, j, _ in units) < 40
    rows += [(100 + i, t) for i, t in corpus()]
    got = sorted(x.doc_id for x in near_copies.deduplicate(frame(spark, rows)).collect())
    assert got == sorted(set(brute(rows)))


def test_ties_over_partitions(spark):
    """Neighbours of a key are tied wherever partitions end."""
    rows = spark.createDataFrame([(7, 10 + h // 100, h) for h in range(300)] + [(8, 1, 1), (8, 9, 2), (9, 5, 3)], "key long, n int, h long").repartition(4)
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        got = {(x.a, x.b) for x in near_copies._ties(rows).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert got == {(h + 1, h) for h in range(299)}
