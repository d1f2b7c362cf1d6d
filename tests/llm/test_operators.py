"""The ten operators against brute force and on the edge cases that their docstrings state."""

import base64
import hashlib
import re
import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from advisium.llm import components, decontam, huffman, pii, quality_cnn, quality_rules, queries, sentencepiece_ac, simhash, token_files, token_scan, tokens, url_graph, warc
from advisium.llm.common import scratch

LONG = "Lorem ipsum dolor sit amet consectetur " * 6000
ROWS = [(1, "a b c d"), (2, None), (3, ""), (4, "a b c d"), (4, "a b c d"), (None, "x y"), (5, " \n\t "), (6, LONG), (7, "x" * 50_000), (8, "Ünïcode ﬁ 🙂▁ \x00 z")]


def docs(spark, rows=ROWS):
    """Documents with columns whose names clash with the operators' own."""
    out = spark.createDataFrame(rows, "doc_id long, text string")
    return out.selectExpr("doc_id", "text", "'en' AS lang", "cast(null AS string) AS source", "length(text) AS n_chars", "1 AS fp", "2 AS score", "'h' AS h", "3 AS component_id")


def empty(spark):
    return docs(spark, [])


# ---- 1: SimHash ----


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_groups(fps):
    ids = sorted(fps)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (fps[a] ^ fps[b]).bit_count() <= 2 and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abAB \n é.", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_anchors_meet(spark):
    """Any two fingerprints within two bits share an anchor, each within two bits of both; there are 33 or fewer."""
    r = np.random.default_rng(1)
    base = [int(x) for x in r.integers(0, 1 << 63, 20)] + [0, (1 << 64) - 1]
    pairs = []
    for x in base:
        for _ in range(20):
            a, b = r.choice(64, 2, replace=False).tolist()
            pairs += [(x, x ^ 1 << a), (x, x ^ 1 << a ^ 1 << b)]
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    rows = spark.createDataFrame([(sign(a), sign(b)) for a, b in pairs], "a long, b long")
    for a, b, x, y in rows.select("a", "b", simhash.anchors(F.col("a")), simhash.anchors(F.col("b"))).collect():
        assert set(x) & set(y)
        for fp, found in ((a, x), (b, y)):
            assert len(set(found)) == len(found) <= 33
            assert all(((fp ^ c) & (1 << 64) - 1).bit_count() <= 2 for c in found)


def test_near_duplicates(spark):
    r = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(50)]
    rows = []
    for i in range(40):
        words = r.choice(vocab, 150).tolist()
        rows.append((10 * i, " ".join(words)))
        for k in range(1, 4):
            words[int(r.integers(0, 150))] = f"new{i}{k}"
            rows.append((10 * i + k, " ".join(words)))
    rows += [(1000, None), (1001, ""), (1002, " \n")]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    fps = {i: brute_fingerprint(t) for i, t in rows}
    groups = brute_groups(fps)
    assert got == {i: (f"{fps[i]:016x}", groups[i]) for i in fps}
    assert len(set(groups.values())) < len(groups)
    kept = sorted(r.doc_id for r in simhash.deduplicate(docs(spark, rows)).collect())
    assert kept == sorted(set(groups.values()))


def test_near_duplicates_edges(spark):
    got = sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs(spark)).collect())
    fps = {i: brute_fingerprint(t) for i, t in ROWS if i is not None}
    groups = brute_groups(fps)
    assert got == sorted((i, groups[i]) for i, _ in ROWS if i is not None)
    once = simhash.deduplicate(docs(spark))
    assert once.columns == docs(spark).columns
    ids = [r.doc_id for r in once.collect()]
    assert len(ids) == len(set(ids)) and None in ids
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.deduplicate(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 3)


def test_deduplicate_looks_at_rows(spark):
    one, two, three = ("a b c d e f g", "k l m n o p q", "r s t u v w x")
    rows = [(1, one), (4, one), (4, two), (5, two), (6, three), (6, three), (0, three), (None, one), (None, one)]
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.text) for r in simhash.deduplicate(docs(spark, rows)).collect())
    assert got == [(-1, one), (-1, one), (0, three), (1, one), (4, two)]


def test_components_chain(spark):
    n = 60
    edges = [(i, i + 1) for i in range(n)] + [(5, 3), (3, 5), (7, 7)] + [(100, 100 + k) for k in range(1, 40)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {100 + k: 100 for k in range(40)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 2: PII ----


def brute_base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a0125@.-+ ()%é", max_size=40))
def test_base_spans(text):
    assert [(k, *s) for k, spans in pii.base(text).items() for s in spans] == brute_base(text)


def test_base_is_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 150_000, "a@" * 150_000, "1 " * 150_000, "." * 300_000 + "@"):
        pii.base(text)
        list(pii.candidates(text, []))
    text = "call +1 (200) 555-1000 or 4380628581791761, (333) 555-2000; a@b.cc " * 15_000  # 1 MB, 60,000 spans
    began = time.time()
    spans = [x for found in pii.base(text).values() for x in found]
    more = list(pii.candidates(text, spans))
    assert len(spans) == 45_000 and len(more) == 15_000 and time.time() - began < 60
    found, against = pii.strangers(text, lambda x: np.ones(x.shape, bool))
    assert len(against) == 2 * 30_000 and not found and time.time() - began < 90


def test_detect(spark):
    rows = [(1, "mail bob.42@mail8.example.com or +1 (988) 555-2485, card 4380628581791761 at 42.144.35.254 ok"), (2, None), (3, "é x@y.zz"), (3, "é x@y.zz"), (None, "1.2.3.4"), (4, "999.1.1.1 4380628581791762")]
    got = sorted((r.doc_id or 0, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in pii.detect(docs(spark, rows)).collect())
    want = []
    for i, t in rows:
        spans = brute_base(t or "")
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want.append((i or 0, *(sum(s[0] == k for s in spans) for k in pii.KINDS), hashlib.sha256(text.encode()).hexdigest(), text))
    assert got == sorted(want)
    assert pii.detect(empty(spark)).count() == 0


def test_discovery(spark):
    """Contexts of many seeds find forms that the base does not match; contexts of mixed instances find none."""
    rows = [(i, f"please ring me: +1 (2{i:02d}) 555-10{i:02d} today") for i in range(12)]
    rows += [(50 + i, f"please ring me: (3{i:02d}) 555-20{i:02d} today") for i in range(3)]
    rows += [(80, "an order of (333) 555-2000 pieces"), (81, "the sum 5551234567 is due")]
    got = {r.doc_id: (r.spans, r.n_found) for r in pii.detect(docs(spark, rows)).collect()}
    for i in range(3):
        start = len("please ring me: ")
        assert got[50 + i] == (f"phone:{start}:{start + 14}", 1)
    assert got[80] == ("", 0) and got[81] == ("", 0)
    out = {r.doc_id: r for r in pii.redact(docs(spark, rows + [(90, None), (91, "clean")])).collect()}
    assert out[50].text == "please ring me: [PHONE] today" and out[50].n_chars == len(out[50].text)
    assert out[0].text == "please ring me: [PHONE] today" and out[90].text is None and out[91].text == "clean"
    assert pii.redact(empty(spark)).columns == empty(spark).columns


def test_words_in_trusted_contexts(spark):
    """What no pattern of characters describes is found by where it stands, and only where nothing else stands."""
    rows = [(i, f"on file: mail u{i}@example.com now") for i in range(8)] + [(20, "on file: mail <bob-at-work7> now"), (21, "on file: mail X9 now")]
    rows += [(30 + i, f"we saw 10.0.0.{i} there") for i in range(8)] + [(40 + i, "we saw nothing there") for i in range(8)] + [(60, "we saw host77 there"), (61, "host88 is here")]
    frame = docs(spark, rows).selectExpr("*", "1 AS more", "2 AS __spans", "3 AS mentions")
    got = {r.doc_id: r.spans for r in pii.detect(frame).collect()}
    assert got[20] == "email:15:27" and got[21] == got[40] == got[60] == got[61] == ""
    out = {r.doc_id: r for r in pii.redact(frame).collect()}
    assert out[20].text == "on file: mail <[EMAIL]> now" and out[60].text == "we saw host77 there" and out[20]["__spans"] == 2 and out[20].more == 1
    assert pii.redact(frame).columns == frame.columns


def test_patterns_of_little_trust_count_together(spark, monkeypatch):
    """Patterns at which over four other words stand for each mention are none the less scored, whatever their number."""
    rows = []
    for c in "abcdef":  # each pattern's trust is 4 / 23 at first, and 1 - (19 / 23) ** 12 is over 0.8
        rows += [f"we {c}saw {x}" for x in [f"10.0.0.{i}" for i in range(4)] + [f"w{chr(97 + i)}" for i in range(17)] + ["host77"]]
    rows = list(enumerate([*rows, "so host77"]))
    for held in (pii.HELD, 1):  # counts that are sent on in parts add up
        monkeypatch.setattr(pii, "HELD", held)
        got = [(r.doc_id, r.spans) for r in pii.detect(docs(spark, rows)).where("n_found > 0").collect()]
        assert sorted(got) == [(i, "ip:8:14") for i, t in rows if t.endswith("saw host77")]


def brute_instances(edges, against, rounds, confident):
    seeds = {i: k for p, i, k, s in edges if s}
    score = {(i, k): 1.0 for i, k in seeds.items()}
    size = {}
    for p, *_ in edges:
        size[p] = size.get(p, pii.DOUBT) + 1
    for p, n in against:
        size[p] = size.get(p, pii.DOUBT) + n
    for _ in range(rounds):
        trust = {}
        for p, i, _, _ in edges:
            for k in range(4):
                if (i, k) in score:
                    trust[p, k] = trust.get((p, k), 0) + score[i, k]
        trust = {(p, k): min(x / size[p], 1 - 1e-9) for (p, k), x in trust.items()}
        miss = {}
        for p, i, kind, seed in edges:
            for k in range(4):
                if not seed and (p, k) in trust and kind in (None, k):
                    miss[i, k] = miss.get((i, k), 1.0) * (1 - trust[p, k])
        score = {(i, k): 1.0 for i, k in seeds.items()} | {x: round(1 - m, 9) for x, m in miss.items()}
    best = {}
    for (i, k), s in sorted(score.items()):
        if i not in seeds and s >= confident and s > best.get(i, (0, 0))[0]:
            best[i] = (s, k)
    return {(i, k) for i, (_, k) in best.items()}


def test_graph_scores(spark):
    r = np.random.default_rng(4)
    for rounds in (1, 3):
        kinds = {i: (int(r.integers(0, 4)), i % 2 == 0) for i in range(40)}
        edges = {(int(r.integers(0, 12)), int(i), kinds[i][0] if kinds[i][1] or i % 3 else None, kinds[i][1]) for i in r.integers(0, 40, 200)}
        edges |= {(50, i, 1, True) for i in (100, 102, 104, 106, 108)} | {(50, 101, 1, False), (50, 103, None, False), (51, 101, 1, False)}
        against = [(p, int(r.integers(0, 6))) for p in range(0, 12, 3)] + [(51, 3)]
        got = pii.instances(
            spark.createDataFrame(sorted(edges, key=str), "pattern long, instance long, kind int, seed boolean"), spark.createDataFrame(against, "pattern long, n long"), rounds, 0.6
        ).collect()
        want = brute_instances(sorted(edges, key=str), against, rounds, 0.6)
        assert {tuple(x) for x in got} == want and (101, 1) in want


def test_strangers():
    text = "  at home: +1 (200) 555-1000 or at home: 'x9-yy' at home: yes at home: a@b.cc, at home: Z1"
    found, against = pii.strangers(text, lambda x: np.arange(x.size).reshape(x.shape) % 2 == 0)  # patterns of the words before only
    words = [(m.span(), m.group()) for m in re.finditer(r"\S+", text)]
    keys = [int(pii.patterns(*(np.array([x], np.uint64) for x in pii.context(text, *s)))[0, 0]) for s, _ in words]
    phone = range(2, 5)
    assert [(text[s:e], [x % 2**64 for x in p]) for _, s, e, p in found] == [("x9-yy", [keys[8]])]
    assert sorted(against.tolist()) == sorted(keys[i] for i in range(len(words)) if i not in (*phone, 8, 14))


# ---- 3, 6: token files ----


def plain_ids(texts, special=True):
    t = tokens.Tokenizer.from_file(public_tokenizers.path(token_files.TOKENIZER))
    t.encode_special_tokens = not special
    return [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


ODD = ["a  b", " a", "a ", "a\n\nb", "x \t y", "\n", "a\nb c", "it's a  b", "The,the , x", "a  b", "mm. 'tis\n'Twas", "a\x1cb \x1c c", "<|endoftext|> x", "don't.   z", "heen, heen. heen", "a , b .c"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab'sé1,. \n\t \x1c", max_size=30))
def test_words_are_encoded_as_texts(text):
    enc = tokens.encoder(public_tokenizers.path(token_files.TOKENIZER))
    assert np.frombuffer(enc([text])[0], enc.dtype).tolist() == plain_ids([text])[0]


def test_library_sees_letters_once_and_few_words_at_a_time():
    """Marks behind letters are put together with them, and new words come in short texts."""
    enc, seen = tokens.WordEncoder(public_tokenizers.path(token_files.TOKENIZER), False), []

    class Recorded:
        def encode_batch_fast(self, found, library=enc.tokenizer, **options):
            seen.extend(found)
            return library.encode_batch_fast(found, **options)

    enc.tokenizer = Recorded()
    some = ["zorble zorble, zorble,%%% (zorb zorble*** zorble's", "a\nzorble&&& zorble_ zörble,... zorble\nzorble", " ".join(f"zo{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600))]
    assert [np.frombuffer(x, enc.dtype).tolist() for x in enc(some)] == plain_ids(some)
    words = [w for text in seen for w in text.split()]
    assert words.count("zorble") == 2 and not any(w.endswith(("%", "*", "&")) and w[0] == "z" for w in words)  # behind a space and behind a break
    assert max(len(text.split()) for text in seen) <= tokens.TOGETHER


def test_word_cache_renews(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 3)
    enc = tokens.WordEncoder(public_tokenizers.path(token_files.TOKENIZER), False)
    for k in range(6):
        some = [f"the word number {k} of, many {j}." for j in range(4)] + ODD
        assert [np.frombuffer(x, enc.dtype).tolist() for x in enc(some)] == plain_ids(some)


def test_token_files(spark, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 1 << 10)
    rows = [(i + 10, x) for i, x in enumerate(ODD)] + ROWS
    folder = scratch(spark, "test6")
    token_files.write(docs(spark, rows).repartition(3), folder)
    got = token_files.read(spark, folder).toPandas()
    ids = plain_ids([t for _, t in rows])
    full = [np.array(x + [token_files.END], "<u4") for x in ids]
    want = sorted((i if i is not None else -1, len(x), zlib.crc32(x)) for (i, _), x in zip(rows, full, strict=True))
    got["doc_id"] = got.doc_id.fillna(-1).astype(int)
    assert sorted(zip(got.doc_id, got.n_tokens, got.ids_crc32, strict=True)) == want
    got = got.sort_values("start")
    assert got.doc_id.is_monotonic_increasing and got.start.tolist() == [0, *np.cumsum(got.n_tokens)[:-1].tolist()]
    none = scratch(spark, "test6")
    token_files.write(empty(spark), none)
    assert token_files.read(spark, none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=3000), st.integers(9, 20), st.integers(1, 64))
def test_huffman(ids, limit, every):
    ids = np.array(ids)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=401), limit)
    assert lengths.max() <= limit and (0.5 ** lengths[lengths > 0].astype(float)).sum() <= 1
    bits, starts = huffman.pack(ids, huffman.aligned(lengths), lengths, every)
    out = huffman.unpack(bits, starts.astype(np.int64), every, huffman.table(lengths, limit), limit)
    assert out.reshape(-1)[: len(ids)].tolist() == ids.tolist()


def test_huffman_is_optimal():
    import heapq

    counts = np.random.default_rng(0).integers(1, 1000, 200)
    heap = sorted(counts.tolist())
    cost = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a + b
        heapq.heappush(heap, a + b)
    assert (huffman.code_lengths(counts) * counts).sum() == cost
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9, int), 3)


@pytest.mark.parametrize("block", [4, 64, 1 << 20])
def test_token_scan(spark, block):
    rows = [(i + 10, x) for i, x in enumerate(ODD)] + [r for r in ROWS if r[0] not in (6, 7)]
    folder = scratch(spark, "test3")
    named = token_scan.write(docs(spark, rows).repartition(3), folder)
    found = token_scan.scan(spark, folder, block=block).join(named, ["file", "seq"]).toPandas()
    ids = plain_ids([t for _, t in rows], special=False)
    want = sorted((i if i is not None else -1, len(x)) for (i, _), x in zip(rows, ids, strict=True))
    found["doc_id"] = found.doc_id.fillna(-1).astype(int)
    assert sorted(zip(found.doc_id, found.n_tokens, strict=True)) == want
    for _, f in found.sort_values("seq").groupby("file"):
        assert f.start.tolist() == [0, *np.cumsum(f.n_tokens + 1)[:-1].tolist()]


def test_token_scan_edges(spark, tmp_path):
    (tmp_path / "part-0.ids").write_bytes(np.array([5, 9, 9, 7, 7, 7], "<u2").tobytes())
    (tmp_path / "part-1.ids").write_bytes(b"")
    (tmp_path / "part-2.ids").write_bytes(np.array([9], "<u2").tobytes())
    got = sorted((r.file, r.seq, r.start, r.n_tokens) for r in token_scan.scan(spark, str(tmp_path), 9, block=4).collect())
    assert got == [("part-0.ids", 0, 0, 1), ("part-0.ids", 1, 2, 0), ("part-0.ids", 2, 3, 3), ("part-2.ids", 0, 0, 0)]
    assert token_scan.scan(spark, str(tmp_path / "none"), 9).count() == 0
    assert token_scan.count(empty(spark), scratch(spark, "test3")).count() == 0
    assert token_scan.count(docs(spark), scratch(spark, "test3")).count() == len(ROWS)


# ---- 4: quality network ----


def test_chunks_cover():
    for n in (0, 1, 255, 256, 257, 480, 5000):
        data = np.random.default_rng(n).integers(1, 256, n).astype(np.uint8).tobytes()  # no stretch is like another
        x = quality_cnn.chunks(data)
        seen = set()
        for row in x:
            at = data.find(bytes(row).rstrip(b"\0"))
            seen |= set(range(at, at + quality_cnn.CHUNK))
        assert seen >= set(range(n))


def test_gradient():
    r = np.random.default_rng(0)
    net = quality_cnn.Net()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = r.integers(97, 123, (6, quality_cnn.CHUNK)).astype(np.uint8)
    sizes, y = np.array([2, 1, 3]), np.array([1.0, 0.0, 1.0])
    loss = lambda: cost(net, x, sizes, y)
    g = net.gradient(x, sizes, y)
    for name, at in (("w1", (3, 5)), ("w2", (4, 2)), ("w3", (1,)), ("b1", (7,)), ("b2", (3,)), ("b3", (0,)), ("emb", (110, 2))):
        old = net.p[name][at]
        net.p[name][at] = old + 1e-6
        up = loss()
        net.p[name][at] = old - 1e-6
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / 2e-6 - g[name][at]) < 1e-4, name


def cost(net, x, sizes, y):
    h = net.chunk_features(x)
    first = np.r_[0, np.cumsum(sizes)[:-1]]
    pooled = np.concatenate([np.add.reduceat(h, first) / sizes[:, None], np.maximum.reduceat(h, first)], axis=1)
    p = 1 / (1 + np.exp(-(pooled @ net.p["w3"] + net.p["b3"])))
    return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))


def test_quality(spark, sf):
    out = queries.op4_quality_cnn(spark, sf).toPandas()
    labels = pd.read_parquet(f"{sf}/labels.parquet")
    assert out.held_out.tolist() == [zlib.crc32(str(i).encode()) % 3 == 1 for i in out.doc_id]
    assert out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.5)).all()
    m = out.merge(labels, on="doc_id")
    m = m[m.held_out]
    assert (m.predicted == m.quality).mean() > 0.95 and (m[m.quality == 1].predicted == 1).mean() > 0.98


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    net = quality_cnn.train(docs(spark), labels)
    assert net.constant is not None
    rows = quality_cnn.score(docs(spark), net).collect()
    assert len(rows) == len(ROWS) and {r.held_out for r in rows if r.doc_id is None} == {False}
    real = quality_cnn.Net()
    assert quality_cnn.score(docs(spark), real).count() == len(ROWS) and quality_cnn.score(empty(spark), real).count() == 0
    assert quality_cnn.accepted(docs(spark), real).columns == docs(spark).columns
    assert quality_cnn.train(empty(spark), labels).score([b"x"])[0] == 0.5


# ---- 5: quality rules ----


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = {g for g, n in Counter(grams).items() if n > 1}
    covered = {i + k for i, g in enumerate(grams) if g in many for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark):
    r = np.random.default_rng(5)
    rows = ROWS + [(100 + i, " ".join(r.choice(["the", "cat", "#", "a\n", "the cat\nthe", "é"], 90).tolist())) for i in range(12)] + [(200, "the cat sat on the mat with a dog " + " ".join(f"w{i}" for i in range(80)))]
    got = {}
    for x in quality_rules.judge(docs(spark, rows)).collect():
        got.setdefault(x.doc_id, []).append(x)
    for i, t in rows:
        n, *rest = brute_counts(t)
        failed = n < 50 or 100 * rest[-1] > 50 * n
        for x in got[i]:
            assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (n, *rest)
            assert x.base_failed == failed and not (failed and x.kept)
    assert got[200][0].kept and len(got[4]) == 2
    assert quality_rules.judge(empty(spark)).count() == 0
    assert not any(k in str(quality_rules.judge(docs(spark))._jdf.queryExecution().executedPlan()) for k in ("Python", "Arrow", "Exchange"))


# ---- 7: decontamination ----


def brute_align(a, b):
    rows, best = [0] * (len(b) + 1), 0
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, rows[j] + (decontam.MATCH if x == y else decontam.MISMATCH), rows[j + 1] - decontam.GAP, new[j] - decontam.GAP))
        best, rows = max(best, *new), new
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 4), min_size=1, max_size=12), st.lists(st.integers(0, 4), min_size=1, max_size=15)), min_size=1, max_size=6))
def test_align(pairs):
    got = decontam.align([np.array(a) for a, _ in pairs], [np.array(b) for _, b in pairs])
    assert got.tolist() == [brute_align(a, [x or -9 for x in b]) for a, b in pairs]


def test_leaks(spark, monkeypatch):
    r = np.random.default_rng(2)
    vocab = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(r.choice(vocab, int(r.integers(20, 45))).tolist())) for i in range(12)] + [(90, None), (91, "two words"), (None, "a b c d e"), (92, "")]
    rows = []
    for i in range(60):
        words = r.choice(vocab, 200).tolist()
        if i % 3 == 0:
            part = items[i % 12][1].split()
            for k in range(0, len(part), 7) if i % 2 else ():
                part[k] = "changed"
            words[50:50] = part
        rows.append((i, " ".join(words).upper() if i % 5 == 0 else " ".join(words)))
    rows += [(70, None), (71, ""), (None, items[0][1]), (72, items[1][1]), (72, items[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS score")
    ids = decontam.Items([(i, decontam.words(t)) for i, t in items if t and i is not None and len(t.split()) > 2])
    want = []
    for i, t in rows:
        for n, item in enumerate(ids.words):
            score = brute_align(item.tolist(), [x or -9 for x in ids.ids(t or "").tolist()]) / (2 * len(item))
            if score >= decontam.THRESHOLD:
                want.append((-1 if i is None else i, ids.item_ids[n], round(score, 6)))
    for bits in (decontam.BITS, 12):  # a filter that is too full lets more through, and loses nothing
        monkeypatch.setattr(decontam, "BITS", bits)
        got = [(-1 if x.doc_id is None else x.doc_id, x.item_id, round(x.score, 6)) for x in decontam.leaks(docs(spark, rows), bench).collect()]
        assert sorted(got) == sorted(want) and len(want) > 20
        kept = decontam.decontaminate(docs(spark, rows), bench)
        assert sorted(x.doc_id for x in kept.collect()) == sorted(i for i, _ in rows if (-1 if i is None else i) not in {w[0] for w in want})
    assert decontam.leaks(empty(spark), bench).count() == 0 and decontam.leaks(docs(spark), bench.limit(0)).count() == 0
    assert decontam.decontaminate(docs(spark), bench.limit(0)).count() == len(ROWS)


# ---- 8: URLs ----


def test_url_rules(spark):
    rows = [
        (1, "http://A.Example.COM/en/7198#top", None), (2, "https://x.org/es/", ""), (3, None, None), (4, "no scheme", "<a href='http://q/'>"), (5, "http://notcom/en/", ""), (6, "http://com/en/1?q", ""), (7, "http://shop.net/de/1", ""),
        (8, "http://w.example.net/de/8x", ""), (9, "http://w.example.net/fr", ""), (9, "http://w.example.net/fr", ""), (None, "://", ""), (10, "http://É.com/EN/", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS rule")
    got = sorted(((x.page_id or 0), x.host, x.path, x.rule, x.verdict) for x in url_graph.judge(pages).collect())
    assert got == sorted([
        (1, "a.example.com", "/en/7198", "example.com/en/7", "allow"), (2, "x.org", "/es/", "org/es/", "block"), (3, "", "", None, "allow"), (4, "", "", None, "allow"), (5, "notcom", "/en/", None, "allow"),
        (6, "com", "/en/1", "com/en/", "block"), (7, "shop.net", "/de/1", "net/de/", "allow"), (8, "w.example.net", "/de/8x", "example.net/de/8", "block"), (9, "w.example.net", "/fr", None, "block"), (9, "w.example.net", "/fr", None, "block"),
        (0, "", "", None, "allow"), (10, "É.com", "/EN/", None, "allow"),
    ], key=lambda x: (x[0], x[1]))
    assert url_graph.judge(pages.limit(0)).count() == 0


def test_propagation(spark):
    """Trust follows links, distrust goes against them; brute force by power iteration."""
    edges = [("a", "b", 2), ("b", "c", 1), ("a", "c", 1), ("d", "e", 3), ("f", "e", 1), ("c", "a", 1)]
    seeds = [("a", "t", 4), ("e", "d", 5), ("c", "d", 1)]
    got = {x.host: (x.trust, x.distrust) for x in url_graph.propagate(spark.createDataFrame(seeds, "host string, kind string, seed long"), spark.createDataFrame(edges, "src string, dst string, n long")).collect()}
    hosts = sorted({h for e in edges for h in e[:2]})
    for kind, flip in (("t", False), ("d", True)):
        seed = {h: sum(s[2] for s in seeds if s[:2] == (h, kind)) for h in hosts}
        links = [(b, a, n) if flip else (a, b, n) for a, b, n in edges]
        total = {h: sum(n for a, _, n in links if a == h) for h in hosts}
        score = dict(seed)
        for _ in range(url_graph.ROUNDS):
            score = {h: seed[h] * (1 - url_graph.DAMPING) + url_graph.DAMPING * sum(score[a] * n / total[a] for a, b, n in links if b == h) for h in hosts}
        for h in hosts:
            assert abs(got.get(h, (0, 0))[flip] - score[h]) < 1e-6
    assert got["d"][1] > 0 and got["f"][1] > 0 and got["b"][0] > 0


def test_links_move_verdicts(spark):
    rows = [(1, "http://bad.org/es/x", ""), (2, "http://friend.info/", '<a href="http://bad.org/es/x">'), (3, "http://other.info/", "<a href='/local'>"), (4, "http://good.net/de/1", '<A HREF="//third.info/p">'), (5, "http://third.info/", "")]
    got = {x.page_id: x.verdict for x in url_graph.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}


# ---- 9: SentencePiece ----


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The public pieces as a model of the kind that the library runs Viterbi over; scores of -1e9 would drown the others in its floats."""
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    with open(public_tokenizers.path(sentencepiece_ac.MODEL), "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    for p in m.pieces:
        p.score = max(p.score, -32000)
    path = tmp_path_factory.mktemp("sp") / "unigram.model"
    path.write_bytes(m.SerializeToString())
    return sentencepiece_ac.Pieces(str(path)), SentencePieceProcessor(model_file=str(path))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="theinoa \n.,é日🙂\t", max_size=30))
def test_viterbi_is_the_librarys(unigram, text):
    p, lib = unigram
    assert np.frombuffer(p.encode([text])[0], p.dtype).tolist() == lib.encode(text)


def brute_best(pieces, unknown, text):
    """Score of the best path of a marked text."""
    best = [0.0]
    for end in range(1, len(text) + 1):
        best.append(max([best[end - 1] + unknown, *(best[s] + pieces[text[s:end]] for s in range(max(0, end - 16), end) if text[s:end] in pieces)]))
    return best[-1]


def test_viterbi_is_best():
    p = sentencepiece_ac.pieces(public_tokenizers.path(sentencepiece_ac.MODEL))
    a = p.automaton
    from sentencepiece import SentencePieceProcessor

    m = SentencePieceProcessor(model_file=public_tokenizers.path(sentencepiece_ac.MODEL))
    score = {m.id_to_piece(i): m.get_score(i) for i in range(m.vocab_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))}
    of = {i: m.get_score(i) for i in range(m.vocab_size())}
    for word in ("▁thntblere", "▁heeding", "▁Anhationed,", "▁ciónquees", "▁x日y", "▁"):
        ids, took, _ = a.paths([word.encode()], p.unknown)
        total = sum(of[i] if i >= 0 else p.unknown for i in ids.tolist())
        assert total == pytest.approx(brute_best(score, p.unknown, word)) and took.sum() == len(word.encode())


def test_round_trip(spark):
    rows = ROWS + [(20 + i, x) for i, x in enumerate(ODD)]
    got = sentencepiece_ac.encode(docs(spark, rows)).toPandas()
    assert sorted(got.decoded) == sorted((t or "").replace("▁", " ") for _, t in rows)
    assert (got.ids_crc32 == [zlib.crc32(np.frombuffer(x, "<u2").astype("<u4")) for x in got.ids]).all()
    assert all(r.round_trip for r in sentencepiece_ac.round_trip(docs(spark, rows)).collect())
    assert sentencepiece_ac.round_trip(empty(spark)).count() == 0


def test_piece_cache_renews(monkeypatch):
    monkeypatch.setattr(sentencepiece_ac, "CACHE", 3)
    monkeypatch.setattr(sentencepiece_ac, "CELLS", 40)
    path = public_tokenizers.path(sentencepiece_ac.MODEL)
    p, q = sentencepiece_ac.Pieces(path), sentencepiece_ac.pieces(path)
    for k in range(5):
        some = [f"the word number {k} of many {j}" for j in range(4)] + ODD
        assert p.encode(some) == q.encode(some) and p.decode(p.encode(some)) == some


# ---- 10: WARC ----


def test_warc(spark, monkeypatch):
    monkeypatch.setattr(warc, "LINES", 3)
    rows = [(i, f"http://h{i % 3}.example.com/p{i}?q={i % 2}", f"<p>{i % 4}</p>" if i % 5 else None) for i in range(30)]
    rows += [(40, None, "é"), (41, "no scheme\nline", "x" * 200_000), (None, "http://a/", "<p>1</p>"), (42, "http://same/", "s"), (42, "http://same/", "s")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS key", "2 AS digest", "3 AS file")
    folder = scratch(spark, "test10")
    got = [tuple(x) for x in warc.captures(pages.repartition(4), folder).collect()]
    top = {}
    for i, _, h in rows:
        if i is not None:
            top[h or ""] = max(top.get(h or "", -1), i)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        to = None if i is None or i == top[h or ""] else top[h or ""]
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if to is None else "revisit", to))
    key = lambda x: tuple(-1 if y is None else y for y in x)
    twice = [w for w in want if w[0] == 42]  # rows that repeat are found once for each record
    assert sorted(set(got), key=key) == sorted(set(want), key=key) and got.count(twice[0]) == 2 and len(got) == len(want)
    one = warc.lookup(spark, spark.createDataFrame([("com,example,h1)/p1?q=1", 1), ("com,example,h1)/none", 1)], "key string, page_id long"), folder).collect()
    assert [(x.page_id, x.url, x.record_type) for x in one] == [(1, "http://h1.example.com/p1?q=1", "revisit")]
    assert warc.captures(pages.limit(0), scratch(spark, "test10")).count() == 0


def test_url_key(spark):
    rows = [("http://www.Example.COM:80/A?b#c",), ("https://u@x.y/",), (None,), ("plain",), ("http://h",)]
    got = [x[0] for x in spark.createDataFrame(rows, "u string").select(warc.url_key(F.col("u"))).collect()]
    assert got == ["com,example,www)/A?b#c", "y,x)/", "", "plain", "h)"]
