"""The cascade on small corpora."""

import pytest
from pyspark.sql import functions as F

from advisium.operators import corpus as C
from advisium.operators import match
from advisium.session import kept
from tests.factories import assets, corpus, decisions, leaf, vuln


def run(spark, cases, max_tier=5, **kw):
    """What each case finds. All are matched at once: each has vendors, identifiers and ids of its own."""
    rows, advisories, ruled = [], [], []
    for n, (asset, advs, *decided) in enumerate(cases):
        own = lambda x, n=n: f"{x}{n}" if x else x
        a = {"vendor": "Siemens", "model": "", "cpe": ""} | asset
        rows.append(a | {"vendor": own(a["vendor"]), "model": own(a["model"]), "cpe": a["cpe"].replace("S7", own("S7"))})
        for aid, leaves, vulns in advs:
            made = [x | {"vendor": own(x["vendor"]), "skus": list(map(own, x["skus"])), "cpe": x["cpe"].replace("s7", own("s7"))} for x in leaves]
            advisories.append((f"{n}/{aid}", made, vulns))
        ruled += [(own("siemens"), *d) for d in decided]
    found = match.match_assets(assets(spark, *rows), corpus(spark, *advisories), max_tier, decisions(spark, *ruled) if ruled else None, **kw).collect()
    out = [[] for _ in cases]
    for r in found:
        n, aid = r.advisory_id.split("/")
        assert int(n) == r.asset_ord
        out[r.asset_ord].append((aid, r.tier, r.verdict, round(r.confidence, 3)))
    return [sorted(x) for x in out]


RANGED = [("A", [leaf(version="<V4.5")], [vuln()])]
IDENT = [("A", [leaf(vendor="Other", product="thing", version="<4.5", skus=["6ES7 214-1AG40"])], [vuln()])]
MODEL = {"model": "6es7214-1ag40", "product": "nothing alike"}
CPE = ({"cpe": "CPE:2.3:H:SIEMENS:S7:9:*", "vendor": "", "product": ""}, [("A", [leaf(product="x", version="<1", cpe="cpe:2.3:h:siemens:s7:1:*")], [vuln()])])
CLEARED = [("A", [leaf()], [vuln(known_not_affected=["P1"])])]
FIRST = ({}, [("A", [leaf("P1", product="other one"), leaf("P2", product="other two")], [vuln(known_not_affected=["P1"], known_affected=["P2"])])])
BIOS = [("A", [leaf(version="<BIOS_V2")], [vuln()])]

#: Asset, advisories, what is found up to tier 5 with cleared pairs, and up to tier 4 without.
CASES = [
    ({}, RANGED, [("A", 3, "AFFECTED", 0.85)], [("A", 3, "AFFECTED", 0.85)]),
    ({"version": "5.0"}, RANGED, [("A", 5, "MANUAL", 0.3)], []),
    ({"version": "what"}, RANGED, [("A", 3, "UNKNOWN", 0.5)], [("A", 3, "UNKNOWN", 0.5)]),
    (MODEL, IDENT, [("A", 1, "AFFECTED", 1.0)], [("A", 1, "AFFECTED", 1.0)]),
    (MODEL | {"version": ""}, IDENT, [("A", 1, "AFFECTED", 1.0)], [("A", 1, "AFFECTED", 1.0)]),
    (MODEL | {"version": "bad"}, IDENT, [("A", 1, "UNKNOWN", 0.7)], [("A", 1, "UNKNOWN", 0.7)]),
    (MODEL | {"version": "9.9"}, IDENT, [("A", 1, "NOT_AFFECTED", 1.0)], []),
    (*CPE, [("A", 2, "AFFECTED", 0.95)], [("A", 2, "AFFECTED", 0.95)]),
    ({"product": "SIPROTEC 5"}, [("A", [leaf(product="SICAM 5")], [vuln()])], [("A", 5, "MANUAL", 0.3)], []),
    ({"product": "5"}, [("A", [leaf(product="SICAM 5")], [vuln()])], [("A", 4, "REVIEW", 0.45)], [("A", 4, "REVIEW", 0.45)]),
    ({"product": "SINAMICS S7-1200"}, [("A", [leaf()], [vuln()])], [("A", 4, "REVIEW", 0.6)], [("A", 4, "REVIEW", 0.6)]),
    ({"product": "SCALANCE XR328-4C"}, [("A", [leaf(product="SCALANCE XR326-4C")], [vuln()])], [("A", 4, "REVIEW", 0.56)], [("A", 4, "REVIEW", 0.56)]),
    ({}, CLEARED, [("A", 3, "NOT_AFFECTED", 0.85)], []),
    ({}, [("A", [leaf()], [vuln(fixed=["P1"])])], [("A", 3, "NOT_AFFECTED", 0.85)], []),
    ({}, [("A", [leaf()], [vuln(fixed=["P1"]), vuln("CVE-2", known_affected=["P1"])])], [("A", 3, "AFFECTED", 0.85)], [("A", 3, "AFFECTED", 0.85)]),
    ({}, [("A", [leaf()], [vuln(under_investigation=["P1"])])], [("A", 3, "UNKNOWN", 0.85)], [("A", 3, "UNKNOWN", 0.85)]),
    ({}, [("A", [leaf()], [vuln(recommended=["P1"])])], [("A", 3, "AFFECTED", 0.85)], [("A", 3, "AFFECTED", 0.85)]),
    ({}, [("A", [leaf()], [vuln(nonsense=["P1"])])], [("A", 3, "AFFECTED", 0.85)], [("A", 3, "AFFECTED", 0.85)]),
    # a cleared leaf hides no other
    ({"model": "M1"}, [("A", [leaf("P1", version="<1", skus=["M1"]), leaf("P2")], [vuln()])], [("A", 3, "AFFECTED", 0.85)], [("A", 3, "AFFECTED", 0.85)]),
    # but at tier 5 an advisory's first leaf stands for it
    (*FIRST, [("A", 5, "NOT_AFFECTED", 0.3)], []),
    ({"version": "1.0"}, BIOS, [("A", 3, "UNKNOWN", 0.5)], [("A", 3, "UNKNOWN", 0.5)]),
    ({"version": "BIOS 1.0"}, BIOS, [("A", 3, "AFFECTED", 0.85)], [("A", 3, "AFFECTED", 0.85)]),
]


def test_tiers(spark):
    assert run(spark, [c[:2] for c in CASES], include_not_affected=True) == [c[2] for c in CASES]


def test_tiers_without_vendor_only(spark):
    assert run(spark, [c[:2] for c in CASES], 4) == [c[3] for c in CASES]


def test_options(spark):
    assert run(spark, [CPE, FIRST], cpe_check_version=True, strict_clear=True) == [[], [("A", 5, "MANUAL", 0.3)]]


def test_decisions(spark):
    box, two = {"product": "old box"}, [("A", [leaf(version="<4.5"), leaf("P2", product="unlike")], [vuln()])]
    ranged = [("A", [leaf(version="<4.5")], [vuln()])]
    yes, no, later = (("oldbox", "simatics71200", d) for d in ("CONFIRMED", "REJECTED", "DEFERRED"))
    cases = [
        (box, ranged, yes, [("A", 0, "AFFECTED", 1.0)]), (box | {"version": "5"}, ranged, yes, []), (box | {"version": ""}, ranged, yes, [("A", 0, "UNKNOWN", 1.0)]), (box, ranged, no, [("A", 0, "NOT_AFFECTED", 1.0)]),
        (box, ranged, later, [("A", 5, "MANUAL", 0.3)]), (box | {"version": "5"}, two, yes, [("A", 5, "MANUAL", 0.3)]), (box, CLEARED, yes, [("A", 0, "NOT_AFFECTED", 1.0)]),
    ]
    assert run(spark, [c[:3] for c in cases], include_not_affected=True) == [c[3] for c in cases]


def test_twins_differ_by_what_is_their_own(spark):
    """Assets of one vendor, product and version are matched once; what an identifier finds is one asset's."""
    advs = [("A", [leaf(version="<4.5")], [vuln()]), ("B", [leaf(vendor="Other", product="thing", skus=["M1"])], [vuln()]), ("C", [leaf(version="<9", skus=["M1"])], [vuln()]), ("D", [leaf(product="unlike", skus=["M2"], version="<1")], [vuln()])]
    a = assets(spark, {"model": "M1"}, {}, {"model": "M2"}, {"version": "5.0"})
    found = match.match_assets(a, corpus(spark, *advs), 5, include_not_affected=True).collect()
    got = sorted((r.asset_ord, r.advisory_id, r.tier, r.verdict) for r in found)
    three, five = lambda n, x: (n, x, 3, "AFFECTED"), lambda n, x: (n, x, 5, "MANUAL")
    assert got == sorted([
        three(0, "A"), (0, "B", 1, "AFFECTED"), (0, "C", 1, "AFFECTED"), five(0, "D"), three(1, "A"), three(1, "C"), five(1, "D"),
        three(2, "A"), three(2, "C"), (2, "D", 1, "NOT_AFFECTED"), five(3, "A"), three(3, "C"), five(3, "D"),
    ])


def test_pairs_are_not_shuffled(spark):
    """From where tiers meet up to the findings no row goes to another task."""
    out = match.match_assets(assets(spark, {}), corpus(spark, ("A", [leaf()], [vuln()])), 5)

    def above(node, path):
        if node.nodeName() == "Union":
            return [path]
        children = [node.children().apply(i) for i in range(node.children().size())]
        return [p for c in children for p in above(c, [*path, node.nodeName()])]

    paths = above(out._jdf.queryExecution().executedPlan().executedPlan(), [])
    assert paths and not [p for p in paths[:1] if any("Exchange" in x for x in p)]


def test_scores_are_the_products_own(spark):
    adv = ("A", [leaf("P1"), leaf("P2", product="unlike")], [vuln("CVE-1", 5.0, "v1", known_affected=["P1"]), vuln("CVE-2", 9.0, "v2", remedy=False, known_affected=["P2"]), vuln("CVE-3", None, known_affected=["P1"]), vuln("CVE-4", 5.0, "v4", known_affected=["P1"])])
    (r,) = match.match_assets(assets(spark, {}), corpus(spark, adv), 4).collect()
    assert (r.cves, r.cvss, r.cvss_vector, r.has_patch) == (["CVE-1", "CVE-3", "CVE-4"], 5.0, "v1", True)
    other = ("A", [leaf("P1")], [vuln("CVE-1", 5.0, "v1", known_affected=["Q"]), vuln("CVE-2", 7.0, "v2", remedy=False, known_affected=["Q"])])
    (r,) = match.match_assets(assets(spark, {}), corpus(spark, other), 4).collect()
    assert (r.cves, r.cvss, r.cvss_vector, r.has_patch) == (["CVE-1", "CVE-2"], 7.0, "v2", True)


def test_basis(spark):
    adv = ("A", [leaf(version="<V4.5", skus=["M-1"])], [vuln()])
    cases = [
        ({"model": "m1"}, "model/SKU 'm1' matches advisory identifier 'M-1'; <V4.5"),
        ({"model": "m1", "version": ""}, "model/SKU 'm1' matches advisory identifier 'M-1'"),
        ({"model": "m1", "version": "5"}, "model/SKU 'm1' matches advisory identifier 'M-1'; asset version 5 is outside <V4.5"),
        ({}, "vendor+product match; asset version 4.2.1 satisfies <V4.5"),
        ({"version": "it's"}, "vendor+product match but asset version \"it's\" unparseable"),
        ({"product": "else"}, "analyst-confirmed alias 'else' = 'simatics71200' by ann on 2024-05-01; <V4.5"),
        ({"product": "unlike"}, "vendor 'Siemens' matches; product 'SIMATIC S7-1200' not confirmed against 'unlike'"),
    ]
    yes = decisions(spark, ("siemens", "else", "simatics71200", "CONFIRMED"))
    rows = match.match_assets(assets(spark, *(a for a, _ in cases)), corpus(spark, adv), 5, yes, include_not_affected=True).collect()
    assert {r.asset_ord: r.basis for r in rows} == dict(enumerate(b for _, b in cases))


def test_one_row_for_each_pair_in_any_order(spark):
    advs = [(f"A{n}", [leaf("P1"), leaf("P2", product="SIMATIC S7-1500"), leaf("P3", version="<1")], [vuln()]) for n in range(3)]
    a = assets(spark, {}, {"product": "S7-1500"}, {"asset_id": "A0", "product": "S7-1500"})
    c = corpus(spark, *advs)
    want = None
    for n in range(3):
        mixed = C.Corpus(c.advisories, c.leaves.orderBy(F.rand(n)), c.vulns.orderBy(F.rand(n)))
        got = sorted((r.asset_ord, r.advisory_id, r.product_id, r.tier) for r in match.match_assets(a.orderBy(F.rand(n)), mixed, 5).collect())
        assert len({x[:2] for x in got}) == len(got) == 9 and want in (None, got)
        want = got


def test_order(spark):
    advs = [("A", [leaf()], [vuln(score=5.0)]), ("B", [leaf()], [vuln(score=9.0)]), ("C", [leaf(product="SICAM S7-1200")], [vuln(score=10.0)])]
    assert [r.advisory_id for r in match.in_order(match.match_assets(assets(spark, {"product": "SIMATIC S7-1200"}), corpus(spark, *advs), 4)).collect()] == ["B", "A", "C"]


def test_near_misses(spark):
    c = corpus(spark, ("A", [leaf(vendor="Phoenix Contact"), leaf("P2", vendor="Wago"), leaf("P3", vendor="Wagon Works")], [vuln()]))
    a = assets(spark, {"vendor": "Phoenix"}, {"vendor": "Wagonia"}, {"vendor": "Wago"}, {"vendor": "Nothing"}, {"vendor": ""})
    assert sorted(tuple(r) for r in match.near_misses(a, c).collect()) == [("phoenix", "phoenixcontact"), ("wagonia", "wago")]


def test_empty(spark):
    c = corpus(spark, ("A", [leaf()], [vuln()]))
    none = C.Corpus(c.advisories.limit(0), c.leaves.limit(0), c.vulns.limit(0))
    assert match.match_assets(assets(spark, {}), none).count() == 0 and match.match_assets(assets(spark, {}).limit(0), c).count() == 0


def test_corpus_tables(spark, tmp_path):
    c = corpus(spark, ("A", [leaf("P1", version="1"), leaf("P1", version="2")], [vuln("CVE-1", 1.0), vuln("CVE-1", 2.0), vuln("", 3.0)]), ("B", [leaf()], [vuln()]))
    s = c.stored()
    assert [r.version_text for r in s.leaves.where("advisory_id = 'A'").collect()] == ["2"] and [r.cvss_score for r in s.vulns.where("advisory_id = 'A'").collect()] == [2.0]
    s.save(str(tmp_path / "c"))
    back = C.Corpus.load(spark, str(tmp_path / "c"))
    new = corpus(spark, ("A", [leaf("P9")], [vuln()]))
    merged = back.upsert(new)
    assert sorted(r.product_id for r in merged.leaves.collect()) == ["P1", "P9"] and merged.advisories.count() == 2


@pytest.mark.parametrize("titles, want", [(("T", "T"), ["X"]), (("T", "U"), ["X", "X~1"])])
def test_revisions(spark, titles, want):
    rows = [("X", titles[0], "2024", "2024", "/c/OT/other.json"), ("X", titles[1], "2023", "2024", "/c/X/x.json")]
    got = {r.advisory_id: r.source_path for r in C.revisions(spark.createDataFrame(rows, "advisory_id string, title string, revised string, published string, source_path string")).collect()}
    assert sorted(got) == want and got["X"] == ("/c/OT/other.json" if len(want) == 1 else "/c/X/x.json")


def test_salted_vendors(spark, monkeypatch):
    """A vendor of many pairs is dealt out to more tasks, and no pair is lost or made twice."""
    monkeypatch.setattr(match, "PAIRS", 50)
    x = spark.createDataFrame([("a", i) for i in range(30)] + [("b", 100)], "vendor_key string, n long")
    y = spark.createDataFrame([("a", f"k{i}") for i in range(40)] + [("b", "z"), ("c", "y")], "vendor_key string, k string")
    p, q = match.salted(x, y, "k")
    assert q.where("vendor_key = 'a'").select("salt").distinct().count() > 10
    got = sorted((r.n, r.k) for r in p.join(q, ["vendor_key", "salt"]).collect())
    assert got == sorted([(i, f"k{k}") for i in range(30) for k in range(40)] + [(100, "z")])


def test_gate_holds_one_number(spark):
    """What is stated of a product is gathered as bits of one number, not as a column for each status."""
    c = corpus(spark, ("A", [leaf("P1"), leaf("P2"), leaf("P3")], [vuln(fixed=["P1"], known_not_affected=["P2"]), vuln(first_fixed=["P3"], under_investigation=["P3"])]))
    out = C.status_gate(c.vulns)
    assert {r.product_id: (r.keep, "lists" in r.gate_note) for r in out.collect()} == {"P1": (False, True), "P2": (False, False), "P3": (True, True)}
    assert "bit_or" in out._jdf.queryExecution().optimizedPlan().toString() and "bool_or" not in out._jdf.queryExecution().analyzed().toString()


def test_kept(spark):
    rows = spark.createDataFrame([(1, ["a"], {"k": ["v"]}), (2, None, None)], "n long, x array<string>, m map<string,array<string>>")
    back = kept(rows)
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect())) and back.schema.simpleString() == rows.schema.simpleString()
    assert kept(rows.limit(0)).count() == 0
