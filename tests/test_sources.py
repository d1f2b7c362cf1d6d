"""CSAF files, inventories and feeds."""

import json

import pytest

from advisium.functions import keys
from advisium.operators import corpus as C
from advisium.session import numbered
from advisium.sources import csaf, inventory
from advisium.streaming import update


def write(folder, name, doc):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(doc if isinstance(doc, str) else json.dumps(doc))


def advisory(aid="ICSA-1", title="T", revised="2024-02-02", branches=(), vulns=(), **document):
    tracking = {"id": aid, "initial_release_date": "2024-01-01", "current_release_date": revised}
    return {"document": {"title": title, "tracking": tracking, "publisher": {"name": "P"}} | document, "product_tree": {"branches": list(branches)}, "vulnerabilities": list(vulns)}


def product(pid, **helper):
    return {"product_id": pid, "name": f"full {pid}", "product_identification_helper": helper}


TREE = [
    {"category": "vendor", "name": "Siemens", "branches": [
        {"category": "product_family", "name": "SIMATIC", "branches": [
            {"category": "product_name", "name": "S7-1200", "product": product("P0"), "branches": [
                {"category": "product_version_range", "name": "<V4.5", "product": product("P1", model_numbers=["M1"], skus=["K1", "K2"], cpe="cpe:2.3:h:a:b")}]}]},
        {"category": "product_name", "name": "Box", "branches": [
            {"category": "product_family", "name": "Line", "branches": [{"category": "product_version", "name": "1.0", "product": product("P2")}]},
            {"category": "legacy", "name": "x", "product": {"product_id": "P3", "name": "n3"}}]},
    ]},
    {"category": "architecture", "name": "bare", "product": {"product_id": "P4", "name": "bare name"}},
]
VULNS = [
    {"cve": "CVE-1", "title": "t", "cwe": {"id": "CWE-1"}, "product_status": {"known_affected": ["P1"], "fixed": ["P2"], "odd": ["P3"]}, "remediations": [{"category": "vendor_fix", "details": "get 5"}],
     "scores": [{"cvss_v3": {"baseScore": 7.5, "vectorString": "v3"}, "cvss_v4": {"baseScore": 6.0, "vectorString": "v4"}}, {"cvss_v2": {"baseScore": 7.5, "vectorString": "v2"}}]},
    {"remediations": [{"category": "none_available", "details": "x"}, {"category": "mitigation", "details": ""}], "scores": [{"cvss_v3": {"vectorString": "no score"}}]},
    {"cve": "CVE-3", "remediations": [{"category": "workaround", "details": "unplug"}]},
]


@pytest.fixture(scope="module")
def read(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("csaf")
    notes = [{"category": "general", "text": "general text"}, {"category": "summary", "text": "the summary"}, {"title": "Critical Infrastructure Sectors", "text": "Old"}, {"title": "critical infrastructure sectors", "text": "Energy, Water ,"}]
    write(top, "a/icsa-1.json", advisory(branches=TREE, vulns=VULNS, notes=notes, aggregate_severity={"text": "high"}, distribution={"tlp": {"label": "WHITE"}}))
    write(top, "b/no-id.json", {"document": {"title": "N"}})
    write(top, "b/bad.json", "{not json")
    write(top, "b/list.json", "[1]")
    write(top, "b/text.txt", "{}")
    write(top, "r/x2.json", advisory("X-2", "same", "2024-01-01"))
    write(top, "r/x2-new.json", advisory("X-2", "same", "2024-05-01", [{"category": "vendor", "name": "V", "product": product("N")}]))
    write(top, "X/x-3.json", advisory("X-3", "one"))
    write(top, "OT/x-3.json", advisory("X-3", "two"))
    return top, csaf.read(spark, str(top))


def test_headers(read):
    rows = {r.advisory_id: r for r in read[1].advisories.collect()}
    assert sorted(rows) == ["ICSA-1", "NO-ID", "X-2", "X-3", "X-3~1"]
    r = rows["ICSA-1"]
    assert (r.title, r.published, r.revised, r.severity, r.publisher, r.summary, r.sectors, r.tlp) == ("T", "2024-01-01", "2024-02-02", "high", "P", "the summary", ["Energy", "Water"], "WHITE")
    assert rows["X-2"].revised == "2024-05-01" and rows["X-3"].title == "one" and rows["X-3~1"].title == "two" and rows["NO-ID"].summary == ""
    assert len({r.adv_ord for r in rows.values()}) == 5


def test_tree(read):
    got = [tuple(r) for r in read[1].leaves.where("advisory_id = 'ICSA-1'").orderBy("prod_ord").select("product_id", "vendor", "product_name", "version_text", "full_name", "model_numbers", "skus", "cpe").collect()]
    assert got == [
        ("P0", "Siemens", "S7-1200", "", "full P0", [], [], ""), ("P1", "Siemens", "S7-1200", "<V4.5", "full P1", ["M1"], ["K1", "K2"], "cpe:2.3:h:a:b"), ("P2", "Siemens", "Box Line", "1.0", "full P2", [], [], ""),
        ("P3", "Siemens", "Box", "", "n3", [], [], ""), ("P4", "", "bare name", "", "bare name", [], [], ""),
    ]
    assert [r.product_id for r in read[1].leaves.where("advisory_id = 'X-2'").collect()] == ["N"]


def test_vulnerabilities(read):
    got = [tuple(r) for r in read[1].vulns.where("advisory_id = 'ICSA-1'").orderBy("vuln_ord").select("cve", "cwe", "title", "cvss_score", "cvss_vector", "known_affected", "has_remedy").collect()]
    assert got == [("CVE-1", "CWE-1", "t", 7.5, "v3", ["P1"], True), ("", "", "", None, "", [], False), ("CVE-3", "", "", None, "", [], True)]
    assert read[1].vulns.where("cve = 'CVE-1'").first().status == {"known_affected": ["P1"], "fixed": ["P2"], "odd": ["P3"]}


def test_update_stream(spark, read, tmp_path):
    """Files that arrive in two lots give the corpus that holds both, and a new revision takes the old one's place."""
    lot, folder = tmp_path / "in", str(tmp_path / "corpus")
    write(lot, "a.json", advisory("A", "old", branches=[{"category": "vendor", "name": "V", "product": product("P")}], vulns=[{"cve": "CVE-1"}]))
    update.start(spark, str(lot), folder, str(tmp_path / "ck")).awaitTermination()
    write(lot, "b.json", advisory("A", "new", vulns=[{"cve": "CVE-2"}]))
    write(lot, "c.json", advisory("B", "other"))
    update.start(spark, str(lot), folder, str(tmp_path / "ck")).awaitTermination()
    last = C.Corpus.load(spark, f"{folder}/1")
    assert sorted((r.advisory_id, r.title) for r in last.advisories.collect()) == [("A", "new"), ("B", "other")]
    assert [r.cve for r in last.vulns.collect()] == ["CVE-2"] and last.leaves.count() == 0


def test_update_stream_of_deltas(spark, tmp_path):
    """Batches between whole ones hold what arrived, and the corpus that is read is the same."""
    lot, folder = tmp_path / "in", str(tmp_path / "corpus")
    for n, files in enumerate(([("a", "A", "old"), ("b", "B", "b")], [("c", "A", "new")], [("d", "C", "c")], [("e", "B", "newer")])):
        for name, aid, title in files:
            write(lot, f"{name}.json", advisory(aid, title, vulns=[{"cve": f"CVE-{name}"}]))
        update.start(spark, str(lot), folder, str(tmp_path / "ck"), every=3).awaitTermination()
        assert C.Corpus.load(spark, f"{folder}/{n}").advisories.count() == (2, 1, 1, 3)[n]
    assert update.last(spark, folder) == 3 and update.last(spark, str(tmp_path / "none")) is None
    for n, want in ((1, {"A": "new", "B": "b"}), (2, {"A": "new", "B": "b", "C": "c"}), (None, {"A": "new", "B": "newer", "C": "c"})):
        got = update.load(spark, folder, n, 3)
        assert {r.advisory_id: r.title for r in got.advisories.collect()} == want and got.vulns.count() == len(want)
        assert got.advisories.select("adv_ord").distinct().count() == len(want)


def test_inventory(spark, tmp_path):
    path = tmp_path / "site.csv"
    path.write_text('﻿Hostname,Manufacturer,Model Name,Firmware,"Order Number",zone,extra\nh1, Siemens ,"S7, ""new""",4.2,6ES7,2,x\nh2,,,,,,\n"h3","a\nb",,,,,\n', encoding="utf-8")
    rows = [r.asDict() for r in inventory.read(spark, str(path)).orderBy("asset_ord").collect()]
    assert [(r["asset_id"], r["vendor"], r["product"], r["version"], r["model"], r["purdue_level"], r["site"], r["cpe"]) for r in rows] == [
        ("h1", "Siemens", 'S7, "new"', "4.2", "6ES7", "2", "", ""), ("h2", "", "", "", "", "", "", ""), ("h3", "a\nb", "", "", "", "", "", ""),
    ]
    (tmp_path / "other.csv").write_text("vendor,manufacturer,device\n,X,d\n")
    both = inventory.read_all(spark, [str(path), str(tmp_path / "other.csv")])
    rows = both.where("inventory = 'other'").collect()
    assert [(r.asset_id, r.vendor, r.product) for r in rows] == [("?", "", "d")]  # the first header that is there counts, though its cell is blank
    assert both.select("asset_ord").distinct().count() == 4
    assert inventory.unrecognised(C.keyed_assets(inventory.read(spark, str(path)))).count() == 1


def test_feeds(spark, tmp_path):
    (tmp_path / "kev.json").write_text(json.dumps({"vulnerabilities": [{"cveID": "CVE-1"}, {"cveID": ""}, {}, {"cveID": "CVE-1"}]}))
    assert [r.cve for r in inventory.kev(spark, str(tmp_path / "kev.json")).collect()] == ["CVE-1"]
    (tmp_path / "epss.csv").write_text("#model\ncve,epss,percentile\nCVE-1,0.5,0.9\nCVE-2,bad,1\nCVE-1,0.6,1\nX,1,1\n")
    assert [tuple(r) for r in inventory.epss(spark, str(tmp_path / "epss.csv")).collect()] == [("CVE-1", 0.6)]
    assert inventory.kev(spark, None).count() == inventory.epss(spark, None).count() == 0
    (tmp_path / "labels.csv").write_text("asset_id,advisory_id,label\n A , X ,Affected\nA,X,no\nB,X,TRUE\n,X,1\n")
    assert sorted(tuple(r) for r in inventory.read_labels(spark, str(tmp_path / "labels.csv")).collect()) == [("A", "X", False), ("B", "X", True)]


def test_alias_file():
    assert inventory.aliases("{not: [yaml") == {} and inventory.aliases("") == {}
    assert keys.alias_table({"new": ["New Spelling"]})["newspelling"] == "new"


def test_deep_trees(spark, tmp_path):
    """Branches of any depth that JSON may have are read; a deeper file is skipped, and no other with it."""
    for n in (3, 70, 480, 700):
        tree = [{"category": "product_name", "name": "leaf", "product": product(f"P{n}")}]
        for k in range(n - 1):
            tree = [{"category": "vendor" if k == n - 2 else "product_family", "name": f"b{k}", "branches": tree}]
        write(tmp_path, f"deep{n}.json", advisory(f"D{n}", branches=tree))
    got = csaf.read(spark, str(tmp_path))
    assert sorted(r.product_id for r in got.leaves.collect()) == ["P3", "P480", "P70"] and got.advisories.count() == 3


def test_numbered(spark):
    rows = spark.createDataFrame([(f"f{i:03d}", i) for i in range(200)], "path string, i long").repartition(7)
    got = sorted((r.path, r.n) for r in numbered(rows, "path", "n").collect())
    assert got == [(f"f{i:03d}", i + 1) for i in range(200)] and numbered(rows.limit(0), "path", "n").count() == 0
