"""Commands from files to files."""

import json

import pytest

from advisium import cli
from tests.test_sources import TREE, VULNS, advisory, write


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("cli")
    write(top, "csaf/a.json", advisory("ICSA-24-001", branches=TREE, vulns=VULNS))
    write(top, "csaf/b.json", advisory("ICSA-24-002", "Valve"))
    (top / "inv").mkdir()
    (top / "inv" / "east.csv").write_text("id,vendor,product,firmware,zone\nE1,Siemens,S7-1200,4.2,1\n")
    (top / "inv" / "west.csv").write_text("id,vendor,product,firmware,zone\nW1,Siemens,S7-1200,5.0,1\nW2,Siemens,S7-1200,4.0,1\n")
    (top / "labels.csv").write_text("asset_id,advisory_id,label\nE1,ICSA-24-001,affected\n")
    assert cli.main(["--corpus", str(top / "c"), "update", str(top / "csaf")]) == 0
    return top


def command(place, *args):
    return cli.main(["--corpus", str(place / "c"), *args])


def test_match(place, capfd):
    assert command(place, "match", str(place / "inv" / "east.csv"), "--json") == 0
    out = capfd.readouterr().out
    (row,) = json.loads(out[out.index("[\n") :])
    assert (row["asset_id"], row["advisory_id"], row["match_tier"], row["cves"]) == ("E1", "ICSA-24-001", 3, ["CVE-1"])


def test_report_and_diff(place):
    out = place / "reports"
    assert command(place, "report", str(place / "inv"), "--out", str(out)) == 0
    assert sorted(p.name for p in out.iterdir()) == ["east.md", "portfolio.md", "west.md"]
    assert "`E1`" in (out / "east.md").read_text() and "E1" not in (out / "portfolio.md").read_text()
    assert command(place, "diff", "east") == 1
    assert command(place, "report", str(place / "inv" / "east.csv"), "--out", str(out)) == 0
    assert command(place, "diff", "east") == 0


@pytest.mark.parametrize("args", [["stats", "--by-year"], ["coverage"], ["search", "valve"], ["aliases"]])
def test_reading(place, args):
    assert command(place, *args) == 0


def test_eval_and_vex(place, capfd):
    assert command(place, "eval", str(place / "inv" / "east.csv"), str(place / "labels.csv"), "--min-precision", "0.9") == 0
    capfd.readouterr()
    assert command(place, "vex", str(place / "inv" / "east.csv")) == 0
    out = capfd.readouterr().out
    assert json.loads(out[out.index("{\n") :])["statements"]


def test_review_and_decide(place, capfd, monkeypatch):
    """An answer is on file, and the next match goes by it."""
    (place / "fuzzy.csv").write_text("id,vendor,product,firmware\nF1,Siemans AG Works,S7-1200x,4.0\n")
    (place / "more.yaml").write_text("vendor_aliases:\n  siemens: [Siemans AG Works]\n")
    common = ["--corpus", str(place / "c"), "--vendor-aliases", str(place / "more.yaml")]
    answers = iter("y" * 50)
    monkeypatch.setattr("builtins.input", lambda *_: next(answers))
    assert cli.main([*common, "review", str(place / "fuzzy.csv"), "--max-tier", "5", "--analyst", "ann"]) == 0
    out = capfd.readouterr().out
    assert "S7-1200x" in out and "CONFIRMED" in out
    assert command(place, "aliases", "--json") == 0
    out = capfd.readouterr().out
    assert {r["asset_product"] for r in json.loads(out[out.index("[\n") :])} == {"S7-1200x"}
    assert cli.main([*common, "match", str(place / "fuzzy.csv"), "--json"]) == 0
    out = capfd.readouterr().out
    row = json.loads(out[out.index("[\n") :])[0]
    assert row["match_tier"] == 0 and "by ann" in row["match_basis"]
    assert cli.main([*common, "decide", "siemens", "s71200x", "s71200", "rejected", "--analyst", "bob"]) == 0
    assert command(place, "aliases", "--json") == 0 and cli.main([*common, "match", str(place / "fuzzy.csv"), "--out", str(place / "lines")]) == 0
    assert not [x for p in (place / "lines").glob("*.txt") for x in p.read_text().splitlines()]
    monkeypatch.setattr("builtins.input", lambda *_: (_ for _ in ()).throw(EOFError))
    assert cli.main([*common, "review", str(place / "fuzzy.csv"), "--max-tier", "5"]) == 0
    (place / "c" / "decisions.csv").unlink()


def test_files(place, tmp_path):
    assert command(place, "vex", str(place / "inv" / "east.csv"), "--out", str(tmp_path / "v.json")) == 0
    assert json.loads((tmp_path / "v.json").read_text())["statements"]
    assert command(place, "coverage", "--source", str(place / "csaf")) == 0
    assert command(place, "report", str(place / "inv" / "east.csv"), "--out", str(tmp_path), "--client", "plant") == 0
    assert "plant" in (tmp_path / "plant.md").read_text()
