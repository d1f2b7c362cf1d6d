"""Truth tables of the scalar functions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from advisium.functions import keys, priority, similarity, text, versions
from advisium.functions.expr import quoted


def column(spark, rows, build, names="x string"):
    df = spark.createDataFrame([(r if isinstance(r, tuple) else (r,)) for r in rows], names)
    return [r[0] for r in df.coalesce(1).select(build).collect()]


def test_vendor_equivalence(spark):
    same = [("Siemens AG", "siemens"), ("Allen-Bradley", "Rockwell Automation"), ("Schneider Electric Software, LLC", "Schneider Electric"), ("GE Digital", "General Electric"), ("Acme Corp.", "ACME Inc"), ("ABB Power Grids", "Hitachi Energy")]
    for a, b in same:
        x, y = column(spark, [a, b], keys.vendor_key("x"))
        assert x == y != ""
    assert column(spark, ["", None, "Electric", "ABB", "ABB Power Grids"], keys.vendor_key("x")) == ["", "", "electric", "abb", "hitachienergy"]
    extra = keys.alias_table({"acme": ["road runner supplies"]})
    assert column(spark, ["Road Runner Supplies", "Siemens"], keys.vendor_key("x", extra)) == ["acme", "siemens"]


@pytest.mark.parametrize(
    "name, vendor, want",
    [
        ("SIMATIC S7-1200 CPU family", "siemens", ("simatic", "s71200")), ("SIPROTEC 5", "", ("siprotec", "5")), ("Allen-Bradley MicroLogix 1400", "rockwell", ("micrologix", "1400")), ("Modicon M580", "schneider", ("", "m580")),
        ("Modicon M580", "", ("modicon", "m580")), ("SCALANCE X208 (incl. SIPLUS variants)", "", ("scalance", "x208")), ("LOGO! (6ED1052)", "", ("", "logo6ed1052")), ("Comfort Panels", "", ("", "comfortpanel")),
        ("Access Bus Status", "", ("", "accessbusstatus")), ("SIMATIC", "", ("simatic", "simatic")), ("SIMATIC SIPLUS S7", "", ("simatic", "s7")), ("S7-1500 Software Controller", "", ("", "s71500software")), ("", "", ("", "")), (None, "", ("", "")),
    ],
)
def test_product_key(spark, name, vendor, want):
    (k,) = column(spark, [(name,)], keys.product_key("x", F.lit(vendor)))
    assert (k.brand, k.core) == want and k.full == want[0] + want[1]


def test_agreement(spark):
    def agree(a, b):
        return column(spark, [(a, b)], keys.keys_agree(keys.product_key("x"), keys.product_key("y")), "x string, y string")[0]

    assert agree("SIPROTEC 5", "SICAM 5") is None and agree("S7-1200", "SIMATIC S7-1200") == "exact" and agree("SIPLUS S7-1200", "SIMATIC S7-1200") == "exact"
    assert agree("5", "SICAM 5") == "weak" and agree("", "") is None and agree("MicroLogix 1400", "ControlLogix 1400") is None


def test_small_keys(spark):
    assert column(spark, ["6ES7 214-1AG40", "É_1", None], keys.ident_key("x")) == ["6es72141ag40", "é1", ""]
    assert column(spark, ["CPE:2.3:h:V:P:1.0:*", "cpe:/h:v:p:1", None], keys.cpe_key("x")) == ["cpe:2.3:h:v:p", "cpe:/h:v:p:1", ""]
    assert column(spark, ["A~1", "A", None], keys.base_id("x")) == ["A", "A", ""]
    assert column(spark, [("Siemens AG", "S7 1200", "V4"), ("", " ", "")], keys.purl("a", "b", "c"), "a string, b string, c string") == ["pkg:generic/siemens-ag/s7-1200@v4", "pkg:generic/unknown/unknown"]
    assert column(spark, ["", "5", "1400", "123456", "abcd"], keys.low_entropy("x")) == [True, True, True, True, False]
    assert column(spark, ["it's", 'a"b', "it's \"x\"", "a\\b\n"], quoted("x")) == [repr(x) for x in ("it's", 'a"b', "it's \"x\"", "a\\b\n")]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ab'\"\\\n\t", max_size=8), min_size=1, max_size=20))
def test_quoting_is_pythons(spark, texts):
    assert column(spark, texts, quoted("x")) == [repr(x) for x in texts]


def parsed(spark, texts):
    return column(spark, texts, versions.parse_version("x"))


def test_versions_read(spark):
    got = parsed(spark, ["V4.5", "02.07.07", "02_07", "R15B_PC4", "4.3.0.0", "BIOS V1.0.212N", "with_firmware 2.3", "rev. 3", "99999999999999999999.1"])
    shown = [([int(n) for n in v.num], v.suf, v.component) for v in got]
    assert shown == [([4, 5], "", ""), ([2, 7, 7], "", ""), ([2, 7], "", ""), ([15], "b_pc4", ""), ([4, 3], "", ""), ([1, 0, 212], "n", "BIOS"), ([2, 3], "", "firmware"), ([3], "", ""), ([99999999999999999999, 1], "", "")]
    assert parsed(spark, ["banana", "", None, "x4", "V", "HMI", "4 5"]) == [None] * 7
    assert parsed(spark, ["1" * 50])[0].num == ["1" * 50]  # of any length, as the order needs no arithmetic


def test_versions_order(spark):
    pairs = [("4.3", "4.3.0.1"), ("2", "10"), ("4.5", "4.5a"), ("4.5a", "4.5B"), ("9", "10.0"), ("0", "0.1"), ("2.9.9", "3")]
    less = F.expr("1=1")
    less = versions.order(versions.parse_version("x")) < versions.order(versions.parse_version("y"))
    assert column(spark, pairs, less, "x string, y string") == [True] * len(pairs)
    assert column(spark, [(b, a) for a, b in pairs], less, "x string, y string") == [False] * len(pairs)
    same = versions.order(versions.parse_version("x")) == versions.order(versions.parse_version("y"))
    assert column(spark, [("4.3", "V4.3.0"), ("1.0A", "1.0a"), ("1", "1.1")], same, "x string, y string") == [True, True, False]


RANGES = [
    ("<V4.5", "4.4", True), ("<V4.5", "4.5", False), ("<=4.5", "4.5.0", True), ("vers:all/*", None, True), ("vers:all/*", "banana", True), ("vers:intdot/>=3.0|<3.0.2", "3.0.1", True), (">=V2.3_and_<V6.30.016", "6.30.16", False),
    ("4.5", "V4.5.0", True), ("4.5", "4.6", False), ("<banana", "1", None), ("prior to 4", "3", None), ("<4.5", "banana", None), ("", "1", None), (">=1|<2|>=3|<4", "3.5", False), ("NMC2 <= 6.9.6", "6.9", True), ("<build 7", "6", None),
    ("<BIOS_V2", "1.0", None), ("<BIOS_V2", "BIOS 1.0", True), ("<firmware_2.3", "Firmware 2.4", False),
]


def test_ranges(spark):
    build = versions.clause(F.col("y"), versions.parse_version("y"), versions.parse_range("x"))["in_range"]
    assert column(spark, [r[:2] for r in RANGES], build, "x string, y string") == [r[2] for r in RANGES]


def test_range_notes(spark):
    cases = {"": "empty", "first 5 of serial no. 1": "serial-number constraint, not a version", "prior to Jan 5": "date-based constraint, not a version", "<4 SP2": "service-pack / update qualifier", "<x'y": 'unparseable version token "x\'y"', "what": "no recognisable constraint", "older than 5": "prose range, no machine syntax"}
    assert column(spark, list(cases), versions.parse_range("x")["note"]) == list(cases.values())


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="<>=|., vV123ab_", max_size=12), min_size=1, max_size=30))
def test_unread_ranges_tell_nothing(spark, texts):
    r = versions.parse_range("x")
    both = F.struct(r["kind"].alias("k"), versions.contains(r, versions.parse_version(F.lit("1.2"))).alias("c"))
    for x in column(spark, texts, both):
        assert x.c is None if x.k == "UNPARSEABLE" else x.c is not None


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc1", max_size=12), st.text(alphabet="abc1", max_size=12))
def test_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i][j] = table[i - 1][j - 1] + 1 if x == y else max(table[i - 1][j], table[i][j - 1])
    assert similarity.lcs(a, b) == table[-1][-1]


def test_ratio(spark):
    got = column(spark, [("controllogix5580", "controllogix5570"), ("", "a"), ("same", "same")], F.round(similarity.ratio(F.col("a"), F.col("b")), 4), "a string, b string")
    assert got == [0.9375, 0.0, 1.0]


def test_porter():
    cases = {
        "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file",
        "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "triplicate": "triplic", "formalize": "formal", "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "controll": "control", "rate": "rate", "cease": "ceas",
    }
    assert {w: text.porter(w) for w in cases} == cases


def test_query_tokens():
    assert text.query_tokens('S7-1200 "x" AND a_b *') == [["s7"], ["1200"], ["x"], ["and"], ["a", "b"]] and text.query_tokens("-*-") == [] and text.query_tokens("") == []


@pytest.mark.parametrize(
    "kev, epss, cvss, patch, level, vector, want",
    [
        ([], 0.0, 9.8, True, "2", "", ("NEXT", "out-of-cycle")), (["CVE-1"], 0.0, 5.0, True, "2", "", ("NOW", "immediate")), ([], 0.5, 9.8, False, "4", "", ("NOW", "immediate")), ([], 0.0, 9.8, False, "2", "", ("TRACK", "out-of-cycle")),
        ([], 0.0, None, True, "", "", ("LATER", "defer")), (["CVE-1"], 0.0, 1.0, True, "0", "", ("NEXT", "out-of-cycle")), ([], 0.2, 5.0, True, "1", "CVSS:3.1/AV:N/PR:N/UI:N", ("NEXT", "out-of-cycle")),
        ([], 0.0, 7.5, True, "1", "", ("NEXT", "scheduled")), ([], 0.0, 6.0, True, "1", "CVSS:4.0/S:P", ("NEXT", "scheduled")), ([], 0.0, 6.0, True, "dmz", "", ("NEXT", "scheduled")),
    ],
)
def test_decisions(spark, kev, epss, cvss, patch, level, vector, want):
    rows = spark.createDataFrame([(kev, epss, cvss, patch, level, vector)], "kev array<string>, epss double, cvss double, patch boolean, level string, vector string")
    d = rows.select(priority.decide(F.col("cvss"), F.col("vector"), F.col("kev"), F.col("epss"), F.col("patch"), "level").alias("d")).first().d
    assert (d.priority, d.action) == want
    assert ("no vendor patch" in d.rationale) == (want[0] == "TRACK") and d.vector.startswith("SSVCv2/E:")
