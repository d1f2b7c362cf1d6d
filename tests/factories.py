"""Small corpora and inventories."""

from advisium.operators.corpus import Corpus

ADVISORY = "adv_ord long, advisory_id string, title string, published string, revised string, severity string, publisher string, summary string, sectors array<string>, tlp string, source_path string"
LEAF = "prod_ord long, advisory_id string, product_id string, vendor string, product_name string, version_text string, full_name string, model_numbers array<string>, skus array<string>, cpe string"
VULN = "vuln_ord long, advisory_id string, cve string, cwe string, title string, cvss_score double, cvss_vector string, known_affected array<string>, status map<string,array<string>>, has_remedy boolean"
ASSET = "asset_ord long, asset_id string, vendor string, product string, version string, model string, cpe string, purdue_level string, site string"


def leaf(pid="P1", vendor="Siemens", product="SIMATIC S7-1200", version="vers:all/*", models=(), skus=(), cpe=""):
    return {"product_id": pid, "vendor": vendor, "product_name": product, "version_text": version, "model_numbers": list(models), "skus": list(skus), "cpe": cpe}


def vuln(cve="CVE-2024-0001", score=9.8, vector="", remedy=True, **status):
    return {"cve": cve, "score": score, "vector": vector, "remedy": remedy, "status": status or None}


def corpus(spark, *advisories):
    """advisories: (id, leaves, vulns); a vulnerability without status affects all leaves."""
    heads, leaves, vulns = [], [], []
    for n, (aid, ls, vs) in enumerate(advisories):
        heads.append((n, aid, f"Title of {aid}", f"202{n % 5}-01-02", "2024-02-02", "high", "vendor", f"Summary {aid}", ["Energy"], "WHITE", f"/c/{aid.lower()}.json"))
        for k, x in enumerate(ls):
            leaves.append((k, aid, x["product_id"], x["vendor"], x["product_name"], x["version_text"], "", x["model_numbers"], x["skus"], x["cpe"]))
        for k, v in enumerate(vs):
            status = v["status"] or {"known_affected": [x["product_id"] for x in ls]}
            vulns.append((k, aid, v["cve"], "", "", v["score"], v["vector"], status.get("known_affected", []), status, v["remedy"]))
    make = lambda rows, schema: spark.createDataFrame(rows, schema).coalesce(1)
    return Corpus(make(heads, ADVISORY), make(leaves, LEAF), make(vulns, VULN))


def assets(spark, *rows):
    """rows: dicts of an asset's fields."""
    made = []
    for n, r in enumerate(rows):
        a = {"asset_id": f"A{n}", "vendor": "Siemens", "product": "S7-1200", "version": "4.2.1", "model": "", "cpe": "", "purdue_level": "1", "site": "X"} | r
        made.append((n, *(a[k] for k in ("asset_id", "vendor", "product", "version", "model", "cpe", "purdue_level", "site"))))
    return spark.createDataFrame(made, ASSET).coalesce(1)


def decisions(spark, *rows):
    """rows: (vendor_key, asset key, advisory key, decision)."""
    schema = "vendor_key string, asset_product_key string, adv_product_key string, decision string, analyst string, decided_at string, note string, asset_product_raw string, adv_product_raw string"
    return spark.createDataFrame([(*r, "ann", f"2024-05-0{n + 1}T00:00:00", "", r[1], r[2]) for n, r in enumerate(rows)], schema).coalesce(1)
