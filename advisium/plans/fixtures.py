"""Small tables of texts that pin what the scalar functions do; both engines read the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VENDORS = (
    "Siemens AG", "Siemens", "siemens energy", "Allen-Bradley", "ALLEN BRADLEY", "Rockwell Automation, Inc.", "Schneider Electric", "Schneider Electric Software, LLC", "Modicon",
    "Hitachi Energy", "ABB Power Grids", "ABB Ltd", "abb", "GE Vernova", "General Electric", "Acme Corp.", "Acme Holdings International", "Electric", "  ", "", "Phoenix Contact GmbH & Co. KG",
    "Wago Kontakttechnik", "B&R Industrial Automation", "Moxa Inc.", "Société Générale S.A.", "Omron-Corporation",
)
PRODUCTS = (
    ("Siemens", "SIMATIC S7-1200 CPU family"), ("Siemens", "S7-1200"), ("Siemens", "SIPROTEC 5"), ("Siemens", "SICAM 5"), ("Siemens", "SIPLUS S7-1200"), ("Siemens", "SIMATIC HMI Comfort Panels"),
    ("Siemens", "Siemens SIMATIC S7-1500 Software Controller"), ("Siemens", "SCALANCE X208 (incl. SIPLUS variants)"), ("Siemens", "LOGO! (6ED1052-1MD08)"), ("Siemens", "SIMATIC"), ("Siemens", "SIMATIC SIPLUS RUGGEDCOM ROX II"),
    ("Rockwell Automation", "Allen-Bradley MicroLogix 1400"), ("Rockwell Automation", "MicroLogix 1400"), ("Rockwell Automation", "ControlLogix 1400"), ("Schneider Electric", "Modicon M580"), ("", "Modicon M580"),
    ("Schneider Electric", "Schneider Electric EcoStruxure Control Expert"), ("", ""), ("GE", "Proficy Historian"), ("GE", "General Electric"), ("Hitachi Energy", "RTU500 series"), ("", "all versions of devices"),
    ("", "Access Bus Status Axis"), ("ABB", "ABB"), ("", "5"), ("", "1400"),
)
TEXTS = ("6ES7 214-1AG40-0XB0", "cpe:2.3:h:siemens:s7-1200:4.2:*:*", "CPE:/h:Siemens:S7:1.0", "ICSA-21-001-01~2", "ICSA-21-001-01", "", "Ünïcode Nr. 5_b", "it's", 'say "x"', "it's \"x\"", "back\\slash", "line\nbreak")
CORES = ("", "5", "s7", "1400", "123456", "s71200", "abc", "abcd")
VERSIONS = (
    "4.5", "V4.5", "v 4.5.0", "4.3.8", "02.07.07", "02_07", "4.5a", "R15B_PC4", "Version 2.1", "rev. 3", "FW 1.2", "4.3 (10)", "4.3(10)", "12", "BIOS V1.0.212N", "firmware_2.3", "with_firmware 2.3", "U-Boot 2020.04",
    "HMI", "banana", "", "x4", "4.x", "4..5", "1_2_3_4", "99999999999999999999.1", "SW-3.1", "V", "2.0.0.0", "2", "10.0", "E0a",
)
RANGES = (
    "<V4.5", "<=4.5", ">3", ">=2.3.4", "=4.0", "vers:all/*", "*", "<*", "All versions", "all versions < 4", "all", "vers:intdot/>=3.0|<3.0.2", ">=V2.3_and_<V6.30.016", "<BIOS_V1.0.212N", "<firmware_2.3", "NMC2 <= 6.9.6",
    "<=The_first_5_digits_of_serial_No._26061", "before Jan 2020", "builds prior to May 3", "<build 7", "<4.0 upd 3", "< 4 SP2", "prior to 4.5", "distributed 2019", "<banana", "4.5", "02_07", "nothing", "", "  ",
    ">=1|<2|>=3|<4", "vers:intdot/", "<4.x", "R15B_PC4", ">= 4.0, < 5", "<v2.0.0",
)
ASKED = ("4.4", "4.5", "4.5.0", "V4.5a", "3.0.1", "2", "BIOS 1.0.100", "firmware 2.2", "banana", "", "10", "6.9.6")
LEVELS = ("0", "1", "2", "3", "3.5", "4", "5", "dmz", " DMZ ", "", "x")
VECTORS = ("", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N", "CVSS:3.1/AV:L/AC:L/PR:N/UI:N", "CVSS:4.0/AV:N/AU:Y", "CVSS:4.0/AU:N/S:P", "CVSS:4.0/SC:H/MSI:S", "cvss:3.0/av:n/mpr:n/ui:n", "AV:N/AC:L/Au:N")
#: Search texts of the document tables, and of the stemmed index.
QUERY = "the of and"


def frame(spark: SparkSession, rows: tuple, *names: str) -> DataFrame:
    many = [r if isinstance(r, tuple) else (r,) for r in rows]
    return spark.createDataFrame(many, ", ".join(f"{n} string" for n in names))


def literal(x: str) -> str:
    """A text for DuckDB; line breaks by their number."""
    parts = ["'" + p.replace("'", "''") + "'" for p in x.split("\n")]
    return " || chr(10) || ".join(parts)


def values(rows: tuple, *names: str) -> str:
    """The same rows for DuckDB."""
    many = [r if isinstance(r, tuple) else (r,) for r in rows]
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in many)}) AS t({', '.join(names)})"
