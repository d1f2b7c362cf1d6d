"""Canonical vendor, product and identifier keys as native columns."""

from __future__ import annotations

import json
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from advisium.functions.expr import blank, col, let, strip

#: Canonical vendor keys and the spellings that mean them.
VENDOR_ALIASES: dict[str, tuple[str, ...]] = {
    "siemens": ("siemens ag", "siemens energy", "siemens healthineers", "siemens mobility", "siemens digital industries"),
    "schneider": ("schneider electric", "schneider-electric", "modicon", "apc by schneider", "apc by schneider electric", "telemecanique"),
    "rockwell": ("rockwell automation", "allen-bradley", "allen bradley", "ab"),
    "hitachienergy": ("hitachi energy", "hitachi abb power grids", "abb power grids"),
    "abb": ("abb ltd", "abb inc"),
    "honeywell": ("honeywell international", "honeywell process solutions", "honeywell building technologies"),
    "emerson": ("emerson electric", "emerson process management", "fisher", "fisher-rosemount"),
    "yokogawa": ("yokogawa electric", "yokogawa electric corporation"),
    "mitsubishi": ("mitsubishi electric", "mitsubishi electric corporation"),
    "ge": ("general electric", "ge digital", "ge grid solutions", "ge healthcare", "ge vernova", "ge gas power", "ge power"),
    "omron": ("omron corporation",),
    "phoenixcontact": ("phoenix contact",),
    "wago": ("wago kontakttechnik",),
    "moxa": ("moxa inc",),
    "advantech": ("advantech co",),
    "delta": ("delta electronics",),
}
#: Words of a company's name that carry no identity, as patterns.
CORPORATE_WORDS = (
    r"ag|inc|corp|corporation|co|ltd|limited|gmbh|llc|plc|s\.?a\.?|b\.?v\.?|kg|kgaa|group|holdings?|international|"
    r"electric|electronics|software|systems|solutions|technologies|automation|industries"
)
#: Product families that stand before a model.
BRANDS = (
    "simatic", "simotion", "sinamics", "sinema", "sinec", "scalance", "siprotec", "sicam", "sentron", "desigo", "ruggedcom", "siplus",
    "controllogix", "compactlogix", "micrologix", "guardlogix", "flexlogix", "softlogix", "factorytalk", "panelview",
    "modicon", "ecostruxure", "powerlogic", "easergy", "harmony", "vijeo", "altivar", "powerchute",
    "proficy", "cimplicity", "experion", "controledge", "deltav", "ovation", "centum", "prosafe", "stardom", "melsec", "melsoft", "melipc",
)
#: A variant line and the family that advisories fold it into.
FAMILY = {"siplus": "simatic"}
#: Words of a product's name that carry no identity, as patterns.
NOISE_WORDS = r"cpu|plc|hmi|rtu|series|family|line|products?|devices?|modules?|controllers?|firmware|platform|systems?|all\s+versions?"
#: A remark in brackets at a name's end, of more than one word.
REMARK = r"\(\s*[^()]*\s+[^()]*\)\s*$"
#: A plural of four letters or more, and what is kept of it.
PLURAL = r"\b([A-Za-z]{3,}?[^sui])s\b"
MIN_CORE = 4


def plain(text: str) -> str:
    """squash() of a literal."""
    return "".join(c for c in text.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789")


def alias_table(extra: dict[str, list[str]] | None = None) -> dict[str, str]:
    """Squashed spelling to vendor key; extra adds spellings or vendors to the fixed ones."""
    rows = chain(VENDOR_ALIASES.items(), (extra or {}).items())
    return {plain(x): key for key, names in rows for x in (key, *(names or ()))}


def squash(x: Column | str) -> Column:
    """Lower case, ASCII letters and digits only."""
    return F.regexp_replace(F.lower(blank(x)), "[^a-z0-9]+", "")


def ident_key(x: Column | str) -> Column:
    """Lower case, letters and digits of any script."""
    return F.regexp_replace(F.lower(blank(x)), r"[^\p{L}\p{N}]", "")


def vendor_key(name: Column | str, aliases: dict[str, str] | None = None) -> Column:
    """Canonical vendor; a spelling in no table is its letters without corporate words."""
    table = F.from_json(F.lit(json.dumps(aliases or alias_table())), "map<string,string>")  # folded to one literal

    def body(raw: Column) -> Column:
        short = squash(F.regexp_replace(raw, rf"\b(?:{CORPORATE_WORDS})\b\.?", " "))
        known = lambda k: F.try_element_at(table, k)
        return let(
            F.struct(squash(raw).alias("whole"), short.alias("short")),
            lambda s: F.coalesce(known(s["whole"]), known(s["short"]), F.nullif(s["short"], F.lit("")), s["whole"]),
        )

    return let(F.lower(strip(name)), body)


def product_key(name: Column | str, vendor: Column | None = None, aliases: dict[str, str] | None = None) -> Column:
    """struct(brand, core, full, raw) of a product name.

    vendor is a vendor_key(): its name at the front of the product's is dropped.
    """
    empty = F.struct(*(F.lit("").alias(x) for x in ("brand", "core", "full", "raw")))

    def drop_vendor(text: Column) -> Column:
        if vendor is None:
            return text

        def body(words: Column) -> Column:
            out = text
            for take in (1, 2, 3):  # the longest is tried first
                front = F.array_join(F.slice(words, 1, take), " ")
                rest = F.array_join(F.slice(words, F.lit(take + 1), F.size(words)), " ")
                out = F.when((F.size(words) > take) & (vendor != "") & (vendor_key(front, aliases) == vendor), rest).otherwise(out)
            return out

        return let(F.split(text, r"(?U)\s+"), body)

    brand = "|".join(BRANDS)

    def split(raw: Column) -> Column:
        text = strip(F.regexp_replace(raw, REMARK, ""))
        return let(drop_vendor(text), parts(raw))

    def parts(raw: Column):
        def body(text: Column) -> Column:
            first = F.lower(F.regexp_extract(text, rf"(?i)^\s*({brand})\b", 1))
            rest = F.regexp_replace(text, rf"(?i)^(?:\s*(?:{brand})\b[\s._-]*){{1,3}}", "")
            rest = F.regexp_replace(rest, rf"(?i)\b(?:{NOISE_WORDS})\b", " ")
            rest = F.regexp_replace(rest, PLURAL, "$1")
            return let(F.struct(first.alias("b"), squash(rest).alias("c")), lambda s: named(raw, s))

        return body

    def named(raw: Column, s: Column) -> Column:
        core = F.when(s["c"] == "", s["b"]).otherwise(s["c"])
        return F.struct(s["b"].alias("brand"), core.alias("core"), F.concat(s["b"], core).alias("full"), raw.alias("raw"))

    return let(strip(name), lambda raw: F.when(raw == "", empty).otherwise(split(raw)))


def low_entropy(core: Column | str) -> Column:
    """Too short or too generic to name a product alone."""
    return (F.length(col(core)) < MIN_CORE) | col(core).rlike("^[0-9]+$")


def family(brand: Column) -> Column:
    out = brand
    for variant, parent in FAMILY.items():
        out = F.when(brand == variant, parent).otherwise(out)
    return out


def keys_agree(a: Column, b: Column) -> Column:
    """exact, weak or null for two product keys."""
    same = (a["core"] == b["core"]) & (a["core"] != "")
    branded = (a["brand"] != "") & (b["brand"] != "")
    clash = branded & (family(a["brand"]) != family(b["brand"]))
    return F.when(same & ~clash, F.when(low_entropy(a["core"]) & ~branded, "weak").otherwise("exact"))


def cpe_key(x: Column | str) -> Column:
    """The first five fields of a CPE name, in lower case."""
    return F.substring_index(F.lower(blank(x)), ":", 5)


def base_id(x: Column | str) -> Column:
    """An advisory id without the suffix that sets collisions apart."""
    return F.substring_index(blank(x), "~", 1)


def purl(vendor: Column | str, product: Column | str, version: Column | str) -> Column:
    """A generic package URL."""
    part = lambda x: F.regexp_replace(F.lower(strip(x)), r"[^\p{L}\p{N}._-]", "-")
    named = lambda x: let(part(x), lambda p: F.when(p == "", "unknown").otherwise(p))
    tail = F.when(blank(version) != "", F.concat(F.lit("@"), part(version))).otherwise("")
    return F.concat(F.lit("pkg:generic/"), named(vendor), F.lit("/"), named(product), tail)
