"""Versions and version ranges as native columns, with three-valued containment.

A version is struct(raw, num, suf, component, ord): num its numbers without trailing zeros, suf the
rest in lower case, ord a text that sorts as versions do: each number behind its length, then a
mark under all digits, then suf. A text that is no version is null. A range is struct(raw, kind,
note, constraints, component, lo, lo_in, hi, hi_in): constraints hold together, so they come down to
one interval, and whether a version is inside takes two comparisons of texts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from advisium.functions.expr import blank, let, quoted, strip

#: Parts of a device that may qualify a version.
COMPONENTS = "BIOS|firmware|U-Boot|bootloader|HMI|SW|ROS|ROX|HiOS"
#: What stands before a version's number.
PREFIX = r"(?i)^(?:versions?|rev(?:ision)?|fw|sw|hw|[vr])[\s._-]*"
#: Texts that mean all versions.
ALL = ("vers:all/*", "*", "<*", "all", "all versions")
#: What is refused, in this order, and why.
REFUSED = (
    (r"(?i)serial[\s_]*no", "serial-number constraint, not a version"),
    (r"(?i)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\w*\s+[0-9]", "date-based constraint, not a version"),
    (r"(?i)\bbuild\b", "build-qualified version"),
    (r"(?i)\bupd\b|\bsp[0-9]", "service-pack / update qualifier"),
    (r"(?i)prior to|before|earlier than|older than|distributed", "prose range, no machine syntax"),
)
#: An operator and its version; a version qualified by a component; a version's numbers and the rest of it.
CONSTRAINT = r"(<=|>=|<|>|=)\s*([^<>=|,\s]+)"
QUALIFIED = rf"(?i)^(?:with[\s_]+)?({COMPONENTS})[\s._-]+(.+)$"
NUMBERED = r"^([0-9]+(?:[._][0-9]+)*)([A-Za-z0-9._+\-()]*)$"
VERSION = "struct<raw:string,num:array<string>,suf:string,component:string,ord:string>"
RANGE = f"struct<raw:string,kind:string,note:string,constraints:array<struct<op:string,version:{VERSION}>>,component:string,lo:string,lo_in:boolean,hi:string,hi_in:boolean>"


def _trimmed(num: Column) -> Column:
    """Numbers without trailing zeros."""
    last = F.array_max(F.transform(num, lambda x, i: F.when(x != "0", i + 1).otherwise(0)))
    return F.slice(num, 1, F.coalesce(last, F.lit(0)))


def parse_version(text: Column | str) -> Column:
    """The version in a text, or null. Numbers may be of any length."""
    none = F.lit(None).cast(VERSION)

    def qualified(raw: Column) -> Column:
        component = F.regexp_extract(raw, QUALIFIED, 1)
        rest = F.when(component == "", raw).otherwise(strip(F.regexp_extract(raw, QUALIFIED, 2)))
        clean = F.regexp_replace(strip(F.regexp_replace(rest, PREFIX, "")), "(?<=[0-9])_(?=[0-9])", ".")
        return let(F.struct(component.alias("component"), clean.alias("clean")), lambda s: numbered(raw, s))

    def numbered(raw: Column, s: Column) -> Column:
        num = F.transform(F.split(F.regexp_extract(s["clean"], NUMBERED, 1), "[._]"), lambda x: F.regexp_replace(x, "^0+(?=.)", ""))
        suf = F.lower(F.regexp_extract(s["clean"], NUMBERED, 2))
        key = lambda n: F.concat(F.array_join(F.transform(n, lambda x: F.concat(F.lpad(F.length(x).cast("string"), 4, "0"), x)), ""), F.lit("!"), suf)
        read = lambda n: F.struct(raw.alias("raw"), n.alias("num"), suf.alias("suf"), s["component"].alias("component"), key(n).alias("ord"))
        return F.when(s["clean"].rlike(NUMBERED), let(_trimmed(num), read)).otherwise(none)

    return let(strip(text), lambda raw: F.when(raw == "", none).otherwise(qualified(raw)))


def order(version: Column) -> Column:
    """What versions compare by."""
    return version["ord"]


def parse_range(text: Column | str) -> Column:
    """The range in a text; kind is ALL, BOUNDED, EXACT or UNPARSEABLE."""

    def made(raw: Column, kind: str, note: Column | str = "", constraints: Column | None = None) -> Column:
        cons = F.array() if constraints is None else constraints
        component = F.lit("") if constraints is None else F.coalesce(F.get(F.filter(F.transform(cons, lambda c: c["version"]["component"]), lambda x: x != ""), F.lit(0)), F.lit(""))
        note = F.lit(note) if isinstance(note, str) else note
        low, high = (None, None) if constraints is None else (bound(cons, ">", F.array_max), bound(cons, "<", F.array_min))
        none = F.lit(None)
        return F.struct(
            raw.alias("raw"), F.lit(kind).alias("kind"), note.alias("note"), cons.alias("constraints"), component.alias("component"),
            (none if low is None else low["key"]).alias("lo"), (none if low is None else low["shut"] == 0).alias("lo_in"),
            (none if high is None else high["key"]).alias("hi"), (none if high is None else high["shut"] == 0).alias("hi_in"),
        ).cast(RANGE)

    def bound(cons: Column, side: str, top) -> Column:
        """The tightest bound of a side; of equal keys the one that leaves the key itself out."""
        some = F.filter(cons, lambda c: c["op"].isin(side, f"{side}=", "="))
        shut = 1 if side == ">" else -1
        return top(F.transform(some, lambda c: F.struct(c["version"]["ord"].alias("key"), F.when(c["op"] == side, shut).otherwise(0).alias("shut"))))

    def bounded(raw: Column) -> Column:
        rest = F.regexp_extract(raw, r"(?s)^vers:[^/]*/(.+)$", 1)
        body = F.when(F.startswith(raw, F.lit("vers:")) & (rest != ""), rest).otherwise(raw)
        return let(F.regexp_replace(body, "(?i)_and_", "|"), lambda b: let(found(b), lambda f: chosen(raw, b, f)))

    def found(body: Column) -> Column:
        ops = F.regexp_extract_all(body, F.lit(CONSTRAINT), 1)
        texts = F.regexp_extract_all(body, F.lit(CONSTRAINT), 2)
        return F.zip_with(ops, texts, lambda o, t: F.struct(o.alias("op"), t.alias("text"), parse_version(t).alias("version")))

    def chosen(raw: Column, body: Column, f: Column) -> Column:
        bad = F.filter(f, lambda x: x["version"].isNull())
        cons = F.transform(f, lambda x: F.struct(x["op"].alias("op"), x["version"].alias("version")))
        one = lambda v: F.when(v.isNotNull(), made(raw, "EXACT", "", F.array(F.struct(F.lit("=").alias("op"), v.alias("version"))))).otherwise(
            made(raw, "UNPARSEABLE", "no recognisable constraint")
        )
        return (
            F.when(F.size(bad) > 0, made(raw, "UNPARSEABLE", F.concat(F.lit("unparseable version token "), quoted(F.get(bad, F.lit(0))["text"]))))
            .when(F.size(f) > 0, made(raw, "BOUNDED", "", cons))
            .otherwise(let(parse_version(body), one))
        )

    def body(raw: Column) -> Column:
        low = F.lower(raw)
        out = F.when(raw == "", made(raw, "UNPARSEABLE", "empty")).when(low.isin(*ALL) | F.startswith(low, F.lit("all version")), made(raw, "ALL"))
        for pattern, reason in REFUSED:
            out = out.when(raw.rlike(pattern), made(raw, "UNPARSEABLE", reason))
        return out.otherwise(bounded(raw))

    return let(strip(text), body)


def contains(rng: Column, version: Column) -> Column:
    """True, false, or null where it can't be told."""
    at = version["ord"]
    over = rng["lo"].isNull() | (at > rng["lo"]) | rng["lo_in"] & (at == rng["lo"])
    under = rng["hi"].isNull() | (at < rng["hi"]) | rng["hi_in"] & (at == rng["hi"])
    inside = over & under
    return F.when(rng["kind"] == "UNPARSEABLE", F.lit(None).cast("boolean")).when(rng["kind"] == "ALL", True).when(version.isNotNull(), inside)


def describe(rng: Column) -> Column:
    return (
        F.when(rng["kind"] == "ALL", "all versions affected")
        .when(rng["kind"] == "UNPARSEABLE", F.concat(F.lit("unparseable range "), quoted(rng["raw"])))
        .otherwise(F.array_join(F.transform(rng["constraints"], lambda c: F.concat(c["op"], c["version"]["raw"])), " and "))
    )


def _other(version: Column, rng: Column) -> Column:
    """A range of a component says nothing about a version that is not the component's."""
    return (rng["component"] != "") & ~F.coalesce(F.lower(version["component"]) == F.lower(rng["component"]), F.lit(False))


def in_range(version: Column, rng: Column) -> Column:
    """Whether an asset's version is in a range; needs of them component and ord, kind, component and bounds."""
    return F.when(~_other(version, rng), contains(rng, version))


def clause(text: Column, version: Column, rng: Column) -> Column:
    """struct(in_range, text): whether an asset's version is in a range, and how that is told."""
    other = _other(version, rng)
    unread = F.when(blank(text) == "", F.lit("(blank)")).otherwise(text)
    why = (
        F.when(rng["kind"] == "UNPARSEABLE", F.concat(F.lit("version range "), quoted(rng["raw"]), F.lit(" unparseable ("), rng["note"], F.lit(")")))
        .when(other, F.concat(F.lit("range applies to "), rng["component"], F.lit(", inventory version is not scoped to it")))
        .when((rng["kind"] != "ALL") & version.isNull(), F.concat(F.lit("asset version "), quoted(unread), F.lit(" unparseable")))
        .otherwise(describe(rng))
    )
    return F.struct(in_range(version, rng).alias("in_range"), why.alias("text"))
