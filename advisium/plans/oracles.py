"""DuckDB SQL for the queries, row by row where the engine has nested columns."""

from __future__ import annotations

from advisium.functions import keys, versions
from advisium.functions.priority import CODES, CONTROLLED, EPSS_ACTIVE, OPEN, PROCESS
from advisium.operators.match import CONFIDENCE, FUZZY_THRESHOLD, VERDICT
from advisium.plans import bridge
from advisium.plans import fixtures as fx


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def squash(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]+', '', 'g')"


def vendor(x: str) -> str:
    table = keys.alias_table()
    m = f"map([{', '.join(map(lit, table))}], [{', '.join(map(lit, table.values()))}])"
    raw = f"lower({strip(x)})"
    short = squash(f"regexp_replace({raw}, '\\b(?:{keys.CORPORATE_WORDS})\\b\\.?', ' ', 'g')")
    return f"coalesce({m}[{squash(raw)}], {m}[{short}], nullif({short}, ''), {squash(raw)})"


def product(source: str, name: str, vk: str = "vk", to: str = "p") -> str:
    """CTEs {to}1 to {to}: source with raw, brand, core, full_key of a product's name."""
    brand = "|".join(keys.BRANDS)
    front = lambda n: f"array_to_string(w[1:{n}], ' ')"
    drop = " ".join(f"WHEN {vk} <> '' AND len(w) > {n} AND {vendor(front(n))} = {vk} THEN array_to_string(w[{n + 1}:], ' ')" for n in (3, 2, 1))
    noise = f"regexp_replace(rest, '(?i)\\b(?:{keys.NOISE_WORDS})\\b', ' ', 'g')"
    return f"""
{to}1 AS (SELECT *, {strip(name)} AS raw FROM {source}),
{to}2 AS (SELECT *, {strip("regexp_replace(raw, '\\(\\s*[^()]*\\s+[^()]*\\)\\s*$', '')")} AS t FROM {to}1),
{to}3 AS (SELECT *, string_split_regex(t, '\\s+') AS w FROM {to}2),
{to}4 AS (SELECT *, CASE {drop} ELSE t END AS u FROM {to}3),
{to}5 AS (SELECT *, lower(regexp_extract(u, '(?i)^\\s*({brand})\\b', 1)) AS brand, regexp_replace(u, '(?i)^(?:\\s*(?:{brand})\\b[\\s._-]*){{1,3}}', '') AS rest FROM {to}4),
{to}6 AS (SELECT *, {squash(f"regexp_replace({noise}, '\\b([A-Za-z]{{3,}}?[^sui])s\\b', '\\1', 'g')")} AS c0 FROM {to}5),
{to} AS (SELECT * EXCLUDE (t, w, u, rest, c0), CASE WHEN raw = '' THEN '' WHEN c0 = '' THEN brand ELSE c0 END AS core,
  CASE WHEN raw = '' THEN '' ELSE brand || CASE WHEN c0 = '' THEN brand ELSE c0 END END AS full_key FROM {to}6)"""


def version(source: str, text: str, to: str = "v") -> str:
    """CTEs {to}1 to {to}: source with vraw, num, suf, component; num is null for what is no version."""
    q = f"'(?i)^(?:with[\\s_]+)?({versions.COMPONENTS})[\\s._-]+(.+)$'"
    core = "'^([0-9]+(?:[._][0-9]+)*)([A-Za-z0-9._+\\-()]*)$'"
    dots = lambda x: f"regexp_replace({x}, '([0-9])_([0-9])', '\\1.\\2', 'g')"
    return f"""
{to}1 AS (SELECT *, {strip(text)} AS vraw FROM {source}),
{to}2 AS (SELECT *, regexp_extract(vraw, {q}, 1) AS component, CASE WHEN regexp_extract(vraw, {q}, 1) = '' THEN vraw ELSE {strip(f"regexp_extract(vraw, {q}, 2)")} END AS vrest FROM {to}1),
{to}3 AS (SELECT *, {dots(dots(strip(f"regexp_replace(vrest, '{versions.PREFIX}', '')")))} AS clean FROM {to}2),
{to}4 AS (SELECT *, CASE WHEN regexp_matches(clean, {core}) THEN list_transform(string_split_regex(regexp_extract(clean, {core}, 1), '[._]'), lambda x: x::HUGEINT) END AS n0,
  lower(regexp_extract(clean, {core}, 2)) AS suf FROM {to}3),
{to} AS (SELECT * EXCLUDE (vrest, clean, n0), CASE WHEN n0 IS NOT NULL THEN list_slice(n0, 1, coalesce(list_max(list_transform(n0, lambda x, i: CASE WHEN x <> 0 THEN i ELSE 0 END)), 0)) END AS num FROM {to}4)"""


def ranges(source: str, text: str = "rt", to: str = "r") -> str:
    """CTEs: {to}(rt, raw, kind, note, component) of distinct texts, and {to}c(rt, k, op, vraw, num, suf) of their constraints."""
    refused = " ".join(f"WHEN regexp_matches(raw, {lit(p)}) THEN {lit(why)}" for p, why in versions.REFUSED)
    pattern = lit(versions.CONSTRAINT)
    quoted = lambda x: f"CASE WHEN contains({x}, '''') AND NOT contains({x}, '\"') THEN '\"' || replace({x}, '\\', '\\\\') || '\"' ELSE '''' || replace(replace({x}, '\\', '\\\\'), '''', '\\''') || '''' END"
    return f"""
{to}a AS (SELECT DISTINCT {text} AS rt, {strip(text)} AS raw FROM {source}),
{to}b AS (SELECT *, lower(raw) IN ({', '.join(map(lit, versions.ALL))}) OR starts_with(lower(raw), 'all version') AS is_all, CASE {refused} END AS why,
  regexp_replace(CASE WHEN starts_with(raw, 'vers:') AND strpos(raw, '/') > 0 AND strpos(raw, '/') < length(raw) THEN substr(raw, strpos(raw, '/') + 1) ELSE raw END, '(?i)_and_', '|', 'g') AS body FROM {to}a),
{to}d AS (SELECT *, regexp_extract_all(body, {pattern}, 1) AS ops, regexp_extract_all(body, {pattern}, 2) AS vers FROM {to}b),
{to}e AS (SELECT rt, unnest(range(1, len(ops) + 1)) AS k, ops, vers FROM {to}d WHERE raw <> '' AND NOT is_all AND why IS NULL),
{to}f AS (SELECT rt, k, ops[k] AS op, vers[k] AS vt FROM {to}e UNION ALL SELECT rt, 1, '=', body FROM {to}d WHERE raw <> '' AND NOT is_all AND why IS NULL AND len(ops) = 0),
{version(f'{to}f', 'vt', f'{to}v')},
{to}g AS (SELECT rt, count(*) FILTER (num IS NULL) AS bad, arg_min(vt, k) FILTER (num IS NULL) AS first_bad, coalesce(arg_min(component, k) FILTER (component <> ''), '') AS component FROM {to}v GROUP BY rt),
{to}h AS (SELECT d.rt, raw, CASE WHEN raw = '' THEN 'UNPARSEABLE' WHEN is_all THEN 'ALL' WHEN why IS NOT NULL OR bad > 0 THEN 'UNPARSEABLE' WHEN len(ops) > 0 THEN 'BOUNDED' ELSE 'EXACT' END AS kind,
  CASE WHEN raw = '' THEN 'empty' WHEN is_all THEN '' WHEN why IS NOT NULL THEN why WHEN bad > 0 AND len(ops) > 0 THEN 'unparseable version token ' || {quoted("first_bad")} WHEN bad > 0 THEN 'no recognisable constraint' ELSE '' END AS note,
  g.component FROM {to}d d LEFT JOIN {to}g g USING (rt)),
{to} AS (SELECT rt, raw, kind, note, CASE WHEN kind IN ('BOUNDED', 'EXACT') THEN component ELSE '' END AS component FROM {to}h),
{to}c AS (SELECT v.rt, k, op, vraw, num, suf FROM {to}v v JOIN {to} USING (rt) WHERE kind IN ('BOUNDED', 'EXACT'))"""


def inside(asked: str, to: str = "i", r: str = "r") -> str:
    """CTE: {to}(rt, vt0, in_range) for all pairs of distinct range texts and asked versions (vt0, vcomp, num, suf); component scoped."""
    test = "CASE c.op WHEN '<' THEN (a.num, a.suf) < (c.num, c.suf) WHEN '<=' THEN (a.num, a.suf) <= (c.num, c.suf) WHEN '>' THEN (a.num, a.suf) > (c.num, c.suf) WHEN '>=' THEN (a.num, a.suf) >= (c.num, c.suf) ELSE (a.num, a.suf) = (c.num, c.suf) END"
    return f"""
{to}t AS (SELECT c.rt, a.vt0, bool_and({test}) AS ok FROM {r}c c, {asked} a WHERE a.num IS NOT NULL GROUP BY ALL),
{to} AS (SELECT {r}.rt, a.vt0, CASE WHEN kind = 'UNPARSEABLE' THEN NULL WHEN {r}.component <> '' AND lower({r}.component) <> coalesce(lower(a.vcomp), '') THEN NULL WHEN kind = 'ALL' THEN true WHEN a.num IS NULL THEN NULL ELSE ok END AS in_range
  FROM {r} CROSS JOIN {asked} a LEFT JOIN {to}t t ON t.rt = {r}.rt AND t.vt0 = a.vt0)"""


def similarity(source: str, to: str = "sim") -> str:
    """CTE: {to}(a, b, ratio) for pairs (a, b), by the bits of a row of the table of common subsequences."""
    return f"""
{to}w(a, b, j, v) AS (SELECT a, b, 0, (1::BIGINT << length(a)) - 1 FROM {source}
  UNION ALL SELECT a, b, j + 1, ((v + (v & m)) | (v & ~m)) & ((1::BIGINT << length(a)) - 1) FROM (
    SELECT *, coalesce(list_sum(list_transform(range(length(a)), lambda i: CASE WHEN substr(a, i::INT + 1, 1) = substr(b, j + 1, 1) THEN 1::BIGINT << i ELSE 0::BIGINT END)), 0)::BIGINT AS m FROM {to}w WHERE j < length(b))),
{to} AS (SELECT a, b, 2.0::DOUBLE * (length(a) - bit_count(v)) / (length(a) + length(b)) AS ratio FROM {to}w WHERE j = length(b))"""


def agree(a: str, b: str) -> str:
    fam = lambda x: f"CASE {x}.brand " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in keys.FAMILY.items()) + f" ELSE {x}.brand END"
    both = f"({a}.brand <> '' AND {b}.brand <> '')"
    low = f"(length({a}.core) < {keys.MIN_CORE} OR regexp_matches({a}.core, '^[0-9]+$'))"
    return f"CASE WHEN {a}.core = '' OR {a}.core <> {b}.core OR {both} AND {fam(a)} <> {fam(b)} THEN NULL WHEN {low} AND NOT {both} THEN 'weak' ELSE 'exact' END"


# ---- the bridge tables, keyed ----

BASE = f"""
b_asset AS ({bridge.duck_text(bridge.ASSET)}),
b_leaf AS ({bridge.duck_text(bridge.LEAF)}),
b_vuln AS ({bridge.duck_text(bridge.VULN)}),
b_adv AS ({bridge.duck_text(bridge.ADVISORY)}),
av0 AS (SELECT DISTINCT vendor, product FROM b_asset), av AS (SELECT *, {vendor("vendor")} AS vk FROM av0),
{product("av", "product", to="ak")},
lv0 AS (SELECT DISTINCT vendor, product_name FROM b_leaf), lv AS (SELECT *, {vendor("vendor")} AS vk FROM lv0),
{product("lv", "product_name", to="lk")},
a AS (SELECT b.*, k.vk, k.brand, k.core, k.full_key, regexp_replace(lower(model), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS model_key, array_to_string(string_split(lower(cpe), ':')[1:5], ':') AS cpe_key
  FROM b_asset b JOIN ak k USING (vendor, product)),
st AS (SELECT advisory_id, pid AS product_id, bool_or(stat = 'known_affected') AS aff, bool_or(stat = 'under_investigation') AS inv, bool_or(stat = 'known_not_affected') AS nota, bool_or(stat = 'fixed') AS fx FROM b_vuln GROUP BY ALL),
l AS (SELECT b.*, adv_ord, k.vk, k.brand, k.core, k.full_key, array_to_string(string_split(lower(cpe), ':')[1:5], ':') AS cpe_key, NOT (coalesce(nota, false) OR coalesce(fx, false)) AS keep,
  CASE WHEN inv THEN 'i' WHEN nota THEN 'n' WHEN fx THEN 'f' ELSE '' END AS note
  FROM b_leaf b JOIN lk k USING (vendor, product_name) JOIN b_adv USING (advisory_id) LEFT JOIN st USING (advisory_id, product_id)),
avt AS (SELECT DISTINCT version AS vt0 FROM b_asset), {version("avt", "vt0", "avv")}, asked AS (SELECT vt0, component AS vcomp, num, suf FROM avv),
{ranges("b_leaf", "version_text", "r")},
{inside("asked", "i")}"""

_COLS = "asset_ord, asset_id, advisory_id, product_id, adv_ord, prod_ord, stage, tier, verdict, confidence, ratio, in_range, a_vk, a_full, l_full, keep, note"


def _cand(stage: int, tier: str, verdict: str, confidence: str, ratio: str, joins: str, where: str = "true", in_range: str = "i.in_range") -> str:
    rng = " JOIN i ON i.rt = l.version_text AND i.vt0 = a.version" if "i." in in_range + where + verdict + confidence else ""
    return f"""SELECT a.asset_ord, a.asset_id, l.advisory_id, l.product_id, l.adv_ord, l.prod_ord, {stage} AS stage, {tier} AS tier, ({verdict})::VARCHAR AS verdict, ({confidence})::DOUBLE AS confidence, ({ratio})::DOUBLE AS ratio,
  {in_range} AS in_range, a.vk AS a_vk, a.full_key AS a_full, l.full_key AS l_full, l.keep, l.note FROM a JOIN l ON {joins}{rng} WHERE {where}"""


IDENT = _cand(1, "1", "CASE WHEN NOT i.in_range THEN 'NOT_AFFECTED' WHEN i.in_range IS NULL AND a.version <> '' THEN 'UNKNOWN' END", "CASE WHEN i.in_range IS NULL AND a.version <> '' THEN 0.7 END", "NULL", "a.model_key <> '' AND list_contains(list_transform(l.model_numbers, lambda x: regexp_replace(lower(x), '[^\\p{L}\\p{N}]', '', 'g')), a.model_key)")
IDENT = IDENT.replace("FROM a JOIN l ON a.model_key <> '' AND", "FROM a JOIN (SELECT *, regexp_replace(lower(unnest(model_numbers)), '[^\\p{L}\\p{N}]', '', 'g') AS ident FROM l) l ON a.model_key = l.ident AND a.model_key <> '' AND")
CPE = _cand(2, "2", "NULL", "NULL", "NULL", "a.cpe_key <> '' AND a.cpe_key = l.cpe_key", in_range="NULL::BOOLEAN")
_SAME = "a.vk = l.vk AND a.vk <> '' AND a.core <> '' AND l.core <> ''"
EXACT = _cand(
    3, f"CASE {agree('a', 'l')} WHEN 'weak' THEN 4 ELSE 3 END", f"CASE WHEN {agree('a', 'l')} = 'exact' AND i.in_range IS NULL THEN 'UNKNOWN' END",
    f"CASE WHEN {agree('a', 'l')} = 'weak' THEN 0.45 WHEN i.in_range IS NULL THEN 0.5 END", "NULL", f"{_SAME} AND a.core = l.core", f"{agree('a', 'l')} IS NOT NULL AND i.in_range IS NOT false",
)
PAIRS = f"""
ours AS (SELECT DISTINCT vk, full_key AS afull, core AS acore FROM a WHERE vk <> '' AND core <> ''),
theirs AS (SELECT vk, full_key AS lfull, arg_min(core, (adv_ord, prod_ord)) AS lcore FROM l WHERE vk <> '' AND core <> '' GROUP BY ALL),
pr AS (SELECT * FROM ours JOIN theirs USING (vk)),
todo AS (SELECT DISTINCT afull AS a, lfull AS b FROM pr WHERE acore <> lcore AND 2.0 * least(length(afull), length(lfull)) >= {FUZZY_THRESHOLD} * (length(afull) + length(lfull))),
{similarity("todo")},
alike AS (SELECT vk, afull, acore, lfull, lcore, 1.0::DOUBLE AS ratio FROM pr WHERE acore = lcore AND afull <> lfull AND NOT (length(acore) < {keys.MIN_CORE} OR regexp_matches(acore, '^[0-9]+$'))
  UNION ALL SELECT vk, afull, acore, lfull, lcore, ratio FROM pr JOIN sim ON a = afull AND b = lfull WHERE acore <> lcore AND ratio >= {FUZZY_THRESHOLD})"""
FUZZY = _cand(4, "4", "NULL", f"round({CONFIDENCE[4]} * s.ratio, 3)", "s.ratio", f"{_SAME} JOIN alike s ON s.vk = a.vk AND s.afull = a.full_key AND s.acore = a.core AND s.lfull = l.full_key AND s.lcore = l.core", "i.in_range IS NOT false")
DECISIONS = """
dec AS (SELECT DISTINCT vk, full_key AS afull, full_key AS lfull, product AS raw, CASE WHEN length(vk) % 2 = 0 THEN 'CONFIRMED' WHEN length(vk) % 3 = 0 THEN 'DEFERRED' ELSE 'REJECTED' END AS decision
  FROM a WHERE vk <> '' AND length(product) % 3 = 0),
ruling AS (SELECT DISTINCT vk, afull, lfull, decision FROM dec WHERE decision <> 'DEFERRED')"""
DECIDED = _cand(0, "0", "NULL", "NULL", "NULL", f"{_SAME} JOIN ruling d ON d.vk = a.vk AND d.afull = a.full_key AND d.lfull = l.full_key")


def _by_tier(table: dict, column: str = "tier") -> str:
    return f"CASE {column} " + " ".join(f"WHEN {t} THEN {lit(v) if isinstance(v, str) else v}" for t, v in table.items()) + " END"


def gated(source: str) -> str:
    return f"""SELECT * REPLACE (CASE WHEN NOT keep THEN 'NOT_AFFECTED' ELSE coalesce(verdict, CASE WHEN note <> '' THEN 'UNKNOWN' END, {_by_tier(VERDICT)}) END AS verdict,
  CASE WHEN NOT keep THEN {_by_tier(CONFIDENCE)}::DOUBLE ELSE coalesce(confidence, {_by_tier(CONFIDENCE)}::DOUBLE) END AS confidence) FROM {source}"""


def overridden(source: str) -> str:
    """Candidates with decisions in place of their own verdicts."""
    return f"""SELECT {_COLS} FROM {source} c WHERE NOT EXISTS (FROM ruling d WHERE d.vk = c.a_vk AND d.afull = c.a_full AND d.lfull = c.l_full)
  UNION ALL SELECT DISTINCT c.asset_ord, c.asset_id, c.advisory_id, c.product_id, c.adv_ord, c.prod_ord, 0, 0, CASE WHEN d.decision = 'REJECTED' THEN 'NOT_AFFECTED' WHEN i.in_range THEN 'AFFECTED' ELSE 'UNKNOWN' END, NULL::DOUBLE, NULL::DOUBLE, i.in_range,
    c.a_vk, c.a_full, c.l_full, d.decision = 'REJECTED' OR c.keep, CASE WHEN d.decision = 'REJECTED' THEN '' ELSE c.note END
  FROM {source} c JOIN ruling d ON d.vk = c.a_vk AND d.afull = c.a_full AND d.lfull = c.l_full JOIN a ON a.asset_ord = c.asset_ord JOIN l ON l.adv_ord = c.adv_ord AND l.prod_ord = c.prod_ord JOIN i ON i.rt = l.version_text AND i.vt0 = a.version
  WHERE d.decision = 'REJECTED' OR i.in_range IS NOT false"""


def best(source: str) -> str:
    return f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY asset_ord, advisory_id ORDER BY verdict = 'NOT_AFFECTED', tier, -confidence, stage, adv_ord, prod_ord) AS rn FROM {source}) WHERE rn = 1"""


def found(max_tier: int = 4, decided: bool = False, cleared: bool = False) -> str:
    """WITH RECURSIVE ... f: the findings up to a tier."""
    out = f"WITH RECURSIVE {BASE}, {PAIRS}" + (f", {DECISIONS}" if decided else "")
    stages = [IDENT, CPE, EXACT, FUZZY] + [DECIDED] * decided
    out += ",\nc0 AS (" + "\nUNION ALL ".join(f"SELECT {_COLS} FROM ({x})" for x in stages) + ")"
    out += f",\nc1 AS ({overridden('c0') if decided else 'SELECT * FROM c0'}), c2 AS ({gated('c1')})"
    if max_tier >= 5:
        skip = "AND NOT EXISTS (FROM ruling d WHERE d.vk = a.vk AND d.afull = a.full_key AND d.lfull = l.full_key)" if decided else ""
        five = _cand(5, "5", "NULL", "NULL", "NULL", "a.vk = l.vk AND a.vk <> ''", f"NOT EXISTS (FROM c2 WHERE c2.asset_ord = a.asset_ord AND c2.advisory_id = l.advisory_id) {skip}", "NULL::BOOLEAN")
        out += f",\nc5 AS ({five}), c6 AS (SELECT {_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY asset_ord, advisory_id ORDER BY adv_ord, prod_ord) AS first FROM c5) WHERE first = 1)"
        out += f",\nc7 AS ({gated('c6')}), c3 AS (SELECT {_COLS} FROM c2 UNION ALL SELECT {_COLS} FROM c7)"
    else:
        out += ",\nc3 AS (SELECT * FROM c2)"
    drop = "" if cleared else " WHERE verdict <> 'NOT_AFFECTED'"
    return out + f",\nf AS (SELECT * FROM ({best('c3')}){drop})"


#: f with cves, cvss, cvss_vector and has_patch.
SCORES = """
own AS (SELECT advisory_id, pid AS product_id, list(cve ORDER BY vuln_ord) AS cves, arg_max(struct_pack(s := cvss_score, v := cvss_vector), (cvss_score, -vuln_ord)) AS w FROM b_vuln WHERE stat = 'known_affected' GROUP BY ALL),
whole AS (SELECT advisory_id, list(cve ORDER BY vuln_ord) AS cves, arg_max(struct_pack(s := cvss_score, v := cvss_vector), (cvss_score, -vuln_ord)) AS w, bool_or(has_remedy) AS has_patch FROM b_vuln GROUP BY ALL),
fs AS (SELECT f.*, coalesce(own.cves, whole.cves) AS cves, coalesce(own.w, whole.w).s AS cvss, coalesce(own.w, whole.w).v AS cvss_vector, has_patch FROM f LEFT JOIN own USING (advisory_id, product_id) LEFT JOIN whole USING (advisory_id))"""

LEVEL = lambda x: f"CASE WHEN lower({strip(x)}) IN ({', '.join(map(lit, OPEN))}) THEN 'open' WHEN lower({strip(x)}) IN ({', '.join(map(lit, PROCESS))}) THEN 'small' ELSE 'controlled' END"
_IN = lambda v, x: f"contains(upper({v}), '{x}')"


def utility(v: str) -> str:
    auto = f"CASE WHEN {_IN(v, 'AU:Y')} THEN true WHEN {_IN(v, 'AU:N')} AND {_IN(v, 'CVSS:4')} THEN false WHEN {_IN(v, 'CVSS:3')} THEN {_IN(v, 'AV:N')} AND {_IN(v, 'PR:N')} AND {_IN(v, 'UI:N')} ELSE false END"
    return f"CASE WHEN {auto} THEN 'efficient' ELSE 'laborious' END"


def impact(score: str, level: str, v: str) -> str:
    band = f"(CASE WHEN {score} >= 9 THEN 3 WHEN {score} >= 7 THEN 2 WHEN {score} >= 4 THEN 1 ELSE 0 END)"
    safe = f"({_IN(v, 'CVSS:4')} AND list_has_any(string_split(upper({v}), '/'), ['S:P', 'MSI:S', 'MSA:S']))"
    step = f"(CASE WHEN {LEVEL(level)} = 'small' AND (coalesce({score}, 0) >= 7 OR {safe}) THEN 1 ELSE 0 END)"
    return f"['low', 'medium', 'high', 'very high'][least({band} + {step}, 3) + 1]"


def decided(source: str, to: str = "dd") -> str:
    """CTEs: source (exploitation, exposure, utility, impact, has_patch) with action and priority."""
    big = "impact IN ('high', 'very high')"
    return f"""{to}1 AS (SELECT *, CASE exploitation WHEN 'active' THEN CASE WHEN impact = 'low' AND exposure = 'small' THEN 'out-of-cycle' ELSE 'immediate' END
   WHEN 'poc' THEN CASE WHEN exposure = 'open' AND {big} THEN 'immediate' WHEN {big} OR utility = 'efficient' THEN 'out-of-cycle' ELSE 'scheduled' END
   ELSE CASE WHEN impact = 'very high' AND exposure <> 'small' THEN 'out-of-cycle' WHEN {big} OR impact = 'medium' AND exposure = 'open' THEN 'scheduled' ELSE 'defer' END END AS action FROM {source}),
{to} AS (SELECT *, CASE WHEN action = 'immediate' THEN 'NOW' WHEN NOT has_patch THEN 'TRACK' WHEN action = 'defer' THEN 'LATER' ELSE 'NEXT' END AS priority FROM {to}1)"""


#: fs with epss, kev, decision points, action and priority, as dd.
SCORED = f"""{SCORES},
kev AS ({bridge.duck_text(bridge.KEV)}), ep AS ({bridge.duck_text(bridge.EPSS)}),
fc AS (SELECT asset_ord, advisory_id, unnest(cves) AS cve FROM fs),
sg AS (SELECT asset_ord, advisory_id, coalesce(max(epss), 0.0)::DOUBLE AS epss, count(kev.cve) > 0 AS in_kev FROM fc LEFT JOIN ep USING (cve) LEFT JOIN kev USING (cve) GROUP BY ALL),
pt AS (SELECT fs.*, epss, in_kev, b.site, b.purdue_level, CASE WHEN in_kev THEN 'active' WHEN epss >= {EPSS_ACTIVE} THEN 'poc' ELSE 'none' END AS exploitation, {LEVEL("b.purdue_level")} AS exposure,
  {utility("cvss_vector")} AS utility, {impact("cvss", "b.purdue_level", "cvss_vector")} AS impact FROM fs JOIN sg USING (asset_ord, advisory_id) JOIN b_asset b USING (asset_ord)),
{decided("pt")}"""


#: cl(rt, vt0, said): how a range and an asset's version are told.
SAID = """
told AS (SELECT rt, string_agg(op || vraw, ' and ' ORDER BY k) AS tells FROM rc GROUP BY rt),
cl AS MATERIALIZED (SELECT r.rt, q.vt0, CASE WHEN kind = 'UNPARSEABLE' THEN 'version range ''' || raw || ''' unparseable (' || note || ')' WHEN kind <> 'ALL' AND q.num IS NULL THEN 'asset version ''' || CASE WHEN q.vt0 = '' THEN '(blank)' ELSE q.vt0 END || ''' unparseable'
  WHEN kind = 'ALL' THEN 'all versions affected' ELSE tells END AS said FROM r CROSS JOIN asked q LEFT JOIN told ON told.rt = r.rt)"""


def told(f: str) -> str:
    """CTE: sd(asset_ord, advisory_id, said) for each finding; made first, as joins in another order are of all ranges with all assets."""
    return f"""sp AS MATERIALIZED (SELECT f.asset_ord, f.advisory_id, l.version_text AS rt, a.version AS vt0 FROM {f} f JOIN a ON a.asset_ord = f.asset_ord JOIN l ON l.adv_ord = f.adv_ord AND l.prod_ord = f.prod_ord),
sd AS MATERIALIZED (SELECT asset_ord, advisory_id, said FROM sp JOIN cl USING (rt, vt0))"""


_OPEN = "CASE WHEN in_range THEN said ELSE said || '; version unconfirmed' END"


def basis(f: str = "f", decided: bool = False) -> str:
    """How a finding was made, of f joined with a, l and cl (and d, its ruling's text)."""
    ruled = f"""WHEN stage = 0 AND d.decision = 'REJECTED' THEN 'analyst rejected ''' || d.raw || ''' as ''' || d.raw || ''' by ann on 2024-05-01' WHEN stage = 0 THEN 'analyst-confirmed alias ''' || d.raw || ''' = ''' || d.raw || ''' by ann on 2024-05-01; ' || {_OPEN}""" if decided else ""
    silent = "stage = 0 AND d.decision = 'REJECTED'" if decided else "false"
    return f"""CASE {ruled} WHEN stage = 1 THEN 'model/SKU ''' || a.model || ''' matches advisory identifier ''' || l.model_numbers[1] || '''' || CASE WHEN NOT in_range THEN '; asset version ' || a.version || ' is outside ' || said WHEN a.version <> '' THEN '; ' || said ELSE '' END
  WHEN stage = 2 THEN 'CPE ' || l.cpe || ' matches asset CPE'
  WHEN stage = 3 AND {f}.tier = 4 THEN 'product ''' || a.product || ''' matches ''' || l.product_name || ''' on a low-entropy key ''' || a.core || '''; ' || said
  WHEN stage = 3 AND in_range IS NULL THEN 'vendor+product match but ' || said
  WHEN stage = 3 THEN 'vendor+product match; asset version ' || CASE WHEN a.version = '' THEN '?' ELSE a.version END || ' satisfies ' || said
  ELSE 'fuzzy product match ''' || a.product || '''~''' || l.product_name || ''' (ratio ' || printf('%.2f', round(ratio::DECIMAL(18, 9), 2)::DOUBLE) || '); ' || {_OPEN} END
  || CASE WHEN {silent} THEN '' ELSE CASE {f}.note WHEN 'i' THEN '; vendor lists this product as under investigation' WHEN 'n' THEN '; vendor states not affected' WHEN 'f' THEN '; vendor lists this product version as fixed' ELSE '' END END"""


_CODES = lambda x: f"map([{', '.join(map(lit, CODES))}], [{', '.join(map(lit, CODES.values()))}])[{x}]"
#: t22: the fields of a finding, of SCORED.
TEXTS = f"""{SAID}, {told("dd")},
kh AS (SELECT asset_ord, advisory_id, list(cve ORDER BY pos) AS hits FROM (SELECT asset_ord, advisory_id, cve, min(pos) AS pos FROM (SELECT asset_ord, advisory_id, unnest(cves) AS cve, generate_subscripts(cves, 1) AS pos FROM fs) GROUP BY ALL) WHERE cve IN (SELECT cve FROM kev) GROUP BY ALL),
t22 AS (SELECT dd.asset_id, dd.site, dd.purdue_level, dd.advisory_id, b_adv.title AS advisory_title, b_adv.tlp, array_to_string(cves, ' ') AS cves, cvss, cvss_vector, round(epss, 6) AS epss, in_kev, priority,
  'SSVCv2/E:' || {_CODES("exploitation")} || '/X:' || {_CODES("exposure")} || '/U:' || {_CODES("utility")} || '/H:' || {_CODES("impact")} || '/D:' || {_CODES("action")} AS ssvc_vector, action AS ssvc_action,
  CASE exploitation WHEN 'active' THEN 'in CISA KEV (' || array_to_string(hits[1:3], ', ') || ')' WHEN 'poc' THEN 'EPSS ' || printf('%.1f', epss * 100) || '%' ELSE 'no exploitation signal' END || ', ' || CASE WHEN cvss IS NULL THEN 'no CVSS' ELSE 'CVSS ' || printf('%.1f', cvss) END
    || ', ' || exposure || ' exposure' || CASE WHEN dd.purdue_level <> '' THEN ' at Purdue level ' || dd.purdue_level ELSE '' END || CASE WHEN priority = 'TRACK' THEN ', no vendor patch, compensating controls only' ELSE '' END AS rationale,
  dd.tier AS match_tier, round(dd.confidence, 6) AS confidence, dd.verdict, {basis("dd")} AS match_basis, l.vendor, l.product_name AS product, trim(l.version_text) AS version_range
  FROM dd JOIN a ON a.asset_ord = dd.asset_ord JOIN l ON l.adv_ord = dd.adv_ord AND l.prod_ord = dd.prod_ord JOIN b_adv ON b_adv.adv_ord = dd.adv_ord JOIN sd ON sd.asset_ord = dd.asset_ord AND sd.advisory_id = dd.advisory_id LEFT JOIN kh ON kh.asset_ord = dd.asset_ord AND kh.advisory_id = dd.advisory_id)"""
