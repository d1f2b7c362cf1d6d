"""Personal data: fixed base patterns, and identifiers that bootstrapped contexts discover.

Base matches of four kinds are the seeds. Every mention, a seed or a looser form of a kind that the
base does not match, is tied to the lexical patterns around it: the two words before, and the words on
both sides. A last scan finds what else stands where the patterns of SUPPORT mentions or more are:
words with a digit or an @ are instances as well, and all others are counted against the pattern, each
time. Where no such pattern is left there is no such scan.

Spark scores this graph in rounds. A pattern trusts a kind by the summed score of its instances of the
kind over all that stands there; an instance is of a kind by a noisy-or of its patterns. Seeds are of
their kind; a looser form may be of its own kind only, any other word of each. What reaches CONFIDENT
is added. Patterns and instances are 64-bit hashes; edges are distinct before they are scored, so
copies and common words add no weight to a task. No pattern is left out for what stands at it: many
of little trust can make an instance confident together, and words found there can raise their trust.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from advisium.llm.common import bitmap, few, pair, passes, ready, signed, texts

KINDS = ("email", "ip", "card", "phone")
ROUNDS, CONFIDENT = 3, 0.8
#: Added to what stands at a pattern: with SUPPORT instances of one kind alone it reaches CONFIDENT.
DOUBT, SUPPORT = 1, 4
#: Characters of a word that may be an identifier, at least, and hashes of words that a worker keeps.
LEAST, CACHE = 4, 1 << 17
_ANY = re.compile("[0-9@]|[(\\[]at[)\\]]")
_NEXT = re.compile(r"\S+")
#: What may stand around a word and is not of it.
_EDGE = "()[]{}<>\"'`.,;:!?"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# the run before is taken whole: without it a long run of digits would be tried at every digit
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: The parts of an address have the limits that RFC 5321 gives them.
_LOOSE = {
    "email": re.compile(r"(?<!\S)[A-Za-z0-9][^\s@]{0,63}(?:@| ?[(\[]at[)\]] ?)[^\s@]{1,252}[A-Za-z0-9]"),
    "ip": re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:(?::?[0-9A-Fa-f]{1,4}:?){2,7}|[0-9]{1,4}(?:\.[0-9]{1,4}){3})(?![0-9A-Za-z])"),
    "card": re.compile(r"(?<![0-9+.])[0-9](?:[ -]?[0-9]){11,18}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9A-Za-z+.])\(?[0-9](?:[ ().-]{0,2}[0-9]){6,14}(?![0-9A-Za-z])"),
}
Span = tuple[int, int]


def _emails(text: str) -> list[Span]:
    """The leftmost matches; the local part reaches back from each @ as far as it can."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and (c := text[start - 1]).isascii() and (c.isalnum() or c in "._%+-"):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base(text: str) -> dict[str, list[Span]]:
    """Base matches of each kind, in code points."""
    if not _ANY.search(text):
        return {k: [] for k in KINDS}
    small = lambda x: len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255
    return {
        "email": _emails(text),
        "ip": [m.span() for m in _IP.finditer(text) if all(map(small, m.group().split(".")))],
        "card": [m.span() for m in _CARD.finditer(text) if 16 <= len(d := _digits(m.group())) <= 19 and _luhn(d)],
        "phone": [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15],
    }


def candidates(text: str, taken: list[Span]) -> Iterator[tuple[str, int, int]]:
    """Loose forms of the kinds that touch no base match and no earlier candidate."""
    if not _ANY.search(text):
        return
    free = Free(taken)
    for kind in KINDS:
        some = [m.span() for m in _LOOSE[kind].finditer(text) if free(*m.span())]
        free = Free(sorted([*free.spans, *some]))
        yield from ((kind, *x) for x in some)


class Free:
    """Whether a stretch touches none of some spans."""

    def __init__(self, spans: list[Span]):
        self.spans: list[Span] = []
        for start, end in sorted(spans):  # those that overlap become one
            if self.spans and start < self.spans[-1][1]:
                self.spans[-1] = self.spans[-1][0], max(end, self.spans[-1][1])
            else:
                self.spans.append((start, end))

    def __call__(self, start: int, end: int) -> bool:
        k = bisect_left(self.spans, (end, end))
        return not k or self.spans[k - 1][1] <= start


class _Words(dict):
    """Hashes of folded words; the lowest bit tells words with a digit or an @."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        folded = re.sub("[0-9]+", "0", word.lower())
        h = self[word] = xxhash.xxh3_64_intdigest(folded) & ~1 | bool(re.search("[0-9@]", folded))
        return h


_WORDS = _Words()
#: Counts of patterns that a task holds before it sends them on, to be added up by a shuffle.
HELD = 1 << 18
#: A filter of patterns has at least 2 ** LEAST_BITS bits (128 KB).
LEAST_BITS = 20
#: What stands before the first word and after the last.
_FIRST, _LAST = 2, 4
_AROUND = np.uint64(0xA5A5A5A5A5A5A5A5)


def patterns(left: np.ndarray, near: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(before, around) for each place: of the word before the last, the last, and the next."""
    return np.stack([pair(left, near), pair(near, right) ^ _AROUND], axis=1)


def swapped(x: np.ndarray) -> np.ndarray:
    """Hashes with their halves in the other order."""
    return x << np.uint64(32) | x >> np.uint64(32)


def _hash(*parts: str) -> int:
    x = xxhash.xxh64_intdigest("\0".join(parts))
    return x - (x >> 63 << 64)


def instance(text: str, kind: str, start: int, end: int) -> int:
    return _hash(kind, text[start:end].lower() if kind in ("email", "ip") else _digits(text[start:end]))


def context(text: str, start: int, end: int) -> tuple[int, int, int]:
    """Hashes of the two words before a stretch and of the one after it, whatever their length."""
    width = 64
    while len(words := text[max(0, start - width) : start].split()) < 3 and width < start:
        width *= 4
    words = words[-2:]
    after = _NEXT.search(text, end)
    left = [_FIRST] * (2 - len(words)) + [_WORDS[w] for w in words]
    return left[0], left[1], _WORDS[after.group()] if after else _LAST


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, h, spans, mentions): base spans and mentions of each text; h tells texts apart."""
    ready(docs.sparkSession)
    span = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())])
    seen = pa.struct([*span, pa.field("seed", pa.bool_()), pa.field("instance", pa.int64()), pa.field("patterns", pa.list_(pa.int64()))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            spans, rows, around = [], [], []
            for text in texts(part):
                found = base(text)
                own = [(KINDS.index(k), s, e) for k in KINDS for s, e in found[k]]
                every = [(k, s, e, True) for k, s, e in own]
                every += [(KINDS.index(k), s, e, False) for k, s, e in candidates(text, [x[1:] for x in own])]
                spans.append([dict(zip(("kind", "start", "stop"), x, strict=True)) for x in own])
                rows.append([{"kind": k, "start": s, "stop": e, "seed": seed, "instance": instance(text, KINDS[k], s, e)} for k, s, e, seed in every])
                around += [context(text, s, e) for _, s, e, _ in every]
            told = iter(signed(patterns(*np.array(around, np.uint64).reshape(-1, 3).T)).tolist())
            for row in rows:
                for x in row:
                    x["patterns"] = next(told)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array(spans, pa.list_(span)), pa.array(rows, pa.list_(seen))], ["doc_id", "h", "spans", "mentions"])

    named = "kind:int,start:bigint,stop:bigint"
    return docs.select(F.col("doc_id").cast("long"), _text_key().alias("h"), "text").mapInArrow(
        run, f"doc_id long, h long, spans array<struct<{named}>>, mentions array<struct<{named},seed:boolean,instance:bigint,patterns:array<bigint>>>"
    )


def _places(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words of a text, their hashes, and the patterns (before, around) of each one's place."""
    words = text.split()
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    near = np.concatenate([np.array([_FIRST, _FIRST], np.uint64), h])
    return words, h, patterns(near[:-2], near[1:-1], np.concatenate([h[1:], np.array([_LAST], np.uint64)]))


def strangers(text: str, sought) -> tuple[list[tuple[int, int, int, list[int]]], np.ndarray]:
    """What stands at some patterns besides mentions: (instance, start, stop, patterns) of words that may
    be identifiers, and the patterns at which another word stands, each time. sought: which of an array of
    patterns are wanted."""
    words, h, here = _places(text)
    if not words:
        return [], np.empty(0, np.uint64)
    wanted = sought(here)
    at = wanted.any(axis=1)
    plain = at & (h & np.uint64(1) == 0)
    against, found = [here[plain][wanted[plain]]], []
    some = np.flatnonzero(at & ~plain)
    if len(some):
        places = [m.span() for m in _NEXT.finditer(text)]
        mine = base(text)
        taken = [x for spans in mine.values() for x in spans]
        free = Free([*taken, *(x[1:] for x in candidates(text, taken))])
        for i in some.tolist():
            start, end = places[i]
            if not free(start, end):
                continue  # a mention
            word = text[start:end]
            start, end = start + len(word) - len(word.lstrip(_EDGE)), end - len(word) + len(word.rstrip(_EDGE))
            if end - start < LEAST:
                against.append(here[i][wanted[i]])
            else:
                found.append((_hash("", text[start:end].lower()), start, end, signed(here[i][wanted[i]]).tolist()))
    return found, np.concatenate(against)


def others(docs: DataFrame, hopeful: DataFrame) -> DataFrame:
    """What strangers() tells of all texts at patterns that pass filters of the hopeful ones: rows (doc_id, h, start, stop,
    instance, pattern), and for the counts (pattern, n) with the others null; a pattern's counts may come in parts."""
    # two filters, of both halves of a pattern: the places that one alone lets through grow faster than the texts
    halves = F.call_function("shiftleft", "pattern", F.lit(32)).bitwiseOR(F.shiftrightunsigned("pattern", 32))
    filters = [bitmap(hopeful.select(x.alias("x")), "x", least=LEAST_BITS) for x in (F.col("pattern"), halves)]
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    def wanted(x: np.ndarray) -> np.ndarray:
        one, two = sent.value
        out = passes(x, *one)
        out[out] = passes(swapped(x[out]), *two)
        return out

    def counted(against: dict[int, int]) -> pa.RecordBatch:
        none = pa.nulls(len(against), pa.int64())
        return pa.RecordBatch.from_arrays([none] * 5 + [pa.array(signed(np.array(list(against), np.uint64))), pa.array(list(against.values()), pa.int64())], names)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        against = {}
        for part in parts:
            rows, plain = [], []
            for doc_id, h, text in zip(part.column("doc_id").to_pylist(), part.column("h").to_pylist(), texts(part), strict=True):
                found, more = strangers(text, wanted)
                plain.append(more)
                rows += [(doc_id, h, s, e, i, p, 0) for i, s, e, ps in found for p in ps]
            for p, n in zip(*(x.tolist() for x in np.unique(np.concatenate(plain), return_counts=True)), strict=True) if plain else ():
                against[p] = against.get(p, 0) + n
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
            if len(against) > HELD:
                yield counted(against)
                against = {}
        if against:
            yield counted(against)

    names = ["doc_id", "h", "start", "stop", "instance", "pattern", "n"]
    return docs.select(F.col("doc_id").cast("long"), _text_key().alias("h"), "text").mapInArrow(run, ", ".join(f"{x} long" for x in names))


def _text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def instances(edges: DataFrame, against: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT) -> DataFrame:
    """(instance, kind): what the graph makes confident, besides seeds; of kinds with equal scores the first.

    edges: (pattern, instance, kind, seed), distinct; kind is null where any may be. against: (pattern, n), what else
    stands at a pattern. A pattern's trust in a kind is the summed score of its instances of the kind over all its
    instances, n and DOUBT; seeds score 1, others first 0 and then the noisy-or of their patterns' trust.
    """
    some = edges.where("not seed")
    # all that joins have on both sides is cut, so that a pattern or instance with many edges can be split
    sizes = edges.select("pattern", F.lit(1).cast("long").alias("n")).union(against.select("pattern", "n")).groupBy("pattern").agg((F.sum("n") + DOUBT).alias("n")).checkpoint()
    seeds = edges.where("seed").select("instance", "kind", F.lit(1.0).alias("score")).distinct().checkpoint()
    score = seeds
    for _ in range(rounds):
        sums = edges.select("pattern", "instance").join(score, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("s"))
        trust = sums.join(sizes, "pattern").select("pattern", F.col("kind").alias("of"), F.least(F.col("s") / F.col("n"), F.lit(1 - 1e-9)).alias("trust")).checkpoint()
        found = some.join(trust, "pattern").where("kind is null or kind = of").groupBy("instance", F.col("of").alias("kind"))
        found = found.agg(F.round(1 - F.exp(F.sum(F.log1p(-F.col("trust")))), 9).alias("score"))
        score = found.union(seeds).checkpoint()
    new = score.join(seeds.select("instance"), "instance", "left_anti").where(F.col("score") >= confident)
    best = new.groupBy("instance").agg(F.min(F.struct(-F.col("score"), "kind")).alias("x"))
    return best.select("instance", "x.kind")


def discovered(docs: DataFrame, found: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT) -> DataFrame:
    """(doc_id, h, more): the added spans of texts that have any. found: a scan() of docs."""
    mentions = found.select("doc_id", "h", F.explode("mentions").alias("m")).select("doc_id", "h", "m.*")
    edges = mentions.select("kind", "instance", "seed", F.explode("patterns").alias("pattern"))
    edges = edges.groupBy("pattern", "instance", "kind").agg(F.max("seed").alias("seed")).checkpoint()
    # a pattern of fewer mentions can't be trusted
    hopeful = edges.groupBy("pattern").count().where(F.col("count") >= SUPPORT).select("pattern").checkpoint()
    known = edges.join(hopeful, "pattern", "left_semi")
    if hopeful.isEmpty():
        beside = docs.sparkSession.createDataFrame([], "doc_id long, h long, start long, stop long, instance long, pattern long, n long")
    else:
        beside = others(docs, hopeful).join(hopeful, "pattern", "left_semi").checkpoint()
    words = beside.where("instance is not null")
    known = known.unionByName(words.select("pattern", "instance", F.lit(None).cast("int").alias("kind"), F.lit(False).alias("seed")).distinct()).checkpoint()
    sure = instances(known, beside.where("instance is null"), rounds, confident)
    loose = mentions.where("not seed").select("doc_id", "h", "instance", "start", "stop")
    places = loose.union(words.select("doc_id", "h", "instance", "start", "stop")).join(sure, "instance")
    new = places.select("doc_id", "h", F.struct("kind", "start", "stop").alias("x")).distinct()
    return new.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list("x")).alias("more"))  # the spans of one text


def _written(spans: Column) -> Column:
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", name(x), x["start"], x["stop"])), ",")


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found), one row per row.

    The counts and base_sha256 are of base spans; spans has all, n_found of them discovered. Null
    texts are empty; null doc_ids stay null; repeated rows give repeated rows, and weigh as one as
    instances; other columns are not read. Long texts are read whole, in time that grows as they do;
    a worker holds the words of one. An empty table gives an empty result.
    """
    found = scan(docs).checkpoint()
    more = discovered(docs, found)
    more = more.select(F.col("doc_id").alias("id_"), F.col("h").alias("h_"), "more")
    both = F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_"))
    out = found.join(more, both, "left").select("doc_id", "spans", F.coalesce("more", F.array().cast(found.schema["spans"].dataType)).alias("more"))
    kinds = F.transform("spans", lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(_written(F.col("spans")), 256).alias("base_sha256"), _written(F.concat("spans", "more")).alias("spans"), F.size("more").cast("long").alias("n_found"))


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each stretch that spans cover replaced by its first span's kind."""
    out, done = [], 0
    for start, end, kind in sorted(spans, key=lambda x: (x[0], -x[1])):
        if start >= done:
            out += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame) -> DataFrame:
    """The documents with all spans masked, [EMAIL] and so on, and n_chars, if there, brought up to date.

    Other columns stay, whatever their names; null texts stay null, repeated rows repeated. Only texts
    with discovered spans need a join.
    """
    found = scan(docs).checkpoint()
    more = discovered(docs, found)
    names, schema = docs.columns, docs.schema
    at = names.index("text")
    spans = F.array().cast(found.schema["spans"].dataType)
    # the added spans stand last, under a name that no column has
    taken = {n.lower() for n in names}
    name = next(x for x in ("more" + "_" * k for k in range(len(names) + 1)) if x not in taken)
    more = few(more)
    if more.isEmpty():
        rows = docs.select("*", spans.alias(name))
    else:
        on = docs["doc_id"].cast("long").eqNullSafe(more["doc_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == more["h"])
        rows = docs.join(more, on, "left").select(*(docs[c] for c in names), F.coalesce(more["more"], spans).alias(name))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for text, extra in zip(part.column(at).to_pylist(), part.column(len(names)).to_pylist(), strict=True):
                own = [(s, e, KINDS.index(k)) for k, spans in base(text or "").items() for s, e in spans]
                every = own + [(x["start"], x["stop"], x["kind"]) for x in extra]
                out.append(masked(text, every) if every else text)
            columns = [pa.array(out, pa.string()) if k == at else part.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names)

    out = rows.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in names else out
