"""Secret scans by character Markov models (operator 1).

Base spans are pattern matches of three kinds: assign (a password-like name, an
assignment sign and a value of 12 characters or more), access (``AKIA`` keys) and
hex runs.  Further spans come from two character Markov models of order two, one
of random strings and one of ordinary strings, both trained from labelled samples.
In every run of 16 key characters or more that is left between base spans, each
character adds its log-likelihood ratio less ``DRIFT``; a piece of 12 characters or more
whose sum exceeds a threshold that no ordinary string of a held-out part of the samples
reaches is a secret, wherever in the run it stands.  The ratio alone decides.  Base spans
are always kept.

The random samples are drawn from the alphabets that keys use by a seeded
generator; the ordinary ones are built from words of programming and prose in
the usual spellings, from syllables, dates, numbers and ruled lines.  Spans are
code-point offsets, end exclusive, by start, then kind as listed.

Edges: null texts count as empty; tokens of any length are found by the patterns
and scored in one pass, never cut; repeated rows get equal results; an input column
named like the added one gives way to it; an empty table gives no rows.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import map_arrow, room_for, spare_name, table, with_fields

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_NAMED = re.compile(r"password|passwd|secret|token|api_?key", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # 18 characters or more
HEX = re.compile(r"[0-9a-f]{16,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
BASE = ("assign", "access", "hex")
METHOD = "markov"
ORDER = BASE + (METHOD,)
LEAST, PIECE = 16, 12  # characters of a run that is scored, and of a piece of it
DRIFT, DROP = 0.5, 12.0  # nats a character; a fall from the best sum that ends a piece

_WORDS = (
    "get set user name value index count list item node data file path text line word page size code type key map string number result error event "
    "handler client server request response config option default parser reader writer buffer stream cache queue thread process task job table "
    "column row query filter group order limit offset start stop begin end first last next previous parent child left right top bottom width "
    "height color image button label form input output field select update delete insert create remove search find replace match pattern format "
    "convert decode encode compress message channel socket connection session account payment invoice customer product category description "
    "international information development management environment application temperature performance distribution communication "
    "responsibility understanding with that this from have they will would there their what about which when make like time just know take "
    "people into year your good some could them other than then look only come over think also back after work well because even want give day most"
).split()


_ONSETS = " b c d f g h j k l m n p qu r s t v w y z bl br ch cl cr dr fl fr gl gn gr kn ph pl pr sch schl schm schw sh sk sl sm sn sp spr st str th tr wh wr zw".split(" ")
_NUCLEI = "a e i o u a e i o ai au ea ee ei eu ie io oa oi oo ou ue ui".split()
_CODAS = "   b ch cht ck d f ft g k l ld ll lt m mp n nd ng ns nt p r rd rn rs rt s ss st t th tz x".split(" ")


def _ordinary(r: random.Random) -> str:
    """A made-up word of syllables, a compound of such words, a date or number in groups, or a ruled line."""
    kind = r.random()
    if kind < 0.6:
        words = ["".join(r.choice(_ONSETS) + r.choice(_NUCLEI) + r.choice(_CODAS) for _ in range(r.randint(2, 7))) for _ in range(r.choice((1, 1, 1, 2, 3)))]
        return r.choice(("", "", "-", "_", "/")).join(r.choice((str.lower, str.lower, str.lower, str.title, str.upper))(w) for w in words)
    if kind < 0.8:
        return r.choice("-/_").join(str(r.randrange(10 ** r.randint(1, 4))) for _ in range(r.randint(4, 9)))
    return r.choice(("".join(r.choice("-=_/+") for _ in range(r.choice((1, 1, 2, 3)))), r.choice("xXoO0aA"))) * r.randint(16, 60)


def samples(seed: int = 7, n: int = 4000) -> tuple[list[str], list[str]]:
    """Labelled samples: (random strings, ordinary strings)."""
    r = random.Random(seed)
    alphabets = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"]
    keys = ["".join(r.choice(a) for _ in range(r.randint(16, 48))) for a in alphabets for _ in range(n // len(alphabets))]
    joins = [lambda w: "_".join(w), lambda w: "-".join(w), lambda w: "/".join(w), lambda w: w[0] + "".join(x.title() for x in w[1:]), lambda w: "".join(x.title() for x in w), lambda w: "_".join(w).upper(), lambda w: "".join(w)]
    plain = []
    while len(plain) < n:
        words = [r.choice(_WORDS) for _ in range(r.randint(2, 5))]
        if r.random() < 0.4:
            words.insert(r.randrange(1, len(words) + 1), str(r.choice([r.randrange(10), r.randrange(100), r.randint(1990, 2030), r.randrange(10**6)])))
        token = r.choice(joins)(words)
        plain += [t for t in (token, _ordinary(r)) if len(t) >= LEAST]
    return keys, plain[:n]


class Markov:
    """Character model of order two with additive smoothing and a back-off weight."""

    def __init__(self, texts: list[str], alphabet: int = 66, weight: float = 0.2):
        self.counts: dict[str, dict[str, int]] = {}
        self.alphabet, self.weight = alphabet, weight
        for t in texts:
            t = "^^" + t
            for i in range(2, len(t)):
                for context in (t[i - 2 : i], t[i - 1], ""):
                    row = self.counts.setdefault(context, {"": 0})
                    row[t[i]] = row.get(t[i], 0) + 1
                    row[""] += 1
        self.cache: dict[tuple[str, str], float] = {}

    def log_probability(self, context: str, c: str) -> float:
        got = self.cache.get((context, c))
        if got is None:
            p = 1 / self.alphabet
            for k in ("", context[1:], context):
                row = self.counts.get(k, {"": 0})
                mass = self.weight * self.alphabet
                p = (row.get(c, 0) if c else 0) / (row[""] + mass) + p * mass / (row[""] + mass)
            got = self.cache[context, c] = math.log(p)
        return got

    def score(self, t: str) -> float:
        t = "^^" + t
        return sum(self.log_probability(t[i - 2 : i], t[i]) for i in range(2, len(t)))


class Scanner:
    """The pair of models and their threshold."""

    def __init__(self, keys: list[str], plain: list[str]):
        cut = lambda x: ([v for i, v in enumerate(x) if i % 4], x[::4])
        (keys, _), (plain, held) = cut(keys), cut(plain)
        self.random, self.ordinary = Markov(keys), Markov(plain)
        self.cache: dict[tuple[str, str], float] = {}
        #: Above the best sum of every held-out ordinary string.
        self.threshold = 1.0 + max(x for t in held for x, _, _ in self.pieces(t))

    def pieces(self, token: str) -> Iterator[tuple[float, int, int]]:
        """(sum of ratios less the drift, start, end) of the pieces that a running sum, which starts anew
        when it is used up or has fallen by ``DROP`` from its best, rises on."""
        context, cache, total, best, start, end = "^^", self.cache, 0.0, 0.0, 0, 0
        for i, c in enumerate(token):
            key = context, c
            ratio = cache.get(key)
            if ratio is None:
                ratio = cache[key] = self.random.log_probability(context, c) - self.ordinary.log_probability(context, c) - DRIFT
            context = context[1] + c
            total += ratio
            if total > best:
                best, end = total, i + 1
            elif total <= 0 or best - total > DROP:
                if best > 0:
                    yield best, start, end
                total, best, start = 0.0, 0.0, i + 1
        yield best, start, end

    def found(self, token: str) -> list[tuple[int, int]]:
        """Pieces of a token that are secrets."""
        return [(s, e) for x, s, e in self.pieces(token) if x > self.threshold and e - s >= PIECE] if len(token) >= LEAST else []

    def likely(self, token: str) -> bool:
        return bool(self.found(token))

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) by start, then kind as listed."""
        found = []
        if _NAMED.search(text):
            found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
        if "AKIA" in text:
            found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
        found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
        base = sorted((s, e) for _, s, e in found)
        at, reach = 0, 0
        for m in TOKEN.finditer(text):
            begin, end = max(m.start(), reach), m.end()
            while at < len(base) and base[at][0] < end:  # what base spans leave of the run
                if base[at][0] > begin:
                    found += [(METHOD, begin + s, begin + e) for s, e in self.found(text[begin : base[at][0]])]
                reach = max(reach, base[at][1])
                begin = max(begin, reach)
                at += 1
            if begin < end:
                found += [(METHOD, begin + s, begin + e) for s, e in self.found(text[begin:end])]
        return sorted(found, key=lambda x: (x[1], ORDER.index(x[0])))


_scanner: list[Scanner] = []


def scanner() -> Scanner:
    """Trained once in each worker, always alike: the samples come from a fixed seed."""
    if not _scanner:
        _scanner.append(Scanner(*samples()))
    return _scanner[0]


def scan(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all but the text by default) plus ``secrets``: array<struct<kind, start, end, found>>.
    One pass, no shuffle."""
    added = "secrets array<struct<kind:string,start:int,end:int,found:string>>"
    keep = room_for([c for c in docs.columns if c != text] if keep is None else keep, added)
    schema = with_fields(docs.select(*keep).schema, added)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("found", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner()
        for batch in batches:
            rows = []
            for value in batch.column(len(keep)):
                t = value.as_py() or ""
                rows.append([{"kind": k, "start": s, "end": e, "found": t[s:e]} for k, s, e in own.spans(t)])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(rows, kind)], names=schema.names)

    return map_arrow(docs.select(*keep, docs[text].alias(spare_name(keep))), run, schema)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"] != METHOD)
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("secrets")).alias("spans"))
