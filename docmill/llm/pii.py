"""Personal data by weak supervision (operator 5), in DataFrame functions only.

Spans come from patterns.  The four base kinds (email, ip, card, phone) are always
kept; further kinds (local phone numbers, national ids, bank accounts, persons)
are candidates that a span classifier decides on.  Four labelers vote on each
span, for, against or not at all: a strict pattern, a gazetteer, the words before
it, and its boundaries.  The votes of all documents are counted by vote pattern;
expectation-maximisation on these few hundred counts estimates every labeler's
reliability and each pattern's probability, and a logistic classifier over kind
and span features is fitted to these probabilities.  Its weights become a column
expression.

Positions are native too: the pieces between matches and the matches themselves
give each span's start by their lengths in code points.  A text is swept once for runs
of the characters of numbers, and kinds made of these are sought in the runs; other
kinds only in texts that hold what they need.  The patterns match
what the plain definitions match, leftmost and without overlap, but anchor at
the start of a run and never backtrack, so they take linear time in texts of any
length.

Edges: null texts count as empty; without any candidate the classifier is not
fitted and no span is added; repeated rows get equal results; an input column named
``pii_spans`` gives way to the added one, names that begin with two underscores are
the operator's own; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import room_for, table

BASE = ("email", "ip", "card", "phone")
ADDED = ("local_phone", "national_id", "bank_account", "person")
KINDS = BASE + ADDED
ACCEPT = 0.9  # probability from which a span of an added kind is kept

#: Common given names of English, German, French and Spanish, of which persons are candidates.
_GIVEN_NAMES = (
    "Adam|Agnes|Alan|Albert|Alejandro|Alexander|Alice|Amy|Ana|Andrea|Andreas|Andrew|Angela|Anna|Anne|Antoine|Antonio|Arthur|Barbara|Beatriz|Ben|Bernard|Brian|Camille|Carl|Carlos|Carmen|Caroline|Catherine|"
    "Charles|Charlotte|Christian|Christina|Christine|Claire|Claudia|Daniel|David|Diana|Diego|Dieter|Dominique|Edward|Elena|Elizabeth|Emily|Emma|Eric|Eva|Felix|Fernando|Florian|Francisco|Frank|Friedrich|Georg|"
    "George|Grace|Guillaume|Hannah|Hans|Heinrich|Helen|Helga|Henri|Henry|Ines|Isabel|Jack|Jacques|James|Jane|Javier|Jean|Jennifer|Jessica|Joan|Johann|John|Jorge|Joseph|Juan|Julia|Julien|Karen|Karin|Karl|Kate|"
    "Katharina|Klaus|Laura|Laurent|Linda|Lisa|Louis|Louise|Lucas|Lucia|Luis|Lukas|Manuel|Margaret|Maria|Marie|Mark|Martin|Mary|Matthew|Max|Michael|Michel|Miguel|Monika|Nathalie|Nicolas|Nicole|Nina|Oliver|Olivia|"
    "Pablo|Patricia|Patrick|Paul|Paula|Pedro|Peter|Petra|Philippe|Pierre|Rachel|Rafael|Raul|Rebecca|Richard|Robert|Rosa|Sabine|Samuel|Sandra|Sarah|Sofia|Sophie|Stefan|Stephen|Susan|Susanne|Teresa|Thomas|Ursula|"
    "Victor|Walter|William|Wolfgang"
)
#: Common surnames, which vote on them.
_SURNAMES = (
    "Adams|Allen|Anderson|Bailey|Baker|Bauer|Becker|Bell|Bennett|Bernard|Bertrand|Brooks|Brown|Campbell|Carter|Castro|Clark|Collins|Cook|Cooper|Cruz|Davis|Delgado|Diaz|Dubois|Dupont|Durand|Edwards|Evans|"
    "Fernandez|Fischer|Flores|Fontaine|Foster|Fournier|Garcia|Girard|Gomez|Gonzalez|Gray|Green|Hall|Harris|Hernandez|Hill|Hoffmann|Howard|Huber|Hughes|Jackson|Jimenez|Johnson|Jones|Kaiser|Keller|Kelly|King|Klein|"
    "Koch|Lambert|Lee|Lefebvre|Leroy|Lewis|Long|Lopez|Martin|Martinez|Mayer|Meyer|Miller|Mitchell|Moore|Morales|Moreau|Morgan|Morris|Mueller|Murphy|Murray|Navarro|Nelson|Neumann|Ortiz|Parker|Perez|Peterson|Petit|"
    "Phillips|Powell|Price|Ramirez|Ramos|Reed|Reyes|Richard|Richter|Rivera|Roberts|Robinson|Rodriguez|Rogers|Romero|Ross|Roux|Ruiz|Russell|Sanchez|Schmidt|Schneider|Schroeder|Schulz|Schwarz|Scott|Silva|Simon|Smith|"
    "Stewart|Sullivan|Taylor|Thompson|Torres|Turner|Vargas|Vincent|Wagner|Walker|Ward|Watson|Weber|Werner|White|Williams|Wilson|Wolf|Wood|Wright|Young|Zimmermann"
)
#: Telephone area codes of large North American cities.
_AREA_CODES = "202|203|206|212|213|214|215|216|234|240|248|267|301|302|303|304|305|310|312|313|314|315|317|323|347|401|402|404|405|408|410|412|413|414|415|416|425|469|480|501|502|503|504|505|510|512|513|514|516|518|519|520|559|561|585|602|603|604|608|609|610|612|614|615|616|617|619|626|650|702|703|704|713|714|716|717|718|720|732|757|763|770|773|775|801|802|803|804|808|813|816|818|832|847|858|860|901|902|904|907|913|914|915|916|917|918|919|925|949|954|970|972|973|978|979"
#: Maximal runs of the characters that numbers are written in; everything of the ``NUMERIC`` kinds, and what
#: their patterns look at around them, lies within one.
_RUN = r"(?<![0-9().+\x20-])[().+\x20-]*+[0-9][0-9().+\x20-]*+"
NUMERIC, _LEAST_RUN = ("ip", "card", "phone", "local_phone", "national_id"), 7
#: Each pattern begins at the start of a run of its characters, or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "local_phone": r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "bank_account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+(?![A-Za-z0-9])",
    "person": rf"(?<![A-Za-z])(?=[A-Z][a-z]{{1,15}}+\x20[A-Z][a-z]{{2}})(?:{_GIVEN_NAMES})\x20[A-Z][a-z]{{2,20}}+(?![A-Za-z])",
}
#: Two capitalised words: only where these stand are names compared, one after the other.
_NAMED = r"(?<![A-Za-z])[A-Z][a-z]{1,15}+\x20[A-Z][a-z]{2}"
_STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@.*\.[A-Za-z]{2,24}$",
    "ip": r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$",
    "card": r"^[3-6][0-9]{3}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$",
    "phone": r"^\+[1-9][0-9]{0,2}[\x20(.-].*$",
    "local_phone": r"^(?:\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}|[0-9]{3}([.-])[0-9]{3}\1[0-9]{4})$",
    "national_id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
    "bank_account": r"^[A-Z]{2}(?:0[2-9]|[1-8][0-9]|9[0-8])[A-Z]{0,4}[0-9]{10,}$",
    "person": r"^[A-Z][a-z]+\x20[A-Z][a-z]{3,}$",
}
_GAZETTEER = {
    "email": r"(?i)[@.](?:mail|gmail|outlook|yahoo|proton|example|web|post)[a-z0-9-]*\.",
    "ip": r"^(?:10|127|169\.254|172\.(?:1[6-9]|2[0-9]|3[01])|192\.168)\.",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^\+(?:1|7|20|27|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "local_phone": rf"^\(?(?:{_AREA_CODES})",
    "national_id": r"^(?:[0-5]|6[0-57-9]|7[0-2])",
    "bank_account": r"^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)",
    "person": rf"\x20(?:{_SURNAMES})$",
}
_CONTEXT_FOR = r"(?i)(?:e-?mail|mail|contact|kontakt|contacto|write to|reach|call|phone|tel|fon|mobile|fax|card|karte|carte|tarjeta|visa|credit|ip|host|login|ssn|social security|iban|account|konto|compte|cuenta|name|mr|mrs|ms|herr|frau|dr)[.:\x20]*$"
_CONTEXT_AGAINST = r"(?i)(?:version|release|isbn|issn|order|invoice|sku|part|section|chapter|page|figure|table|v|no|nr|id)[.:#\x20]*$"
#: A labeler's vote: 1 for, 0 against, null for none.
LABELERS = ("strict", "gazetteer", "context", "boundary")


def _by_kind(span: Column, patterns: dict[str, str]) -> Column:
    """Whether the span matches its kind's pattern."""
    out = F.when(span["kind"] == KINDS[0], span["found"].rlike(patterns[KINDS[0]]))
    return reduce(lambda c, k: c.when(span["kind"] == k, span["found"].rlike(patterns[k])), KINDS[1:], out)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        x = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+(?=.)", "")) <= 3) & (F.regexp_replace(p, "^0+(?=.)", "").substr(1, 3).cast("int") <= 255))
    if kind == "card":
        return _luhn(_digits(found))
    if kind == "phone":
        return F.length(_digits(found)).between(9, 15)
    return F.lit(True)


_SPANS = "array<struct<kind:string,start:int,end:int,found:string,before:string,after:string>>"


def _once(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _parts(text: Column, pattern: str) -> Column:
    """array<struct<piece, found, next, at>>: every match with the text before and after it, and where that before begins."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("piece"), found.alias("found"), F.slice(pieces, 2, F.size(found)).alias("next"))
    return _once(parts, lambda p: F.zip_with(p, _running(F.transform(p, lambda x: F.length(x["piece"]) + F.length(x["found"]))), lambda x, at: F.struct(x["piece"].alias("piece"), x["found"].alias("found"), x["next"].alias("next"), at.alias("at"))))


def _spans(text: Column, kind: str, offset: Column | None = None, ahead: Column | None = None, behind: Column | None = None) -> Column:
    """array<struct<kind, start, end, found, before, after>> of a kind, ascending: code points, end
    exclusive; before and after are up to 40 and 1 code points from the text between spans of the kind.
    ``text`` may be a stretch of a longer one that begins at ``offset`` between ``ahead`` and ``behind``."""
    offset, ahead, behind = offset if offset is not None else F.lit(0), ahead if ahead is not None else F.lit(""), behind if behind is not None else F.lit("")

    def span(x: Column, i: Column) -> Column:
        begin = offset + x["at"] + F.length(x["piece"])
        before = F.when(i == 0, F.concat(F.substring(ahead, -40, 40), x["piece"])).otherwise(x["piece"])
        after = F.when(x["next"] == "", F.substring(behind, 1, 1)).otherwise(F.substring(x["next"], 1, 1))
        return F.struct(F.lit(kind).alias("kind"), begin.alias("start"), (begin + F.length(x["found"])).alias("end"), x["found"].alias("found"), F.substring(before, -40, 40).alias("before"), after.alias("after"))

    return F.filter(F.transform(_parts(text, PATTERNS[kind]), span), lambda x: _valid(kind, x["found"]))


def _numeric(runs: Column, kind: str) -> Column:
    """The spans of a kind in the runs of a text."""
    may = {"phone": "+", "ip": ".", "national_id": "-"}.get(kind, "")
    within = F.filter(runs, lambda r: r["found"].contains(may)) if may else runs
    return F.flatten(F.transform(within, lambda r: _spans(r["found"], kind, r["at"] + F.length(r["piece"]), r["piece"], r["next"])))


def _running(lengths: Column) -> Column:
    """Sums of the elements before each one, in blocks of the square root of their number, as an
    accumulator is copied at every step."""
    block = F.greatest(F.ceil(F.sqrt(F.size(lengths))).cast("int"), F.lit(1))

    def within(k: Column) -> Column:
        before = F.aggregate(F.slice(lengths, F.lit(1), k * block), F.lit(0), lambda a, x: a + x)
        start = F.struct(before.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(F.slice(lengths, k * block + 1, block), start, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    return F.when(F.size(lengths) == 0, F.array().cast("array<int>")).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / block).cast("int")), within)))


def with_spans(docs: DataFrame, docs_text: str = "text") -> DataFrame:
    """Adds ``__text`` (null: empty), ``__base`` (base spans) and ``__more`` (candidates that overlap
    none of them), both by kind as listed, then start."""
    none = F.array().cast(_SPANS)
    text = F.col("__text")
    out = docs.withColumn("__text", F.coalesce(F.col(docs_text), F.lit(""))).withColumn("__digits", F.col("__text").rlike("[0-9]"))
    runs = F.filter(_parts(text, _RUN), lambda r: F.length(r["found"]) >= _LEAST_RUN)
    out = out.withColumn("__runs", F.when(F.col("__digits"), runs).otherwise(F.array().cast("array<struct<piece:string,found:string,next:string,at:int>>")))
    needs = {"email": text.contains("@"), "bank_account": F.col("__digits") & text.rlike("[A-Z]{2}[0-9]{2}[A-Z0-9]{11}"), "person": text.rlike(_NAMED)}
    out = out.withColumns({f"__{k}": _numeric(F.col("__runs"), k) if k in NUMERIC else F.when(needs[k], _spans(text, k)).otherwise(none) for k in KINDS})
    out = out.withColumn("__base", F.concat(*(F.col(f"__{k}") for k in BASE)))
    more = F.filter(F.concat(*(F.col(f"__{k}") for k in ADDED)), lambda x: ~F.exists("__base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return out.withColumn("__more", more).drop("__runs", "__digits", *(f"__{k}" for k in KINDS))


def judge(span: Column) -> dict[str, Column]:
    """The labelers' votes on a span, and its features."""
    before, following = span["before"], span["after"]
    previous = F.substring(before, -1, 1)
    glued = previous.rlike(r"[\p{L}\p{N}_/]") | following.rlike(r"[\p{L}\p{N}_/]")
    return {
        "strict": _by_kind(span, _STRICT).cast("int"),
        "gazetteer": F.when(_by_kind(span, _GAZETTEER), 1).when(~span["kind"].isin("email", "ip"), 0),
        "context": F.when(before.rlike(_CONTEXT_FOR), 1).when(before.rlike(_CONTEXT_AGAINST), 0),
        "boundary": F.when(glued, 0).when(previous.rlike(r"[\s(<:,;\"']") | (span["start"] == 0), 1),
        "long": (F.length(span["found"]) >= 16).cast("int"),
        "line_start": ((span["start"] == 0) | (previous == "\n")).cast("int"),
        "quoted": previous.rlike("[\"'<(]").cast("int"),
    }


FEATURES = ("long", "line_start", "quoted")


def expectation_maximisation(patterns: list[tuple[str, tuple[int | None, ...], int]], rounds: int = 50) -> tuple[dict[str, float], list[tuple[float, float]], list[float]]:
    """Counts of (kind, votes) -> prior by kind, each labeler's probability to vote for a
    true and for a false span, and the posterior of every pattern.  Starts at reliable labelers."""
    rates = [(0.8, 0.3)] * len(LABELERS)
    prior = {k: 0.9 if k in BASE else 0.5 for k in KINDS}
    posterior: list[float] = []
    for _ in range(rounds):
        posterior = []
        for kind, votes, _n in patterns:
            yes, no = prior[kind], 1 - prior[kind]
            for (t, f), v in zip(rates, votes, strict=True):
                if v is not None:
                    yes, no = yes * (t if v else 1 - t), no * (f if v else 1 - f)
            posterior.append(yes / (yes + no))
        for k in KINDS:
            own = [(n, p) for (kind, _, n), p in zip(patterns, posterior, strict=True) if kind == k]
            start = 0.9 if k in BASE else 0.5
            prior[k] = min(0.99, (10 * start + sum(n * p for n, p in own)) / (10 + sum(n for n, _ in own)))
        fresh = []
        for e in range(len(LABELERS)):
            cells = [(n, p, v[e]) for (_, v, n), p in zip(patterns, posterior, strict=True) if v[e] is not None]
            t = (8 + sum(n * p for n, p, v in cells if v)) / (10 + sum(n * p for n, p, _ in cells))
            f = (3 + sum(n * (1 - p) for n, p, v in cells if v)) / (10 + sum(n * (1 - p) for n, p, _ in cells))
            fresh.append((t, min(f, t)))  # a labeler is never worse than chance
        rates = fresh
    return prior, rates, posterior


class Classifier:
    """Logistic regression over kind, votes and span features, fitted to soft labels on counts."""

    def __init__(self, weights: list[float]):
        self.weights = weights

    @staticmethod
    def row(kind: str, votes: tuple[int | None, ...], features: tuple[int, ...]) -> list[float]:
        return [float(kind == k) for k in KINDS] + [float(v == x) for v, x in product(votes, (1, 0))] + [float(f) for f in features]

    @classmethod
    def fit(cls, rows: list[tuple[list[float], float, int]]) -> Classifier:
        x, p, n = np.array([r for r, _, _ in rows]), np.array([p for _, p, _ in rows]), np.array([float(n) for _, _, n in rows])
        beta = np.zeros(x.shape[1])
        for _ in range(40):
            q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            grad = x.T @ (n * (q - p)) + beta
            hess = (x * (n * np.maximum(q * (1 - q), 1e-9))[:, None]).T @ x + np.eye(len(beta))
            step = np.linalg.solve(hess, grad)
            beta -= np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-8:
                break
        return cls(beta.tolist())

    def probability(self, span: Column) -> Column:
        judged = judge(span)
        terms = [(span["kind"] == k).cast("double") for k in KINDS]
        terms += [F.coalesce((judged[v] == x).cast("double"), F.lit(0.0)) for v, x in product(LABELERS, (1, 0))]
        terms += [judged[f].cast("double") for f in FEATURES]
        total = reduce(lambda a, b: a + b, (t * F.lit(w) for t, w in zip(terms, self.weights, strict=True)))
        return 1 / (1 + F.exp(-total))


def fit(docs: DataFrame, text: str = "text") -> Classifier | None:
    """Counts the votes over all spans of all documents, runs EM and fits the classifier.

    What is collected is a count for each distinct vote and feature pattern: at most
    kinds x 3^labelers x 2^features rows, whatever the corpus."""
    spans = with_spans(docs.select(F.col(text).alias("text"))).select(F.explode(F.concat("__base", "__more")).alias("s"))
    judged = spans.select(F.col("s.kind").alias("kind"), *(c.alias(n) for n, c in judge(F.col("s")).items()))
    counted = judged.groupBy("kind", *LABELERS, *FEATURES).agg(F.count(F.lit(1)).alias("n")).collect()
    if not counted:
        return None
    counted = sorted(counted, key=lambda r: str(tuple(r)))
    votes = [tuple(r[v] for v in LABELERS) for r in counted]
    _, _, posterior = expectation_maximisation([(r.kind, v, r.n) for r, v in zip(counted, votes, strict=True)])
    return Classifier.fit([(Classifier.row(r.kind, v, tuple(r[f] or 0 for f in FEATURES)), p, r.n) for r, v, p in zip(counted, votes, posterior, strict=True)])


def find(docs: DataFrame, *, text: str = "text", classifier: Classifier | None) -> DataFrame:
    """``docs`` (all columns) plus ``pii_spans``: base spans, then accepted candidates, by kind as
    listed, then start: array<struct<kind, start, end, found>>.

    Candidates are judged in place, as variables of a filter, so nothing is exploded or shuffled."""
    out = with_spans(docs.select(*room_for(docs.columns, "pii_spans string")), text)
    kept = F.filter("__more", lambda s: classifier.probability(s) >= ACCEPT) if classifier else F.slice("__more", 1, 0)
    told = F.transform(F.concat("__base", kept), lambda s: F.struct(*(s[f].alias(f) for f in ("kind", "start", "end", "found"))))
    return out.withColumn("pii_spans", told).drop("__text", "__base", "__more")


def redact(docs: DataFrame, *, text: str = "text", spans: str = "pii_spans") -> DataFrame:
    """Replaces every span in the text by its kind in brackets; overlapping spans become one, of the first's kind."""
    whole = F.coalesce(F.col(text), F.lit(""))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("before"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        end, inside = -s["before"], s["start"] < acc["at"]
        piece = F.concat(acc["out"], F.substr(whole, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], end).alias("at"), F.when(inside, acc["out"]).otherwise(piece).alias("out"))

    clean = F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substr(whole, acc["at"] + 1, F.length(whole))))
    return docs.withColumn(text, F.when(F.size(spans) > 0, clean).otherwise(F.col(text)))


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, classifier=fit(docs))
    own = lambda k: F.size(F.filter("pii_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("pii_spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *(own(k) for k in BASE), F.sha2(_told(base), 256).alias("base_sha256"), _told(F.col("pii_spans")).alias("spans"))
