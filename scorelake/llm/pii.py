"""Personal data by weak supervision, with DataFrame functions only.

``label`` finds candidate spans in whole texts: base kinds by fixed patterns and checks, further kinds by patterns that
need more evidence. Each candidate gets the votes of five labelers (for, against, none): strict form, gazetteer,
context before the span, its borders, and its density in the document. ``fit`` counts vote patterns over all documents
(at most kinds x 3^5 x 4 size classes, whatever the corpus), estimates by expectation-maximisation how reliable each
labeler is, and trains a logistic span classifier on the posteriors. ``decide`` compiles it into column expressions: base
spans stay, other candidates are added if their probability is at least one half.

Patterns are written so that a long run of letters or digits is read once: a match may start only where a run starts
or where the last match ended (other starts could only repeat a failure), and unbounded groups are possessive.

Defined cases: a null or empty text has no spans; repeated rows each get their row; no candidates at all means that
nothing is added; positions are code points, ends exclusive; other columns are kept (``label``, ``redact``) or ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import boxed, stored, text_of

KINDS = ("email", "ip", "card", "phone", "ssn", "secret", "person")
BASE = KINDS[:4]

_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
_SECRET_WORDS = "token|secret|password|passwd|api[_-]?key|access[_-]?key"
_TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Sr|Sra|Mme|Monsieur|Madame"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_LABEL}]++(?:\.[{_LABEL}]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": rf"(?<=(?i:{_SECRET_WORDS})[\"']?\s{{0,3}}[=:]\s{{0,3}}[\"']?)[A-Za-z0-9+/_=-]{{16,}}+",
    "person": rf"\b(?:{_TITLES})\.? \p{{Lu}}\p{{Ll}}{{1,30}}(?: \p{{Lu}}\p{{Ll}}{{1,30}})?",
}
# A text without this cannot match; it spares the pattern a pass.
_NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "ssn": r"[0-9]-[0-9]",
          "secret": rf"(?i){_SECRET_WORDS}", "person": rf"(?:{_TITLES})\.? \p{{Lu}}"}
_CONTEXT = {"email": r"mail|contact|write", "ip": r"\bip\b|server|host|address", "card": r"card|visa|credit|konto|tarjeta|carte",
            "phone": r"phone|call|tel|mobile|fax", "ssn": r"ssn|social|security", "secret": r"token|secret|pass|key",
            "person": r"name|dear|signed|by|von|de"}
_GIVEN_NAMES = "anna|carlos|david|elena|emma|hans|james|jean|john|juan|julia|laura|maria|marie|michael|paul|peter|sofia|thomas"
_GAZETTEER = {
    "email": r"(?i)\.(com|org|net|edu|gov|de|fr|es|io|info|eu|uk)$",
    "ip": r"^(?!0\.|10\.|127\.|169\.254\.|192\.168\.|22[4-9]\.|2[3-5][0-9]\.)",
    "card": r"^[3-6]",
    "phone": r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "ssn": r"^(?!000|666|9)",
    "secret": r"^(?=[^0-9]*+[0-9])(?=[^A-Za-z]*+[A-Za-z])",
    "person": rf"(?i)\b({_GIVEN_NAMES})\b",
}
_STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9.-]+\.[A-Za-z]{2,24}$",
    "ip": r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$",
    "card": r"^[0-9]{13,19}$|^[0-9]{4}([ -][0-9]{4}){2,3}$",
    "phone": r"^\+[0-9]{1,3}[ .-]?(\([0-9]{1,4}\)[ .-]?)?[0-9]{2,}([ .-][0-9]{2,})*$",
    "ssn": r"^[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "secret": r"^([0-9A-Fa-f]{32,}|[A-Za-z0-9+/_=-]{20,})$",
    "person": r" \p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+$",
}
DENSE = 20                    # candidates of one kind in a text from which they look like a table of numbers
LABELERS = ("strict", "gazetteer", "context", "borders", "density")
_BLOCK = 128


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _located(text: Column, pattern: str) -> Column:
    """``start, end, m`` of all matches. Starts are sums of the lengths before them, taken block by block."""
    none = F.array().cast("array<struct<start:int,end:int,m:string>>")

    def place(g: Column) -> Column:
        steps = F.sequence(F.lit(0), F.size(g["found"]) - 1)
        lens = F.transform(steps, lambda i: F.length(F.get(g["gaps"], i)) + F.when(
            i > 0, F.length(F.get(g["found"], i - 1))).otherwise(0))
        return _let(lens, lambda n: _let(F.transform(
            F.sequence(F.lit(0), ((F.size(n) - 1) / _BLOCK).cast("int")), lambda b: _total(F.slice(n, b * _BLOCK + 1, _BLOCK))),
            lambda sums: _let(F.transform(sums, lambda _, b: _total(F.slice(sums, F.lit(1), b))), lambda before: F.transform(
                g["found"], lambda m, i: _let(
                    F.get(before, (i / _BLOCK).cast("int")) + _total(F.slice(n, (i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK + 1)),
                    lambda start: F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("m")))))))

    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return _let(both, lambda g: F.when(F.size(g["found"]) > 0, place(g)).otherwise(none))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total, i):
        x = F.ascii(F.substring(digits, i, F.lit(1))) - 48
        return total + F.when((F.length(digits) - i) % 2 == 1, 2 * x - F.when(x > 4, 9).otherwise(0)).otherwise(x)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    """Checks of the base kinds."""
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda part: _let(
            F.regexp_replace(part, "^0+(?=[0-9])", ""), lambda x: (F.length(x) <= 3) & (x.cast("int") <= 255)))
    if kind == "card":
        return _let(_digits(m), lambda d: F.length(d).between(12, 19) & _luhn(d))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(kind == "email")


def _vote(yes: Column, no: Column | None = None) -> Column:
    return F.when(yes, 1).when(F.lit(True) if no is None else no, -1).otherwise(0).cast("int")


def _judged(kind: str, text: Column, many: Column, s: Column) -> Column:
    """The span with its votes and size class."""
    m, start = s["m"], s["start"]
    before = F.lower(F.substring(text, F.greatest(start - 39, F.lit(1)), F.least(start, F.lit(40))))
    around = F.concat(F.when(start > 0, F.substring(text, start, F.lit(1))).otherwise(""), F.substring(text, s["end"] + 1, F.lit(1)))
    votes = F.array(
        _vote(F.rlike(m, F.lit(_STRICT[kind]))),
        _vote(F.rlike(m, F.lit(_GAZETTEER[kind]))),
        _vote(F.rlike(before, F.lit(_CONTEXT[kind])), F.lit(False)),
        _vote(~F.rlike(around, F.lit(r"[\p{L}\p{N}_@-]"))),
        _vote(F.lit(False), many))
    size = F.when(F.length(m) < 12, 0).when(F.length(m) < 20, 1).when(F.length(m) < 40, 2).otherwise(3)
    return F.struct(F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).alias("nth"), start.alias("start"), s["end"].alias("end"),
                    _passes(kind, m).alias("base"), votes.alias("votes"), size.cast("int").alias("size"))


def spans_of(text: Column) -> Column:
    """All candidates of a text."""
    none = F.array().cast("array<struct<kind:string,nth:int,start:int,end:int,base:boolean,votes:array<int>,size:int>>")

    def judged(kind: str) -> Column:
        return _let(_located(text, PATTERNS[kind]), lambda every: F.transform(
            every, lambda s: _judged(kind, text, F.size(every) >= DENSE, s)))

    return F.concat(*[F.when(F.rlike(text, F.lit(_NEEDS[kind])), judged(kind)).otherwise(none) for kind in KINDS])


def label(docs: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """``docs`` with its candidates, written to the shared folder (texts are searched once)."""
    return stored(docs.withColumn(spans_col, spans_of(text_of(text_col))), "pii-candidates")


def fit(labelled: DataFrame, spans_col: str = "spans", rounds: int = 50) -> dict:
    """Reliabilities of the labelers and the weights of the span classifier."""
    rows = (labelled.select(F.explode(spans_col).alias("s")).groupBy("s.kind", "s.votes", "s.size").count()
            .orderBy("kind", "votes", "size").collect())                          # bounded by construction
    weight = [r["count"] for r in rows]
    total = sum(weight)
    if not total:
        return {"weights": None, "reliability": {}}
    share = [0.9 if sum(r.votes) > 0 else 0.5 if sum(r.votes) == 0 else 0.1 for r in rows]
    given = [[{}, {}] for _ in LABELERS]
    for _ in range(rounds):
        prior = {}
        for kind in {r.kind for r in rows}:
            own = [(w, p) for r, w, p in zip(rows, weight, share, strict=True) if r.kind == kind]
            prior[kind] = (sum(w * p for w, p in own) + 1) / (sum(w for w, _ in own) + 2)
        for j in range(len(LABELERS)):
            for y in (0, 1):
                count = {-1: 1.0, 0: 1.0, 1: 1.0}
                for r, w, p in zip(rows, weight, share, strict=True):
                    count[r.votes[j]] += w * (p if y else 1 - p)
                given[j][y] = {v: c / sum(count.values()) for v, c in count.items()}
        fresh = []
        for r in rows:
            odds = math.log(prior[r.kind] / (1 - prior[r.kind])) + sum(
                math.log(given[j][1][v] / given[j][0][v]) for j, v in enumerate(r.votes))
            fresh.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        moved = max(abs(a - b) for a, b in zip(share, fresh, strict=True))
        share = fresh
        if moved < 1e-6:
            break
    names = [*(f"{name}{sign}" for name in LABELERS for sign in "+-"), *KINDS, *(f"size{k}" for k in range(4))]
    active = [[*(2 * j + (v < 0) for j, v in enumerate(r.votes) if v), 2 * len(LABELERS) + KINDS.index(r.kind),
               2 * len(LABELERS) + len(KINDS) + r.size] for r in rows]
    weights, bias = [0.0] * len(names), 0.0
    for _ in range(400):                                                         # gradient ascent with a ridge
        slope, lift = [0.0] * len(names), 0.0
        for on, w, p in zip(active, weight, share, strict=True):
            miss = w / total * (p - 1 / (1 + math.exp(-(bias + sum(weights[k] for k in on)))))
            lift += miss
            for k in on:
                slope[k] += miss
        bias += 2.0 * lift
        weights = [x + 2.0 * (g - 1e-4 * x) for x, g in zip(weights, slope, strict=True)]
    return {"weights": dict(zip(names, weights, strict=True)) | {"bias": bias},
            "reliability": {name: given[j] for j, name in enumerate(LABELERS)}}


def probability(span: Column, model: dict) -> Column:
    """Probability of a span under a fitted model, as an expression."""
    w = model["weights"]
    score = F.lit(w["bias"])
    for j, name in enumerate(LABELERS):
        vote = F.get(span["votes"], F.lit(j))
        score = score + F.when(vote > 0, w[f"{name}+"]).when(vote < 0, w[f"{name}-"]).otherwise(0.0)
    kind, size = F.lit(0.0), F.lit(0.0)
    for name in KINDS:
        kind = F.when(span["kind"] == name, w[name]).otherwise(kind)
    for k in range(4):
        size = F.when(span["size"] == k, w[f"size{k}"]).otherwise(size)
    return 1 / (1 + F.exp(-(score + kind + size)))


def decide(labelled: DataFrame, model: dict, spans_col: str = "spans") -> DataFrame:
    """Keep base spans and the candidates that the classifier adds, in order of start, then kind."""
    if model["weights"] is None:
        kept = F.filter(spans_col, lambda s: s["base"])
    else:
        kept = F.filter(spans_col, lambda s: s["base"] | (~s["kind"].isin(*BASE) & (probability(s, model) >= 0.5)))
    ordered = F.array_sort(F.transform(kept, lambda s: F.struct(
        s["start"].alias("start"), s["nth"].alias("nth"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base"))))
    return labelled.withColumn(spans_col, ordered)


def find(docs: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """``docs`` with the array of its personal-data spans (start, nth, end, kind, base)."""
    labelled = label(docs, text_col, spans_col)
    return decide(labelled, fit(labelled, spans_col), spans_col)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts per base kind, digest of the base spans, and all spans as text."""
    found = find(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select(F.col("id").alias(id_col), *map(count, BASE), F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
                        _listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; where spans overlap, the first stands for all."""
    found = find(boxed(docs, text=text_col), "text", "spans")
    text = text_of("text")
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<from:int,to:int,kind:string>>").alias("cuts"))

    def take(acc, s):
        cut = F.struct(acc["at"].alias("from"), s["start"].alias("to"), s["kind"].alias("kind"))
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["cuts"], F.array(cut)).alias("cuts"))).otherwise(
            F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["cuts"].alias("cuts")))

    walked = F.aggregate("spans", state, take)
    rewritten = _let(walked, lambda w: F.concat(
        F.array_join(F.transform(w["cuts"], lambda c: F.concat(
            F.substring(text, c["from"] + 1, c["to"] - c["from"]), F.lit("["), F.upper(c["kind"]), F.lit("]"))), ""),
        F.substring(text, w["at"] + 1, F.length(text))))
    changed = F.when(F.size("spans") > 0, rewritten).otherwise(F.col("text"))
    return found.select(*[(changed if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
