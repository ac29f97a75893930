"""Personal data: generators propose spans, boosted trees and calibrated thresholds choose among the doubtful ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, calibrate, fit_trees, score
from .common import settle

KINDS = ["email", "ip", "card", "phone"]
SAMPLE = 20_000  # candidates that the trees are fitted on
STEPS = 1 << 16  # of the scores that are counted for a threshold; bounds what reaches the driver
PRECISION = 0.98  # of the spans that a threshold lets through
LEAST = 0.5  # probability of a span that is added, whatever its kind's threshold
FEATURES = ["kind", "length", "digits", "letters", "groups", "longest", "cue", "before", "after", "valid", "sentence"]
#: Words near a span that speak for its kind.
CUES = {
    "email": "mail|contact|kontakt|correo|courriel|write to",
    "ip": r"\bip\b|host|server|addr|login|client",
    "card": "card|visa|credit|karte|carte|tarjeta|payment|iban",
    "phone": "phone|tel|call|mobil|fax|dial|whatsapp",
}
# Base patterns, written so that a run is never scanned again from its middle: a match can
# start only where its run starts or where the last match ended, and runs are possessive.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9]){11,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
# More generous generators.
SPELT_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z0-9-]{1,63}+)++"
NUMBER = r"(?<![0-9A-Za-z+.-])\(?[0-9](?:[ ()./-]{0,2}[0-9]){8,}+"
DATE = r"^\(?(?:19|20)[0-9]{2}[-/. ]{1,2}[0-9]{1,2}[-/. ]{1,2}[0-9]{1,2}(?![0-9])"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    back = F.reverse(digits)

    def add(total, i):
        v = F.substr(back, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, v).otherwise(2 * v - F.when(v > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    n = F.length(_digits(match))
    if kind == "ip":
        short = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(short, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False))
    if kind == "card":
        return F.when(n.between(12, 19), luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _found(text: Column, pattern: str) -> Column:
    """Matches of one generator, leftmost and non-overlapping, with places in code points."""
    gaps, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<gap:string,match:string,next:string,start:int,end:int>>").alias("out"))
    items = F.transform(matches, lambda m, i: F.struct(F.element_at(gaps, i + 1).alias("gap"), m.alias("match"), F.element_at(gaps, i + 2).alias("next")))

    def step(done, x):
        begin = done["at"] + F.length(x["gap"])
        end = begin + F.length(x["match"])
        one = F.struct(x["gap"], x["match"], x["next"], begin.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(done["out"], F.array(one)).alias("out"))

    return F.aggregate(items, start, step)["out"]


def _candidate(x: Column, match: Column, kind: str, base: bool) -> Column:
    """Features of ``match`` at the place of ``x``; ``base`` where a base pattern's match passes its kind's check."""
    near = F.lower(F.right(x["gap"], F.lit(30)))
    runs = F.filter(F.split(match, "[^0-9]+"), lambda g: g != "")
    number, valid = F.lit(float(KINDS.index(kind))), _valid(kind, match)
    if not base and kind == "phone":  # of the generator of numbers
        card = F.length(_digits(match)) > 12
        number = F.when(card, F.lit(float(KINDS.index("card")))).otherwise(number)
        valid = F.when(card, _valid("card", match)).otherwise(valid)
    cues = F.lit(False)
    for i, k in enumerate(KINDS):
        cues = F.when(number == i, F.rlike(near, F.lit(CUES[k]))).otherwise(cues)
    return F.struct(
        x["start"].alias("start"), x["end"].alias("end"), number.alias("kind"),
        (valid if base else F.lit(False)).alias("base"),
        F.length(match).cast("double").alias("length"),
        F.length(_digits(match)).cast("double").alias("digits"),
        F.length(F.regexp_replace(match, "[^A-Za-z]", "")).cast("double").alias("letters"),
        F.size(runs).cast("double").alias("groups"),
        F.coalesce(F.array_max(F.transform(runs, lambda g: F.length(g))), F.lit(0)).cast("double").alias("longest"),
        cues.cast("double").alias("cue"),
        F.rlike(F.right(x["gap"], F.lit(1)), F.lit("[A-Za-z0-9_=/#.-]")).cast("double").alias("before"),
        F.rlike(F.left(x["next"], F.lit(1)), F.lit("[A-Za-z0-9_=/#-]")).cast("double").alias("after"),
        valid.cast("double").alias("valid"),
        F.rlike(match, F.lit(r"[^ ]\. ")).cast("double").alias("sentence"),
        (F.lit(None).cast("double") if not base else F.when(~valid, F.lit(0.0))).alias("label"),
    )


def _labelled(found: Column, kind: str) -> Column:
    """Examples with known labels for the generous generators, from what a base pattern found.

    A valid span written so that its base pattern would miss it is a positive: a phone without
    ``+`` or without its country, a card with dots, an address with spelt-out signs.  Words of
    the text before an address, written like a spelt address, are a negative.
    """
    def example(x, match, label):
        one = _candidate(x, match, kind, False)
        return one.withField("label", F.lit(label))

    def made(x):
        match = x["match"]
        if kind == "phone":
            own, fit = [(F.substr(match, F.lit(2)), 1.0), (F.regexp_replace(match, r"^\+[0-9]{1,3}[ .-]+(?=[(0-9])", ""), 1.0)], NUMBER
        elif kind == "card":
            own, fit = [(F.regexp_replace(match, "[ -]", "."), 1.0), (F.regexp_replace(match, "[ -]", "  "), 1.0), (F.regexp_replace(_digits(match), "([0-9]{4})(?=[0-9])", "$1."), 1.0)], NUMBER
        else:
            local, domain = F.substring_index(match, "@", 1), F.substring_index(match, "@", -1)
            words = F.filter(F.split(F.right(x["gap"], F.lit(60)), "[^A-Za-z]+"), lambda w: w != "")
            said = F.concat(F.element_at(words, -3), F.lit(" (at) "), F.element_at(words, -2), F.lit(". "), F.element_at(words, -1))
            own = [(F.concat(local, F.lit(" [at] "), F.replace(domain, F.lit("."), F.lit(" [dot] "))), 1.0), (F.concat(local, F.lit("(at)"), domain), 1.0)]
            own.append((F.when(F.size(words) >= 3, said), 0.0))
            fit = SPELT_EMAIL
        every = F.array(*(F.when(F.rlike(m, F.lit(f"^(?:{fit})$")), example(x, m, v)) for m, v in own))
        return F.filter(every, lambda e: e.isNotNull())

    good = F.filter(found, lambda x: _valid(kind, x["match"]))
    return F.flatten(F.transform(good, made))


def _proposed(kind: str, base: bool):
    def candidate(x):
        one = _candidate(x, x["match"], kind, base)
        if base or kind != "phone":
            return one
        wrong = (one["kind"] == KINDS.index("card")) & (one["valid"] == 0)
        return one.withField("label", F.when(wrong | _plain(x, one), F.lit(0.0)))

    return candidate


def _plain(x: Column, one: Column) -> Column:
    """Negatives among the numbers: dates, and single runs of digits that no cue precedes."""
    return (one["kind"] == KINDS.index("phone")) & (F.rlike(x["match"], F.lit(DATE)) | ((one["groups"] == 1) & (one["cue"] == 0)))


SPAN = "array<struct<start:int,end:int,kind:double,base:boolean,length:double,digits:double,letters:double,groups:double,longest:double,cue:double,before:double,after:double,valid:double,sentence:double,label:double>>"


MATCH = "array<struct<gap:string,match:string,next:string,start:int,end:int>>"


def with_candidates(docs: DataFrame) -> DataFrame:
    """Adds ``_spans``: what the generators propose in each whole text, and ``_made``: examples for ``fit``.

    Spans of base patterns that pass their kind's check are ``base`` and may overlap each other;
    any other that meets one of these is left out.

    A generator runs only where a character that its matches need occurs.
    """
    text = F.coalesce("text", F.lit(""))
    digit = F.rlike(text, F.lit("[0-9]"))
    given = [
        (F.contains(text, F.lit("@")), EMAIL, "email", True), (digit, IP, "ip", True), (digit, CARD, "card", True), (F.contains(text, F.lit("+")), PHONE, "phone", True),
        (F.rlike(text, F.lit(r"[\[(](?:at|AT)[\])]")), SPELT_EMAIL, "email", False), (digit, NUMBER, "phone", False),
    ]
    own, spans, made = docs, [], []
    for i, (here, pattern, kind, base) in enumerate(given):
        own = own.withColumn(f"_m{i}", F.when(here, _found(text, pattern)).otherwise(F.array().cast(MATCH)))
        spans.append(F.transform(f"_m{i}", _proposed(kind, base)).cast(SPAN))
        if base and kind != "ip":
            made.append(_labelled(F.col(f"_m{i}"), kind).cast(SPAN))
    names = [f"_m{i}" for i in range(len(given))]
    own = own.withColumns({"_all": F.concat(*spans), "_made": F.concat(*made)}).drop(*names)
    own = own.withColumn("_base", F.filter("_all", lambda s: s["base"]))
    clear = F.filter("_all", lambda s: s["base"] | ~F.exists("_base", lambda b: _meets(s, b)))
    return own.withColumn("_spans", clear).drop("_all", "_base")


def _meets(a, b):
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


class Model:
    """Trees for doubtful spans and the least probability for each kind."""

    def __init__(self, trees: Trees, limits: dict[int, float]):
        self.trees, self.limits = trees, limits


def fit(found: DataFrame, sample: int = SAMPLE, precision: float = PRECISION) -> Model:
    """Fits trees on at most ``sample`` candidates, those of the smallest digests, and thresholds on all.

    The labels do not depend on the generator that proposes a span.  Positives are valid base
    spans written as a generous generator would meet them (see ``_labelled``); negatives are
    spans of base patterns that fail their kind's check, dates, plain digit runs without a cue,
    and ordinary words around an "at".  Other doubtful spans have no label and are not learnt
    from.  Half of the examples, dealt by their places, trains the trees (those in the sample);
    the whole other half calibrates them, counted by kind and score in steps of 1 / STEPS: a kind's threshold is the least score around which its examples are
    positive with the wanted precision.  A kind without such a threshold gains no spans.
    """
    spans = found.select("doc_id", F.explode(F.concat("_spans", "_made")).alias("s")).select("doc_id", "s.*").where("label is not null")
    place = F.xxhash64("doc_id", "start")  # all ways to write one span stay together
    drawn = spans.orderBy(place, "doc_id", "start", "end", "kind", *FEATURES[1:], "label").limit(sample)
    half = F.pmod(F.xxhash64(F.lit(7), "doc_id", "start"), F.lit(2))
    train = [([r[c] for c in FEATURES], r["label"]) for r in drawn.where(half == 0).select("label", *FEATURES).collect()]
    trees = fit_trees([x for x, _ in train], [y for _, y in train], rounds=12)
    step = F.floor(score(trees, {c: F.col(c) for c in FEATURES}, FEATURES) * STEPS) / STEPS
    counted = spans.where(half == 1).groupBy("kind", step.alias("score")).agg(F.sum("label").alias("positives"), F.count(F.lit(1)).alias("n")).collect()
    limits = {}
    for k in range(len(KINDS)):
        own = [r for r in counted if r["kind"] == k]
        limits[k] = calibrate([r["score"] for r in own], [r["positives"] for r in own], precision, [r["n"] for r in own]) if own else 2.0
    return Model(trees, limits)


def with_spans(found: DataFrame, model: Model, into: str = "spans") -> DataFrame:
    """Replaces ``_spans`` by the column ``into`` (kind, start, end, base, score), by start, then kind.

    All base spans stay.  Another span is added if it passes its kind's check (digits, Luhn),
    its probability is at least a half and reaches its kind's threshold, and it overlaps neither a base span nor a likelier added one (ties: the earlier, then the longer).
    """
    base = F.filter("_spans", lambda s: s["base"])
    limit = F.create_map(*(F.lit(x) for k, v in model.limits.items() for x in (float(k), v)))

    def scored(s):
        p = score(model.trees, {c: s[c] for c in FEATURES}, FEATURES)
        return F.struct(s["start"], s["end"], s["kind"], s["base"], p.alias("score"))

    def first(a, b):
        return (a["score"] > b["score"]) | ((a["score"] == b["score"]) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["end"] > b["end"]))))

    staged = found.withColumn("_base", F.transform(base, scored)).withColumn("_more", F.filter(F.transform(F.filter("_spans", lambda s: ~s["base"] & (s["valid"] == 1)), scored), lambda s: (s["score"] >= F.greatest(limit[s["kind"]], F.lit(LEAST)))))
    staged = staged.withColumn("_more", F.array_distinct("_more"))
    staged = staged.withColumn("_more", F.filter("_more", lambda s: ~F.exists("_more", lambda b: _meets(s, b) & first(b, s))))
    ordered = F.array_sort(F.transform(F.concat("_base", "_more"), lambda s: F.struct(s["start"], s["kind"], s["end"], s["base"], s["score"])))
    names = F.array(*map(F.lit, KINDS))
    return staged.withColumn(
        into, F.transform(ordered, lambda s: F.struct(F.element_at(names, s["kind"].cast("int") + 1).alias("kind"), s["start"], s["end"], s["base"], s["score"]))
    ).drop("_spans", "_made", "_base", "_more")


def redact(docs: DataFrame, spans: str = "spans") -> DataFrame:
    """Replaces each span of ``text`` by ``<KIND>``; of overlapping spans the first one's mark stands for all."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(done, s):
        mark = F.concat(F.substr("text", done["at"] + 1, F.greatest(s["start"] - done["at"], F.lit(0))), F.when(s["start"] >= done["at"], F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(""))
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.concat(done["out"], mark).alias("out"))

    done = F.aggregate(spans, start, step)
    whole = F.concat(done["out"], F.substr("text", done["at"] + 1, F.lit(1 << 30)))
    return docs.withColumn("text", F.when(F.size(spans) > 0, whole).otherwise(F.col("text")))


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` of every whole text; the model is fitted on the candidates of ``docs``.

    A null or empty text has no spans; a null doc_id stays null; rows that repeat get the same
    spans; other columns are ignored; no rows give no rows.
    """
    found = settle(with_candidates(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text"))
    return with_spans(found, fit(found)).select("doc_id", "spans")
