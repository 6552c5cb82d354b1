"""Personal data by weak supervision, in DataFrame functions alone.

Candidates are the spans that strict patterns find (the base, always kept) and those of looser patterns: spelled-out
mail addresses, telephone numbers without country code, 13-digit card numbers, colon-separated addresses.  Six
labelers vote 1, 0 or -1 on each: shape, checksum, gazetteer, words before, contrary words before, boundaries.
Expectation-maximisation over the counts of vote patterns estimates how each labeler votes on true and on false spans;
its posteriors are the soft labels of a logistic span classifier over votes, kind and length, which decides on the
looser spans.  A looser span that touches a base span is left out.

What training reads is one row for each pattern that occurs, at most 4 * 3**6 * 4; EM and gradient steps are
aggregates over that table, and the driver holds only their sums.

Defined results: null and empty texts have no spans; positions are code points, ends exclusive; repeated rows get the
same result; an empty table gives an empty result and untrained defaults; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, materialize, unboxed

KINDS = ("email", "ip", "card", "phone")

# The base patterns.  They find what the plain forms find; possessive quantifiers and look-behinds
# (or the end of the last match, \G) only spare attempts that cannot succeed, so long runs take linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:[(\[]dot[)\]]|\.)\x20?|\x20dot\x20)|\x20at\x20[A-Za-z0-9-]++\x20dot\x20)[A-Za-z]{2,}+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}+:){7}+[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12}+(?![\x20-]?[0-9])",
    "phone": r"(?<![0-9+(.-])(?<![0-9+]\x20)\(?[0-9]{3}\)?[\x20.-]\x20?[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-]*[0-9])",
}
#: Texts without this cannot hold a candidate of the kind.
NEEDS = {
    "email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"), "phone": lambda t: t.contains("+"),
}
LOOSE_NEEDS = {
    "email": lambda t: t.contains("(at)") | t.contains("[at]") | t.contains(" dot "), "ip": lambda t: t.rlike(r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"), "card": NEEDS["card"], "phone": lambda t: t.rlike(r"[0-9][\x20.-][0-9]{4}"),
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

# Gazetteers and context words.
TOP_DOMAINS = "com|org|net|edu|gov|info|io|eu|de|fr|es|uk|us|at|ch|be|it|nl"
CALLING_CODES = "1|7|20|27|30|31|32|33|34|39|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
CARD_ISSUERS = "4|5[1-5]|2[2-7]|3[47]|30[0-5]|3[68]|6011|65|62"
SPECIAL_NETS = "0|127|169|22[4-9]|23[0-9]|24[0-9]|25[0-5]"
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|contacto|correo|courriel|adresse)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|addr|client|peer|adresse|servidor|serveur)\b",
    "card": r"(?i)\b(?:card|visa|credit|debit|mastercard|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|telefono|handy|appelez|llame)\b",
}
CONTRARY = r"(?i)(?:\b(?:version|release|build|isbn|order|invoice|serial|sha|token|key|id|no|nr|ref)\b[\s.:#=\"']*|[#=$_\"'])$"

LABELERS = ("shape", "checksum", "gazetteer", "context", "contrary", "boundary")
EM_STEPS, FIT_STEPS, FIT_RATE, RIDGE = 8, 12, 1.5, 1e-3
LENGTHS = (12, 16, 20)


def _found(text: Column, pattern: str, needed: Column) -> Column:
    """array<struct<gap, hit>>: every match with the text since the one before."""
    whole = F.lit(r"(?s)\G(.*?)(" + pattern + ")")
    none = F.array().cast("array<string>")
    gaps = F.when(needed, F.regexp_extract_all(text, whole, F.lit(1))).otherwise(none)
    hits = F.when(needed, F.regexp_extract_all(text, whole, F.lit(2))).otherwise(none)
    return F.arrays_zip(gaps.alias("gap"), hits.alias("hit"))


def _placed(found: Column) -> Column:
    """Adds code-point positions and the 40 characters before: array<struct<start, end, hit, before>>."""
    zero = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<struct<start:int,end:int,hit:string,before:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"), F.right(x["gap"], F.lit(40)).alias("before"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.when(F.size(found) == 0, zero["out"]).otherwise(F.aggregate(found, zero, step)["out"])


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def step(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _sound(kind: str, hit: Column) -> Column:
    """Whether a match keeps the rule of its kind."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return hit.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return luhn(_digits(hit))
    return F.length(_digits(hit)).between(10, 15)


def _gazetteer(kind: str, hit: Column) -> Column:
    if kind == "email":
        return F.when(hit.rlike(rf"(?i)[.\x20\])](?:{TOP_DOMAINS})$"), 1).otherwise(0)
    if kind == "ip":
        return F.when(hit.rlike(rf"^(?:{SPECIAL_NETS})\."), -1).otherwise(F.when(hit.contains(":"), 0).otherwise(1))
    if kind == "card":
        return F.when(_digits(hit).rlike(f"^(?:{CARD_ISSUERS})"), 1).otherwise(-1)
    return F.when(hit.rlike(rf"^\+(?:{CALLING_CODES})"), 1).otherwise(0)


def _voted(kind: str, rank: int, base: bool, text: Column, spans: Column) -> Column:
    """Spans of a kind with their votes: array<struct<start, rank, end, kind, base, votes, long>>."""

    def one(s: Column) -> Column:
        hit, sound = s["hit"], _sound(kind, s["hit"])
        after = F.substring(text, s["end"] + 1, F.lit(1))
        checksum = F.when(sound, 1).otherwise(-1) if kind != "email" else F.when(hit.rlike(r"(?i)[A-Za-z]{2,}$"), 1).otherwise(-1)
        votes = [
            F.lit(1) if base else F.lit(0),
            checksum if base or kind in ("card", "email") else F.lit(0),
            _gazetteer(kind, hit),
            F.when(s["before"].rlike(CONTEXT[kind]), 1).otherwise(0),
            F.when(s["before"].rlike(CONTRARY), -1).otherwise(0),
            F.when(s["before"].rlike(r"[\p{L}0-9_]$") | after.rlike(r"[\p{L}0-9_]"), -1).otherwise(1),
        ]
        long = sum((F.when(s["end"] - s["start"] > n, 1).otherwise(0) for n in LENGTHS), F.lit(0))
        return F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(base).alias("base"),
            F.struct(*[v.cast("int").alias(n) for n, v in zip(LABELERS, votes, strict=True)]).alias("votes"), long.cast("int").alias("long"),
        )

    kept = F.filter(spans, lambda s: _sound(kind, s["hit"])) if base or kind == "card" else spans
    return F.transform(kept, one)


def with_candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with the column __spans, all candidates of each text in order."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found, placed, voted = {}, {}, []
    for base, patterns, needs in ((True, BASE, NEEDS), (False, LOOSE, LOOSE_NEEDS)):
        for rank, kind in enumerate(KINDS):
            name = f"__{kind}{int(base)}"
            found[name] = _found(text, patterns[kind], needs[kind](text))
            placed[name] = _placed(F.col(name))
            voted.append(_voted(kind, rank, base, text, F.col(name)))
    every = F.concat(*voted)
    d = docs.withColumns(found).withColumns(placed).withColumn("__spans", every).drop(*found)
    clear = F.filter("__spans", lambda s: s["base"] | ~F.exists("__spans", lambda b: b["base"] & (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return d.withColumn("__spans", F.when(F.size("__spans") > 0, F.array_sort(clear)).otherwise(F.col("__spans")))


def _features() -> list[Column]:
    """Of a pattern row (kind, the votes, long): values of the classifier's inputs."""
    out = [F.when(F.col("kind") == k, 1.0).otherwise(0.0) for k in KINDS]
    for n in LABELERS:
        out += [F.when(F.col(n) == 1, 1.0).otherwise(0.0), F.when(F.col(n) == -1, 1.0).otherwise(0.0)]
    return [*out, F.col("long") / float(len(LENGTHS))]


def _start() -> dict:
    """Before EM: labelers agree with the truth more often than not."""
    vote = {(n, v, y): (0.6 if v == (1 if y else -1) else 0.3 if v == 0 else 0.1) for n in LABELERS for v in (1, 0, -1) for y in (0, 1)}
    return {"vote": vote, "prior": {k: 0.5 for k in KINDS}}


def _posterior(p: dict) -> Column:
    """Parameters go in as one array, so the compiled code is the same in every step."""
    odds = [math.log(p["vote"][n, v, 1] / p["vote"][n, v, 0]) for n in LABELERS for v in (-1, 0, 1)]
    odds += [math.log(p["prior"][k] / (1 - p["prior"][k])) for k in KINDS]
    given = F.lit(odds)
    z = F.get(given, 3 * len(LABELERS) + F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1)
    for i, n in enumerate(LABELERS):
        z = z + F.get(given, F.col(n) + 1 + 3 * i)
    return 1 / (1 + F.exp(-z))


def fit(spans: DataFrame) -> dict:
    """``spans``: rows with __spans.  -> {"vote", "prior" (EM), "weights" (classifier)}."""
    s = spans.select(F.explode("__spans").alias("s")).select("s.kind", "s.votes.*", "s.long")
    patterns = materialize(s.groupBy("kind", *LABELERS, "long").agg(F.count("*").alias("n")).coalesce(1), "pii-patterns")
    p = _start()
    y = {1: F.col("n") * F.col("y1"), 0: F.col("n") * (1 - F.col("y1"))}
    sums = [F.sum(F.when(F.col(n) == v, y[c])).alias(f"{n}{v}{c}") for n in LABELERS for v in (1, 0, -1) for c in (0, 1)]
    sums += [F.sum(F.when(F.col("kind") == k, y[c])).alias(f"{k}{c}") for k in KINDS for c in (0, 1)]
    for _ in range(EM_STEPS):
        r = patterns.withColumn("y1", _posterior(p)).agg(*sums).first()
        for n in LABELERS:
            for c in (0, 1):
                got = {v: (r[f"{n}{v}{c}"] or 0.0) + 1.0 for v in (1, 0, -1)}
                p["vote"] |= {(n, v, c): x / sum(got.values()) for v, x in got.items()}
        p["prior"] = {k: min(0.999, max(0.001, ((r[f"{k}1"] or 0.0) + 1) / ((r[f"{k}1"] or 0.0) + (r[f"{k}0"] or 0.0) + 2))) for k in KINDS}
    labelled = materialize(patterns.select("kind", *LABELERS, "long", "n", _posterior(p).alias("y")).coalesce(1), "pii-labelled")
    x = _features()
    w, gain = [0.0] * len(x), [1e-6] * len(x)
    total = labelled.agg(F.sum("n")).first()[0] or 1
    slopes = [F.sum(F.col("off") * f).alias(f"g{i}") for i, f in enumerate(x)]
    for _ in range(FIT_STEPS):
        off = F.col("n") * (_score(x, w) - F.col("y")) / float(total)
        r = labelled.withColumn("off", off).agg(*slopes).first()
        for i in range(len(x)):
            g = (r[f"g{i}"] or 0.0) + RIDGE * w[i]
            gain[i] += g * g
            w[i] -= FIT_RATE * g / math.sqrt(gain[i])  # each weight has a step of its own
    return p | {"weights": w}


def _score(x: list[Column], w: list[float]) -> Column:
    given = F.lit([float(a) for a in w])
    return 1 / (1 + F.exp(-sum((F.get(given, F.lit(i)) * f for i, f in enumerate(x)), F.lit(0.0))))


def accepted(model: dict) -> Column:
    """The spans that stay: base ones, and those that the classifier takes for personal data."""
    w = iter(model["weights"])
    kinds, ups = {k: next(w) for k in KINDS}, {n: (next(w), next(w)) for n in LABELERS}
    per_length = next(w)

    def yes(s: Column) -> Column:
        z = F.lit(0.0)
        for k in KINDS:
            z = F.when(s["kind"] == k, F.lit(kinds[k])).otherwise(z)
        for n, (up, down) in ups.items():
            z = z + F.when(s["votes"][n] == 1, up).when(s["votes"][n] == -1, down).otherwise(0.0)
        return s["base"] | (z + s["long"] * (per_length / len(LENGTHS)) >= 0)

    return F.filter("__spans", yes)


def _text_of(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count_of(kind: str) -> Column:
    return F.size(F.filter("__base", lambda s: s["kind"] == kind)).cast("long")


def find(docs: DataFrame) -> DataFrame:
    """The op1 result: doc_id, n_email, n_ip, n_card, n_phone (of the base), base_sha256, spans."""
    spans = materialize(with_candidates(docs.select("doc_id", "text")).select("doc_id", "__spans"), "pii-spans")
    d = spans.withColumn("__all", accepted(fit(spans))).withColumn("__base", F.filter("__spans", lambda s: s["base"]))
    counts = [_count_of(k).alias(f"n_{k}") for k in KINDS]
    return d.select("doc_id", *counts, F.sha2(_text_of(F.col("__base")), 256).alias("base_sha256"), _text_of(F.col("__all")).alias("spans"))


def redacted_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with every span found replaced by its kind, as in <EMAIL>; n_chars, where present, follows."""
    used = ["text", "n_chars"]
    d = materialize(with_candidates(boxed(docs, used)), "pii-candidates")
    d = d.withColumn("__spans", accepted(fit(d.select("__spans"))))
    zero = F.struct(F.lit(0).cast("int").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:  # a span inside what is already replaced adds nothing
        new = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.when(s["start"] >= acc["at"], F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), new.alias("out"))

    done = F.aggregate("__spans", zero, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    d = d.withColumn("text", F.when(F.size("__spans") > 0, done).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(F.size("__spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return unboxed(d, docs, used)
