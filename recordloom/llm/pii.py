"""Personal data by DataFrame functions only: patterns propose, checksums confirm, context adjusts.

A pattern's places come from the lengths of the parts that ``split`` leaves and
of the matches that ``regexp_extract_all`` gives, both in code points, summed up
by doubling steps. Patterns use possessive repeats and look-behinds that leave
the leftmost matches as they are but keep the search linear in texts with very
long runs. Work grows with the length of a text and with n log n of its spans;
cutting a text at n spans takes sqrt(n) passes over it.

Every span has a confidence: its kind's, and more with a context word close
before it. Spans of the base kinds always count. Of the other kinds, those at or
above ADMIT do: an IBAN needs its checksum only, a secret needs a context word,
since a run of random characters alone is as often a digest or an identifier.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds in their order, with pattern, a cheap test for texts that can hold none, and a confidence.
KINDS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@", 0.9),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", 0.6),
    "card": (r"[0-9](?:[ -]?[0-9])++", r"[0-9](?:[ -]?[0-9]){12}", 0.8),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", 0.5),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", 0.9),
    "secret": (r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}+", None, 0.4),
}
BASE = ("email", "ip", "card", "phone")
CONTEXT = {
    "email": r"(?i)e-?mail|contact|write to|correo|adresse",
    "ip": r"(?i)\bip\b|address|host|server|login",
    "card": r"(?i)card|visa|master|credit|pay|karte|carte|tarjeta",
    "phone": r"(?i)phone|call|tel\b|mobile|fax|telefon|tel[eé]fono",
    "iban": r"(?i)iban|account|bank|konto|compte|cuenta",
    "secret": r"(?i)token|secret|passw|bearer|credential|[a-z][ _-]?key",
}
#: One of these is in every text with a context word of a secret, in any case.
SECRET_WORDS = ("token", "secret", "passw", "bearer", "credential", "key")
#: Code points before a span that count as its context (not beyond the match before it), what a context word adds
#: to the confidence of a kind, and the confidence from which spans of added kinds count.
NEAR, ADMIT = 40, 0.5
BONUS = {"secret": 0.4}


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    size = F.length(digits)

    def one(place: Column) -> Column:
        digit = F.substr(digits, size - place, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when(place % 2 == 1, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0), lambda total, place: total + one(place)) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an IBAN without spaces has the remainder 1."""
    turned = F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4)))

    def more(rest: Column, place: Column) -> Column:
        letter = F.ascii(F.substr(turned, place, F.lit(1)))
        return F.when(letter >= 65, (rest * 100 + letter - 55) % 97).otherwise((rest * 10 + letter - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), more) == 1


def _valid(kind: Column, value: Column) -> Column:
    """Whether a match passes the checks of its kind."""

    def numbers(digits: Column) -> Column:
        card = F.length(digits).between(13, 19) & F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
        # Both digits and letters, some of each, and no long repeat.
        secret = (F.length(digits) >= 4) & (F.length(F.regexp_replace(value, "[^A-Za-z]", "")) >= 4) & ~value.rlike(r"(.)\1{5}")
        return F.when(kind == "card", card).when(kind == "phone", F.length(digits).between(9, 15)).when(kind == "secret", secret)

    ip = F.forall(F.split(value, r"\."), lambda part: part.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    iban = _bound(F.replace(value, F.lit(" "), F.lit("")), lambda code: F.length(code).between(15, 34) & mod97(code))
    return F.when(kind == "email", True).when(kind == "ip", ip).when(kind == "iban", iban).otherwise(_bound(F.regexp_replace(value, "[^0-9]", ""), numbers))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with a value that is computed once, however often and deep in lambdas the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """The running totals of an array under an associative operation, in about log2(n) passes that double the reach."""

    def pass_(state: Column, k: Column) -> Column:
        reach = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(state, lambda x, i: F.when(i >= reach, join(x, F.get(state, i - reach))).otherwise(x))

    passes = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + F.lit(1.0))).cast("int"))
    return F.aggregate(passes, values, pass_)


_SPANS = "array<struct<kind:string,start:bigint,stop:bigint,score:double>>"


def _score(kind: Column, near: Column) -> Column:
    """The confidence of a kind, with its bonus where a context word is near."""
    score = F.lit(0.0)
    for name, (_, _, confidence) in KINDS.items():
        score = F.when(kind == name, F.lit(confidence) + F.when(near.rlike(CONTEXT[name]), BONUS.get(name, 0.1)).otherwise(0.0)).otherwise(score)
    return score


def _spans(matched: Column) -> Column:
    """Spans that count, of one struct<kind, found, parts>, in order."""

    def placed(bound: Column) -> Column:
        def span(value: Column, i: Column) -> Column:
            stop, before = F.get(bound["ends"], i), F.get(bound["parts"], i)
            near = F.when(F.length(before) > NEAR, F.right(before, F.lit(NEAR))).otherwise(before)
            score = F.when(_valid(bound["kind"], value), _score(bound["kind"], near))
            return F.struct(bound["kind"].alias("kind"), (stop - F.length(value)).alias("start"), stop.alias("stop"), score.alias("score"))

        return F.filter(F.transform(bound["found"], span), lambda s: (s["kind"].isin(*BASE) & s["score"].isNotNull()) | (s["score"] >= ADMIT))

    lengths = F.transform(matched["found"], lambda x, i: (F.length(F.get(matched["parts"], i)) + F.length(x)).cast("bigint"))
    return _bound(F.struct(matched["kind"].alias("kind"), matched["found"].alias("found"), matched["parts"].alias("parts"), _running(lengths, lambda a, b: a + b).alias("ends")), placed)


def with_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with ``pii``: array<struct<kind, start, stop, score>>, by kind as listed, then start.

    Starts count code points from 0, stops are exclusive. A null or empty text
    has none. All input columns stay; one named ``pii`` is replaced, names that
    begin with ``_pii_`` are reserved. Rows do not depend on each other.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    none = F.array().cast("array<string>")
    out = docs.drop("pii").withColumn("_pii_text", text).withColumn("_pii_low", F.lower("_pii_text"))
    words = F.array(*[F.lit(w) for w in SECRET_WORDS])
    matched = {}
    for kind, (pattern, test, _) in KINDS.items():
        can = F.col("_pii_text").rlike(test) if test else F.exists(words, lambda w: F.contains(F.col("_pii_low"), w))
        matched[f"_pii_{kind}"] = F.when(can, F.regexp_extract_all("_pii_text", F.lit(pattern), F.lit(0))).otherwise(none)
    out = out.withColumns(matched)
    parts = {k: F.when(F.size(f"_pii_{k}") > 0, F.split("_pii_text", KINDS[k][0], -1)).otherwise(none) for k in KINDS}
    all_ = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"_pii_{k}").alias("found"), parts[k].alias("parts")) for k in KINDS])
    spans = F.flatten(F.transform(F.filter(all_, lambda m: F.size(m["found"]) > 0), _spans))
    return out.withColumn("pii", spans.cast(_SPANS)).drop("_pii_text", "_pii_low", *matched)


def _redaction(text: Column, cuts: Column) -> Column:
    """The text with each cut (start, stop, kind), in order and apart, replaced by its kind in brackets.

    Cuts are taken in runs of sqrt(n); each run's part of the text is cut out first.
    """
    run = F.ceil(F.sqrt(F.size(cuts))).cast("int")

    def part(first: Column) -> Column:
        own = F.slice(cuts, first + 1, run)
        at = F.when(first > 0, F.get(cuts, first - 1)["stop"]).otherwise(F.lit(0).cast("bigint"))
        return _bound(F.struct(own.alias("own"), at.alias("at")), with_piece)

    def with_piece(bound: Column) -> Column:
        piece = F.substr(text, (bound["at"] + 1).cast("int"), (F.element_at(bound["own"], -1)["stop"] - bound["at"]).cast("int"))
        return _bound(F.struct(piece.alias("piece"), bound["own"].alias("own"), bound["at"].alias("at")), replaced)

    def replaced(bound: Column) -> Column:
        def one(cut: Column, i: Column) -> Column:
            begin = F.when(i > 0, F.get(bound["own"], i - 1)["stop"]).otherwise(bound["at"])
            return F.concat(F.substr(bound["piece"], (begin - bound["at"] + 1).cast("int"), (cut["start"] - begin).cast("int")), F.lit("["), F.upper(cut["kind"]), F.lit("]"))

        return F.array_join(F.transform(bound["own"], one), "")

    runs = F.transform(F.sequence(F.lit(0), F.size(cuts) - 1, run), part)
    return F.concat(F.array_join(runs, ""), F.substr(text, (F.element_at(cuts, -1)["stop"] + 1).cast("int")))


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with each span replaced by its kind in brackets; of overlapping spans the first names the place.

    Columns stay as they are, a null text stays null; names that begin with
    ``_pii_`` are reserved.
    """
    names = docs.columns
    kept = {"pii": "_pii_kept"} if "pii" in names else {}
    marked = with_spans(docs.withColumnsRenamed(kept), text_col)
    spans = F.array_sort(F.col("pii"), lambda a, b: F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"]).cast("int")).otherwise(F.signum(b["stop"] - a["stop"]).cast("int")))

    def with_reach(sorted_: Column) -> Column:
        return _bound(F.struct(sorted_.alias("spans"), _running(F.transform(sorted_, lambda s: s["stop"]), F.greatest).alias("reach")), with_leads)

    def with_leads(bound: Column) -> Column:
        # A span that begins before the reach of those before it is part of the cut that they make.
        leads = F.transform(bound["spans"], lambda s, i: F.when((i == 0) | (s["start"] >= F.get(bound["reach"], i - 1)), F.struct(s["start"].alias("start"), i.alias("at"), s["kind"].alias("kind"))))
        return _bound(F.struct(F.filter(leads, lambda s: s.isNotNull()).alias("leads"), bound["reach"].alias("reach")), whole)

    def whole(bound: Column) -> Column:
        def cut(lead: Column, i: Column) -> Column:
            after = F.get(bound["leads"], i + 1)["at"]
            stop = F.get(bound["reach"], F.coalesce(after, F.size(bound["reach"])) - 1)
            return F.struct(lead["start"].alias("start"), stop.alias("stop"), lead["kind"].alias("kind"))

        return _bound(F.transform(bound["leads"], cut), lambda cuts: _redaction(F.col(text_col), cuts))

    out = marked.withColumn(text_col, F.when(F.size("pii") > 0, _bound(spans, with_reach)).otherwise(F.col(text_col)))
    return out.drop("pii").withColumnsRenamed({b: a for a, b in kept.items()}).select(*names)


def joined(spans: Column) -> Column:
    """kind:start:stop of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _same(kind: str):
    return lambda s: s["kind"] == kind


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores (of the spans, in their order), pii."""
    marked = with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    counts = [F.size(F.filter("pii", _same(k))).cast("long").alias(f"n_{k}") for k in BASE]
    scores = F.transform("pii", lambda s: F.round(s["score"], 2))
    return marked.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), scores.alias("scores"), "pii")
