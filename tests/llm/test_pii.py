import random
import re
import time

from pyspark.sql import functions as F

from recordloom.llm.pii import BONUS, CONTEXT, KINDS, digest, luhn, mod97, redacted

from .helpers import documents, sha

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and passes(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    spans = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m[0])]
    return [sum(s[0] == k for s in spans) for k in PATTERNS], ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def iban_ok(value):
    code = value.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


MORE = {
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", iban_ok),
    "secret": (r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}", lambda v: sum(c.isdigit() for c in v) >= 4 and sum(c.isalpha() for c in v) >= 4 and not re.search(r"(.)\1{5}", v)),
}


def spans_of(text):
    """(kind, start, stop, score) of all spans, in the order of the result."""
    out = []
    tests = {k: (p, lambda v, k=k: valid(k, v)) for k, p in PATTERNS.items()} | MORE
    for kind, (pattern, test) in tests.items():
        before = 0
        for m in re.finditer(pattern, text or ""):
            near = text[max(before, m.start() - 40) : m.start()]
            score = KINDS[kind][2] + (BONUS.get(kind, 0.1) if re.search(CONTEXT[kind], near, re.A) else 0)
            if test(m[0]) and (kind in PATTERNS or score >= 0.5):
                out.append((kind, m.start(), m.end(), round(score, 2)))
            before = m.end()
    return out


def texts():
    rng = random.Random(6)
    parts = ["4111 1111 1111 1111", "4111-1111-1111-1112", "a.b+c@d-e.co.uk", "@", "x@y", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "300.1.1.1", "001.02.3.255", "+1 (555) 555-1234", "+12", "+1 2 +3 456 789 012", "é", "😀", " ", "\n", "-", "0", "1", ".", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "word", "call phone", "%", 'token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde"', "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde", "IBAN", "card", "secret"]
    return ["".join(rng.choice(parts) + rng.choice(("", " ")) for _ in range(rng.choice((1, 3, 8, 20)))) for _ in range(400)] + [None, ""]


def test_base_spans_match_brute_force(spark):
    case = texts()
    rows = digest(documents(spark, case)).orderBy("doc_id").collect()
    for text, row in zip(case, rows, strict=True):
        counts, joined = brute(text)
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == counts
        assert row.base_sha256 == sha(joined)
        found = spans_of(text)
        assert row.spans == ",".join(f"{k}:{a}:{b}" for k, a, b, _ in found) and row.scores == [s[3] for s in found]


def test_checksums_and_context(spark):
    rows = spark.createDataFrame([("4111111111111111", "GB82WEST12345698765432"), ("4111111111111112", "GB82WEST12345698765433")], "a string, b string")
    assert [tuple(r) for r in rows.select(luhn(F.col("a")), mod97(F.col("b"))).collect()] == [(True, True), (False, False)]
    near, far = digest(documents(spark, ["my IBAN: DE89370400440532013000", "x DE89370400440532013000"])).orderBy("doc_id").collect()
    assert near.pii[-1].score > far.pii[-1].score and "iban:9:31" in near.spans


def test_redaction_and_long_texts(spark):
    case = ["mail a@b.cc, then 4111 1111 1111 1111.", "none", None, "", "+4111111111111111"]
    docs = documents(spark, case).withColumn("pii", F.lit(1))
    rows = redacted(docs).orderBy("doc_id").collect()
    assert [r.text for r in rows] == ["mail [EMAIL], then [CARD].", "none", None, "", "+[CARD]"] and rows[0].pii == 1
    long = ["7" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1 " * 70_000, "1 " * 100_000]
    assert digest(documents(spark, long)).count() == 5
    assert [r.n_ip for r in digest(documents(spark, ["1.2.3.4 " * 2000])).collect()] == [2000]
    assert digest(documents(spark, [])).count() == 0 and redacted(documents(spark, [])).count() == 0


def test_work_grows_with_the_text(spark):
    """Four times the spans take less than eight times the time, beyond the time of a small text."""

    def seconds(n):
        began = time.time()
        (row,) = redacted(documents(spark, ["a@b.cc 1.2.3.4 " * n])).collect()
        assert row.text == "[EMAIL] [IP] " * n
        return time.time() - began

    fixed = min(seconds(10), seconds(10))
    assert seconds(40_000) - fixed < 8 * max(seconds(10_000) - fixed, 0.5)
