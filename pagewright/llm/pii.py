"""Personal data: patterns propose spans, checksums confirm them, nearby context words adjust a score.

A confirmed span starts at its kind's score; whole words for or against the kind within 48 characters on either side
move it. The base kinds (email, ip, card, phone) are always kept, and carry their score. Account numbers and the loose
kinds (telephone numbers without a country, national identity numbers, dates of birth) are kept from ``MIN_SCORE``:
the former unless context speaks against them, the latter only where it speaks for them.

Built-in functions only, one narrow projection over the documents, no shuffle. Work is linear in the text.

Null text counts as empty and gives no spans; rows are independent, so ties, repeated rows, empty tables and
further columns change nothing. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import in_steps, let, text_or_empty
from pagewright.llm.spans import SPANS, count_kind, find_spans, joined, running

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "iban", "local_phone", "national_id", "birth"]

# The proposing patterns. Possessive loops run without recursion, so long inputs are safe.
LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# A run of digits with single separators; the bounds are those of the digit count, tested on the whole run.
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
# The head of an account number, and ahead of it the longest rest that ends with a word; heads inside a rest are proposed too.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9]))"
IBAN_LEAST = 15
# Countries with the length of their account numbers.
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 "
    "GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 "
    "MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 "
    "TN24 TR26 UA29 VA22 VG24 XK20 YE30"
)

# A number in groups without a country, a nine-digit identity number in groups of 3, 2 and 4, a date.
LOCAL_PHONE = r"(?<![0-9+.-])(?<![0-9+] )(?:\([0-9]{2,5}\) ?|0[0-9]{1,4}[ /.-]|[0-9]{3}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,5}(?![0-9.-]*[0-9])"
NATIONAL_ID = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
NATIONAL_ID_OK = r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"
BIRTH = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})(?![0-9/-])"
BIRTH_OK = r"^(?:(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])[./](?:0?[1-9]|[12][0-9]|3[01])[./](?:19|20)[0-9]{2})$"

#: Score of a span whose pattern and validator agree, before context; what one side's words add or take; least score.
START_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.6, "local_phone": 0.3, "national_id": 0.4, "birth": 0.3}
CONTEXT_STEP = 0.2
MIN_SCORE = 0.5
# Whole words near a span that speak for or against its kind, in lower case.
FOR = {
    "email": "e-?mail|mail|contact|correo|courriel",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|mastercard|credit|payment|tarjeta|carte|karte",
    "phone": "phone|telephone|tel|call|mobile|fax|contact",
    "iban": "iban|account|bank|konto|cuenta|compte",
    "local_phone": "phone|telephone|tel|call|mobile|fax|telefon|teléfono|téléphone",
    "national_id": "ssn|social security|tax id|national id",
    "birth": "born|birth|birthday|dob|geboren|nacido|nacida|née|né",
}
AGAINST = {
    "email": "example|noreply",
    "ip": "version|release|section",
    "card": "order|serial|isbn|tracking",
    "phone": "order|serial|isbn|tracking",
    "iban": "serial|model|sku|example",
    "local_phone": "order|serial|isbn|tracking|invoice",
    "national_id": "order|serial|part|model|sku",
    "birth": "published|released|version|deadline",
}


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn_ok(m: Column) -> Column:
    """Luhn checksum over the digits of ``m``."""
    rev = F.reverse(digits(m))

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(rev, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return (acc + F.when(d > 9, d - 9).otherwise(d)).cast("int")

    return F.aggregate(F.sequence(F.lit(1), F.length(rev)), F.lit(0), add) % 10 == 0


def packed(m: Column) -> Column:
    return F.regexp_replace(m, " ", "")


def mod97_ok(m: Column) -> Column:
    """ISO 7064 mod 97-10: first four characters moved to the end, letters as 10 to 35, remainder 1."""
    turned = F.concat(F.substring(packed(m), 5, 64), F.substring(packed(m), 1, 4))

    def add(acc: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code < 58, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97).cast("int")

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def account_numbers(spans: Column) -> Column:
    """Each proposal cut to a part that ends with a word and passes mod 97: the one as long as its country's numbers are,
    else the longest. Proposals without one go, and those that start inside the last one kept."""

    def cut(x: Column) -> Column:
        m = x["m"]

        def fits(n: Column) -> Column:
            part = F.substring(m, F.lit(1), n)
            at_end = (F.substring(m, n, F.lit(1)) != " ") & F.substring(m, n + 1, F.lit(1)).isin(" ", "")
            return at_end & (F.length(packed(part)) >= IBAN_LEAST) & mod97_ok(part)

        def registered(n: Column) -> Column:
            length = F.length(packed(F.substring(m, F.lit(1), n)))
            return F.lit(IBAN_LENGTHS).contains(F.concat(F.substring(m, 1, 2), length.cast("string")))

        ends = F.filter(F.sequence(F.lit(IBAN_LEAST), F.length(m)), fits)
        n = let(ends, lambda e: F.coalesce(F.array_max(F.filter(e, registered)), F.array_max(e)))
        return let(n, lambda n: F.struct(x["kind"], x["s"], (x["s"] + n).alias("e"), F.substring(m, F.lit(1), n).alias("m"), x["before"], x["after"]))

    passed = F.filter(F.transform(spans, cut), lambda x: x["e"].isNotNull()).cast(SPANS)
    # A span that starts inside an earlier one goes, also where that one goes itself.
    apart = lambda p: let(running(F.transform(p, lambda x: x["e"]), F.lit(0), lambda a, b: F.greatest(a, b)), lambda r: F.filter(p, lambda x, i: (i == 0) | (x["s"] >= r[F.greatest(i - 1, F.lit(0))])))
    return let(passed, apart)


def near(x: Column, words: str) -> Column:
    """Whether one of ``words`` stands as a whole word before or after the span."""
    return F.lower(F.concat_ws(" \n ", x["before"], x["after"])).rlike(rf"(?U)(?<![\w])(?:{words})(?![\w])")


def score(x: Column) -> Column:
    """Validated spans start at their kind's score; context words for or against it move that."""
    out = F.lit(0.0)
    for k in KINDS:
        s = F.lit(START_SCORE[k]) + F.when(near(x, FOR[k]), CONTEXT_STEP).otherwise(0.0) - F.when(near(x, AGAINST[k]), CONTEXT_STEP).otherwise(0.0)
        out = F.when(x["kind"] == k, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)), 3)).otherwise(out)
    return out


def find_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``pii``: spans (kind, s, e, m, before, after, score) by kind, then start. All columns of ``docs`` stay, but for one of that name."""
    t = text_or_empty(text)

    def length_between(lo: int, hi: int):
        return lambda x: F.length(digits(x["m"])).between(lo, hi)

    steps = {
        # Conditions for most kinds, each tested once a text: all but addresses of mail and numbers after a plus need two digits.
        "digit": lambda c: t.rlike("[0-9][ .-]?[0-9]"),
        "dashed": lambda c: c("digit") & t.rlike("[0-9][./-][0-9]"),
        "email": lambda c: find_spans(t, "email", EMAIL, t.contains("@"), context=True),
        "ip": lambda c: F.filter(find_spans(t, "ip", IP, c("dashed"), context=True), lambda x: x["m"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")),
        "card": lambda c: F.filter(find_spans(t, "card", CARD, c("digit"), context=True), lambda x: luhn_ok(x["m"])),
        "phone": lambda c: F.filter(find_spans(t, "phone", PHONE, t.contains("+"), context=True), length_between(9, 15)),
        "iban_head": lambda c: find_spans(t, "iban", IBAN, c("digit"), ahead=True, context=True),
        "iban": lambda c: account_numbers(c("iban_head")),
        "local_phone": lambda c: F.filter(find_spans(t, "local_phone", LOCAL_PHONE, c("digit"), context=True), length_between(7, 12)),
        "national_id": lambda c: F.filter(find_spans(t, "national_id", NATIONAL_ID, c("dashed"), context=True), lambda x: x["m"].rlike(NATIONAL_ID_OK)),
        "birth": lambda c: F.filter(find_spans(t, "birth", BIRTH, c("dashed"), context=True), lambda x: x["m"].rlike(BIRTH_OK)),
        "all": lambda c: F.concat(*[c(k) for k in KINDS]).cast(SPANS),
        "scored": lambda c: F.transform(c("all"), lambda x: F.struct(x["kind"], x["s"], x["e"], x["m"], x["before"], x["after"], score(x).alias("score"))),
        "kept": lambda c: F.filter(c("scored"), lambda x: x["kind"].isin(BASE_KINDS) | (x["score"] >= MIN_SCORE)),
    }
    return in_steps(docs, steps, "pii")


def pii_digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the four base kinds, digest of base spans, all spans with their scores."""
    found = find_personal_data(docs.select("doc_id", "text")).select("doc_id", "pii")
    base = F.filter("pii", lambda x: x["kind"].isin(BASE_KINDS))
    count = [count_kind("pii", k) for k in KINDS]
    return found.select(
        "doc_id",
        *count[:4],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("pii")).alias("spans"),
        *count[4:],
        F.array_join(F.transform("pii", lambda x: F.format_string("%.1f", x["score"])), ",").alias("scores"),
    )
