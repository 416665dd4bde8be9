"""Secret and personal-data scans against plain Python expressions over whole texts."""

import hashlib
import math
import random
import re
import time
from collections import Counter

from pagewright.llm.pii import AGAINST, CONTEXT_STEP, FOR, START_SCORE, find_personal_data, pii_digest
from pagewright.llm.secrets import ALLOWED, WINDOW, find_secrets, mask_secrets, secrets_digest

DATA = "/root/testdata/sf0.001"


def sha(parts):
    return hashlib.sha256(",".join(parts).encode()).hexdigest()


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def n_digits(m):
    return len(re.sub("[^0-9]", "", m))


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= n_digits(m) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= n_digits(m) <= 15),
}
ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_pii(text):
    found = {k: [m.span() for m in re.finditer(p, text or "") if ok(m[0])] for k, (p, ok) in PII.items()}
    return tuple(len(v) for v in found.values()), sha([f"{k}:{s}:{e}" for k, v in found.items() for s, e in v])


def brute_secrets(text):
    t = text or ""
    found = {
        "assign": [m.span() for m in ASSIGN.finditer(t) if len(m[2]) >= 12],
        "access": [m.span() for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18],
        "hex": [m.span() for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16],
    }
    rank = list(found)
    flat = sorted((s, rank.index(k), e, k) for k, v in found.items() for s, e in v)
    return tuple(len(v) for v in found.values()), sha([f"{k}:{s}:{e}" for s, _, e, k in flat])


def hard_texts():
    rng = random.Random(7)
    bits = ["a@b.co", "x.y+z@mail.example.org", "@", "_", ".", " ", "-", "--", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (555) 123-4567", "+49", "12", "7", "é", "😀", "\n",
            "token=", "API_KEY: '", "apikey", "passwd =", "secret:", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "q9Z", "/", "=", '"', "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "Secret", "999999999999"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(600)]
    return [*texts, None, "", "9" * 20_000, "1 " * 20_000, "a" * 15_000, "a@b" + ".c" * 20_000, "+1" + " 2" * 9_000, "deadbeef" * 9_000, "token=" * 5_000, "1.2.3." * 5_000, "a.b@" * 5_000]


def frame(spark):
    own = spark.createDataFrame([(i, t, "x") for i, t in enumerate(hard_texts())], "doc_id long, text string, spans string")
    given = spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("doc_id + 100000 doc_id", "text", "source spans")
    return own.union(given)


def test_personal_data_equals_plain_expressions(spark):
    df = frame(spark)
    texts = {r.doc_id: r.text for r in df.collect()}
    rows = pii_digest(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert ((r.n_email, r.n_ip, r.n_card, r.n_phone), r.base_sha256) == brute_pii(texts[r.doc_id]), texts[r.doc_id][:200]


def test_secrets_equal_plain_expressions(spark):
    df = frame(spark)
    texts = {r.doc_id: r.text for r in df.collect()}
    rows = secrets_digest(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert ((r.n_assign, r.n_access, r.n_hex), r.base_sha256) == brute_secrets(texts[r.doc_id]), texts[r.doc_id][:200]


def test_validators_and_context(spark):
    df = spark.createDataFrame([(1, "my IBAN: DE89370400440532013000 ok"), (2, "iban DE89370400440532013001"), (3, "card 4111111111111111"), (4, "order 4111111111111111")], "doc_id long, text string")
    got = {r.doc_id: [(x.kind, round(x.score, 1)) for x in r.pii] for r in find_personal_data(df).collect()}
    assert got == {1: [("iban", 0.8)], 2: [], 3: [("card", 0.9)], 4: [("card", 0.5)]}


def test_context_decides(spark):
    """The same loose span stays or goes by the words on either side, as whole words only."""
    de = "DE89370400440532013000"
    rows = [
        ("call 030 1234 5678 today", ["local_phone"]), ("030 1234 5678 is my phone", ["local_phone"]), ("code 030 1234 5678 today", []), ("hotel 030 1234 5678 today", []), ("phone order 030 1234 5678", []),
        ("SSN 123-45-6789", ["national_id"]), ("ssn 000-45-6789", []), ("part 123-45-6789", []), ("born 1980-02-28 in", ["birth"]), ("on 1980-02-28 in", []), ("born 1980-13-28", []), ("28.02.1980 (birthday)", ["birth"]),
        (f"model {de}", []), (f"iban model {de}", ["iban"]), (f"{de} here", ["iban"]), (f"{de} is a sku", []), ("script 10.0.0.1", ["ip"]),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.pii for r in find_personal_data(df).collect()}
    assert {i: [x.kind for x in v] for i, v in got.items()} == {i: k for i, (_, k) in enumerate(rows)}
    assert round(got[16][0].score, 1) == 0.6  # "script" is no word for an address


def brute_scores(text, spans):
    out = []
    for kind, s, e in spans:
        near = f"{text[max(0, s - 48) : s]} \n {text[e : e + 48]}".lower()
        said = lambda words: re.search(rf"(?<!\w)(?:{words})(?!\w)", near) is not None  # noqa: E731, B023
        score = START_SCORE[kind] + CONTEXT_STEP * (said(FOR[kind]) - said(AGAINST[kind]))
        out.append(f"{min(1, max(0, score)) + 1e-9:.1f}")
    return ",".join(out)


def test_scores_equal_plain_python(spark):
    rng = random.Random(3)
    words = ["phone", "Tel", "hotel", "card", "visa", "order", "serial", "mail", "example", "ip", "version", "and", "né", "born", "ssn", "part", "call", "x"]
    spans = ["a@b.co", "1.2.3.4", "4111 1111 1111 1111", "+49 30 1234567", "030 1234 5678", "123-45-6789", "1980-02-28", "q@r.st.uv"]
    texts = ["".join(rng.choice([*words, *spans]) + rng.choice([" ", ", ", "; ", " \n", ": "]) for _ in range(rng.randint(1, 25))) for _ in range(400)]
    texts += ["phone +1 2,+1 2345678,+2 2345678;+3 2345678 fax", "a@b.co " * 30 + "mail"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in find_personal_data(df).collect():
        t = texts[r.doc_id]
        assert all(t[x.s : x.e] == x.m for x in r.pii)
        assert ",".join(f"{x.score + 1e-9:.1f}" for x in r.pii) == brute_scores(t, [(x.kind, x.s, x.e) for x in r.pii]), t


def brute_entropy(text):
    """Hot stretches of all candidates, window by window, that overlap no base span and no placeholder."""
    t = text or ""
    base = [m.span() for m in ASSIGN.finditer(t) if len(m[2]) >= 12] + [m.span() for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18] + [m.span() for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    out = []
    for c in re.finditer("[A-Za-z0-9+/_=-]+", t):
        m = c[0]
        if len(m) < WINDOW or len(re.findall("[0-9]", m)) < 2 or re.search(ALLOWED.replace("(?i)", "").replace("++", "+").replace("*+", "*"), m, re.I | re.A):
            continue
        limit = 3.0 if re.fullmatch("[0-9a-fA-F]+", m) else 3.5 if re.fullmatch("[a-z0-9_=-]+", m) else 3.7
        merged = []
        for i in range(len(m) - WINDOW + 1):
            w = m[i : i + WINDOW]
            bits = -sum(n / WINDOW * math.log2(n / WINDOW) for n in Counter(w).values())
            if bits >= limit - 1e-9 and sum(x.isdigit() for x in w) >= 2 and sum(x.isalpha() for x in w) >= 4:
                if merged and i <= merged[-1][1]:
                    merged[-1][1] = i + WINDOW
                else:
                    merged.append([i, i + WINDOW])
        for s, e in merged:
            if not re.search("example|placeholder|dummy|changeme|xxxx|abcdef|0123456|1234567", m[max(0, s - WINDOW) : e + WINDOW], re.I):
                if all(y <= c.start() + s or x >= c.start() + e for x, y in base):
                    out.append((c.start() + s, c.start() + e))
    return out


def test_entropy_spans_equal_plain_python(spark):
    rng = random.Random(9)
    chars = "ABCDEFGHijklmnopqrstuvwxyz0123456789+/_=-"
    run = lambda k, n: "".join(rng.choice(chars[:k] if k > 0 else chars[k:]) for _ in range(n))
    bits = [lambda: run(40, rng.randint(10, 60)), lambda: run(-16, 40), lambda: run(5, 30), lambda: "deadbeef" * rng.randint(1, 4), lambda: "aaaa" * 9, lambda: " ", lambda: "example", lambda: "é", lambda: "token=", lambda: "some-words_here", lambda: "123e4567-e89b-12d3-a456-426614174000"]
    texts = ["".join(rng.choice(bits)() for _ in range(rng.randint(1, 12))) for _ in range(500)]
    texts += [run(40, 900), run(40, 300) + "=" * 300 + run(40, 5000), None, "A1b2" * 200]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = 0
    for r in find_secrets(df).collect():
        got = [(x.s, x.e) for x in r.secrets if x.kind == "entropy"]
        found += len(got)
        assert got == brute_entropy(texts[r.doc_id]), texts[r.doc_id]
    assert found > 100


def test_long_runs_and_many_matches(spark):
    """A quarter of a megabyte of one candidate, and forty thousand matches in one text."""
    rng = random.Random(1)
    blob = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=1 << 18))
    mails = "".join(f"u{i}@mail.example.org, " for i in range(40_000))
    began = time.time()
    r = find_secrets(spark.createDataFrame([(1, f"see {blob} end")], "doc_id long, text string")).first()
    assert len(r.secrets) > 30 and max(x.e - x.s for x in r.secrets) > 2000
    r = pii_digest(spark.createDataFrame([(1, mails)], "doc_id long, text string")).first()
    assert r.n_email == 40_000
    assert time.time() - began < 60


def test_masks_of_overlapping_spans(spark):
    key = "token=" + "deadbeef" * 3
    rows = [(1, f"é😀 {key} and {'0123abcd' * 2}"), (2, "plain"), (3, f"{key}"), (4, f"a {key}, {key}")]
    got = {r.doc_id: r.text for r in mask_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "é😀 [SECRET] and [SECRET]", 2: "plain", 3: "[SECRET]", 4: "a [SECRET], [SECRET]"}


def test_entropy_spans_and_allow_list(spark):
    key = "Xk9vQ2mB7Lr4TzWn8sJc3HfP"
    rows = [(1, f"see {key} here"), (2, "id 123e4567-e89b-12d3-a456-426614174000"), (3, "thandnessesinghereattionble"), (4, f"token={key}"), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(x.kind, x.s, x.e) for x in r.secrets] for r in find_secrets(df).collect()}
    assert got == {1: [("entropy", 4, 28)], 2: [], 3: [], 4: [("assign", 0, 30)], 5: []}
    masked = {r.doc_id: r.text for r in mask_secrets(df).collect()}
    assert masked == {1: "see [SECRET] here", 2: rows[1][1], 3: rows[2][1], 4: "[SECRET]", 5: None}


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, kind string, pos int, m string")
    assert pii_digest(df).count() == 0 and secrets_digest(df).count() == 0 and mask_secrets(df).count() == 0


def test_account_numbers_before_further_words(spark):
    de, gb = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"
    rows = [(f"IBAN {de} BIC COBADEFFXXX", [de]), ("DE89370400440532013000 2024", ["DE89370400440532013000"]), (f"{de} {gb}", [de, gb]), (f"AB12 3456 7890 {gb} EUR", [gb]), (f"({gb}) or {de}, NO9386011117947 PAID 7", [gb, de, "NO9386011117947"]), ("DE89 3704 0044 0532 0130 01 BIC", [])]
    # A longer part of this one passes mod 97 too; the country's length decides.
    more = next(f"{i:03}" for i in range(1000) if int(f"370400440532013000{i:03}131489") % 97 == 1)
    rows.append((f"{de} {more}", [de]))
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: [(x.s, x.e, x.m) for x in r.pii if x.kind == "iban"] for r in find_personal_data(df).collect()}
    assert got == {i: [(t.index(m), t.index(m) + len(m), m) for m in found] for i, (t, found) in enumerate(rows)}


def test_context_reaches_over_earlier_spans(spark):
    df = spark.createDataFrame([(1, "phone +49 30 1234567, +49 30 7654321")], "doc_id long, text string")
    assert [round(x.score, 1) for x in find_personal_data(df).first().pii] == [0.8, 0.8]
