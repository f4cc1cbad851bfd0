import hashlib
import re

from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyglass.llm import pii

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain(text):
    out = []
    for kind, form in FORMS.items():
        for m in re.finditer(form, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and plain_luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def base(text):
    return [s for s in pii.find(text) if s[0] in pii.BASE]


@settings(max_examples=1500, deadline=None)
@given(st.text("01259.-+ ()@ab_%é\n", max_size=60))
@example("a@b.c@d.e x@y..z @q.r 1.2.3.4.5.6.7.8 999.1.1.1 +12 +123 +1 2345678")
@example("4111 1111-1111 1111 4111111111111111  +1 (705) 555-6638.")
@example("+1+23456789 ++4 5678 9012 ٣٤٥")
def test_base_spans_equal_the_patterns(text):
    assert base(text) == plain(text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["4111111111111111", "5500-0000-0000-0004", "10.0.0.1", "256.1.1.1", "+44 20 7946 0958", "me@site.example", ".", " ", "-", "+", "@", "x", "7"]), max_size=14))
def test_base_spans_in_dense_texts(parts):
    text = "".join(parts)
    assert base(text) == plain(text)


def test_added_kinds():
    text = 'see https://user.example/a?b=1). password=e3b3ed3cc token = "0641917e" IBAN: DE89370400440532013000, tokens are words, Account no'
    found = [(k, text[a:b]) for k, a, b in pii.find(text) if k not in pii.BASE]
    assert found == [("url", "https://user.example/a?b=1"), ("secret", "e3b3ed3cc"), ("secret", "0641917e"), ("account", "DE89370400440532013000")]


def test_long_texts_take_one_pass():
    for text in ["1" * 200_000, "a@" * 100_000, "+1 " * 60_000, "a." * 100_000 + "@", "1." * 100_000, "://" * 60_000]:
        assert isinstance(pii.find(text), list)


def test_operator(spark, documents):
    rows = [(1, "mail é a.b@c.example or +1 (705) 555-6638"), (1, "mail é a.b@c.example or +1 (705) 555-6638"), (2, None), (3, ""), (None, "10.0.0.1")]
    docs = documents(*rows).withColumn("spans", F.lit("x")).withColumn("n_ip", F.lit("y"))
    got = sorted((tuple(r) for r in pii.personal_data(docs).collect()), key=str)
    want = []
    for i, t in rows:
        spans = plain(t or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want.append((i, *(sum(k == s[0] for s in spans) for k in FORMS), hashlib.sha256(joined.encode()).hexdigest(), joined))
    assert got == sorted(want, key=str)
    assert pii.personal_data(docs.limit(0)).count() == 0


def test_against_the_patterns_on_given_texts(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r["doc_id"]: r["base_sha256"] for r in pii.personal_data(docs).collect()}
    for row in docs.select("doc_id", "text").collect():
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in plain(row["text"]))
        assert got[row["doc_id"]] == hashlib.sha256(joined.encode()).hexdigest()


def test_values_in_groups_and_behind_words_between():
    for text, kind, value in [
        ("IBAN: DE89 3704 0044 0532 0130 00 by Friday", "account", "DE89 3704 0044 0532 0130 00"),
        ("iban GB82-WEST-1234-5698-7654-32.", "account", "GB82-WEST-1234-5698-7654-32"),
        ("Iban DE89370400440532013000 2024", "account", "DE89370400440532013000"),
        ("account number: 12345678", "account", "12345678"),
        ("passport no. X1234567", "account", "X1234567"),
        ("Account No.12345678, then", "account", "12345678"),
        ("SSN 123 45 6789 and 7", "account", "123 45 6789"),
        ("acct 1234-5678 9012", "account", "1234-5678 9012"),
        ("account 123456789 2024", "account", "123456789"),
        ("password is abc123", "secret", "abc123"),
        ("api-key: k4k4k4k4", "secret", "k4k4k4k4"),
        ("ApiKey = k4k4k4k4", "secret", "k4k4k4k4"),
    ]:
        assert [(k, text[a:b]) for k, a, b in pii.find(text)] == [(kind, value)], text
    for text in ["account 12 months", "IBAN: DE89", "account number is unknown", "password is required", "account no", "IBAN DE", "account nothing1"[:15]]:
        assert pii.find(text) == [], text
    assert pii.iban_end("DE88 3704 0044 0532 0130 00", 0) == 0


def test_an_iban_needs_its_check_digits():
    """In one piece, in groups, in small letters; other accounts need no check."""
    accounts = lambda text: [text[a:b] for k, a, b in pii.find(text) if k == "account"]
    assert accounts("IBAN: DE89370400440532013000, yes") == ["DE89370400440532013000"]
    assert accounts("iban de89370400440532013000") == ["de89370400440532013000"]
    assert accounts("IBAN DE89 3704 0044 0532 0130 00") == ["DE89 3704 0044 0532 0130 00"]
    assert accounts("IBAN: DE00123456789012345678") == []
    assert accounts("IBAN DE00 1234 5678 9012 3456 78") == []
    assert accounts("IBAN: DE0012345678, account 12345678") == ["DE0012345678", "12345678"]
    assert accounts("account no. X1234567") == ["X1234567"]
