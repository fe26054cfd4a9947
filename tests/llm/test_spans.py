"""Personal data: base spans against the plain patterns, checksums, context."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from foliospark.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def valid(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d // 10 + d % 10
    return total % 10 == 0


def plain_base(text):
    """The base as its definition reads."""
    found = [("email", *m.span()) for m in EMAIL.finditer(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [("card", *m.span()) for m in CARD.finditer(text) if 14 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and valid(d)]
    found += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found, key=lambda x: (x[1], pii.BASE.index(x[0])))


def test_base_against_the_plain_patterns():
    r = random.Random(3)
    pieces = ["a", "B.c", "@", "@@", ".", "..", "x-y", "_", "%", "+", "+1", "(743) ", "555-3824", "4111 1111 1111 1111", "4111111111111111", "4222222222222222", "1.2.3.4", "300.1.1.1", "007.8.9.10", ".5.6.7.8", "1", "12", " ", "  ", "-", "\n", "é", "漢", "🙂", "0" * 20, "mail@x.de", "@y.org", "DE89370400440532013000"]
    for _ in range(6000):
        text = "".join(r.choice(pieces) for _ in range(r.randrange(0, 14)))
        assert [x[:3] for x in pii.spans(text) if x[0] in pii.BASE] == plain_base(text), text


def test_every_kind_with_its_checksum():
    right = {
        "iban": "DE89 3704 0044 0532 0130 00", "social": "1 85 05 78 006 084 91", "identity": "12345678Z", "tax": "86 095 742 719", "ssn": "123-45-6789", "birth": "1984-02-29",
    }
    near = {"iban": "bank", "social": "insee", "identity": "DNI", "tax": "Steuer-ID", "ssn": "SSN", "birth": "geboren am"}
    wrong = {"iban": "DE88 3704 0044 0532 0130 00", "social": "1 85 05 78 006 084 37", "identity": "12345678A", "tax": "86 095 742 718", "ssn": "666-45-6789", "birth": "1985-02-29"}
    number = 1850578006084
    right["social"] = f"1 85 05 78 006 084 {97 - number % 97:02d}"
    for kind, value in right.items():
        text = f"é {near[kind]}: {value}, yes"
        start = text.index(value)
        assert (kind, start, start + len(value)) in [x[:3] for x in pii.spans(text)], (kind, pii.spans(text))
        assert kind not in [x[0] for x in pii.spans(f"{near[kind]}: {wrong[kind]}, no")], kind
        assert kind not in [x[0] for x in pii.spans(f"x{value}0")]
    # weak forms need a word nearby, strong ones don't, and a word that says otherwise weighs against
    assert [x[0] for x in pii.spans(right["ssn"])] == [] and [x[0] for x in pii.spans("part " + right["iban"])] == ["iban"]
    assert pii.spans("call +1 (743) 555-3824")[0][3] > pii.spans("+1 (743) 555-3824")[0][3] > pii.spans("order +1 (743) 555-3824")[0][3]
    # what lies in a base span isn't said again
    assert [x[0] for x in pii.spans("dni mail 12345678Z@x.org")] == ["email"]


def test_dutch_and_british_accounts_and_their_edges():
    for value in ("NL91ABNA0417164300", "GB29NWBK60161331926819", "GB29 NWBK 6016 1331 9268 19"):
        assert [(x[0], x[1], x[2]) for x in pii.spans(f"to {value}.")] == [("iban", 3, 3 + len(value))]
        assert not pii.spans(value + "1") and not pii.spans("A" + value) and not pii.spans(value[:-1])


def test_long_texts_take_linear_time():
    for text in ("1" * 400_000, "a" * 400_000 + "@", "A@" * 100_000, "1-" * 200_000, "AB12 " * 80_000, "+1 " + "(" * 400_000, "1.2." * 100_000):
        began = time.perf_counter()
        pii.spans(text)
        assert time.perf_counter() - began < 8


def test_table(spark, docs, empty):
    private = [(700 + i, f"see me@x{i}.org, 10.0.0.{i}, 4111 1111 1111 1111 and +1 (743) 555-38{i:02d} " * (i % 3)) for i in range(20)]
    docs = docs.select("doc_id", "text", "source").union(spark.createDataFrame(private, "doc_id long, text string").withColumn("source", F.lit("kind")))
    rows = pii.digest_rows(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == docs.count() and pii.digest_rows(empty).count() == 0 and pii.digest_rows(empty).columns == pii.digest_rows(docs).columns
    for r in rows:
        base = plain_base(texts[r["doc_id"]] or "")
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(x[0] == k for x in base) for k in pii.BASE] and len(r["scores"]) == len(r["spans"].split(",") if r["spans"] else [])


@pytest.mark.parametrize("text,want", [("to a@b.de and 1.2.3.4.", "to [EMAIL] and [IP]."), ("", ""), (None, None), ("none", "none")])
def test_masks(spark, text, want):
    df = spark.createDataFrame([(1, text, 3, "kept")], "doc_id long, text string, n_chars long, found string")
    row = pii.masked(df).first()
    assert row["text"] == want and row["n_chars"] == (None if want is None else len(want)) and row["found"] == "kept" and pii.masked(df).columns == df.columns
