"""Personal data: patterns propose, checksums confirm, context words adjust the score.

Plain patterns propose spans of four base kinds (e-mail, IPv4, payment card, phone), which stay whatever their score is.
Further kinds are proposed by their form and confirmed by their validator:

* ``iban``: the country's length and ISO 7064 mod 97;
* ``social``: French social security numbers, key 97 minus the rest modulo 97;
* ``tax``: German tax ids, ISO 7064 mod 11,10, some digit twice or thrice among the first ten;
* ``identity``: Spanish identity numbers, check letter modulo 23;
* ``ssn``: US social security numbers, which have no check digit, only forbidden groups;
* ``birth``: dates of the calendar.

Every span has a score: its kind's prior, raised by a word nearby that names the kind and lowered by one that names
something else (an invoice, a version). A span of a further kind is reported from ``least`` on, so a form without a strong
check needs a context word. Positions are code points of the whole text; a null text is empty and has no spans.
"""

from __future__ import annotations

import datetime
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "social", "tax", "identity", "ssn", "birth")

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
#: A number's first digit comes first in each pattern, so that the engine can look for digits, and what stands before it is looked at afterwards.
FIRST = "(?<![0-9][0-9])"
ADDRESS = re.compile(rf"[0-9]{FIRST}[0-9]*+(?:\.[0-9]++){{3}}")
CARD = re.compile(rf"[0-9]{FIRST}(?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"[A-Z](?<![A-Za-z0-9].)[A-Z][0-9]{2}(?=\x20?[A-Z0-9])")
SOCIAL = re.compile(r"[12](?<![0-9].)(\x20?)[0-9]{2}\1[0-9]{2}\1(?:[0-9]{2}|2[AB])\1[0-9]{3}\1[0-9]{3}\1[0-9]{2}(?![0-9])")
TAX = re.compile(r"[1-9](?<![0-9].)[0-9](\x20?)[0-9]{3}\1[0-9]{3}\1[0-9]{3}(?![0-9])")
IDENTITY = re.compile(r"[0-9XYZ](?<![A-Za-z0-9].)[0-9]{7}-?[A-Z](?![A-Za-z0-9])")
SSN = re.compile(r"[0-8](?<![0-9-].)[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-])")
DATE = re.compile(r"[0-9](?<![0-9./-].)(?:[0-9]{3}-[0-9]{2}-[0-9]{2}|[0-9]?([./])[0-9]{1,2}\1[0-9]{4})(?![0-9])")
DIGITS = re.compile("[0-9]+")

# Lengths of IBANs by country, the letters of Spanish identity numbers, and context words in the languages at hand.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
IDENTITY_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
CONTEXT = {
    "email": "email mail e-mail correo courriel contact contacto kontakt",
    "ip": "ip address host server client login adresse dirección serveur",
    "card": "card visa mastercard amex credit debit payment karte kreditkarte carte tarjeta",
    "phone": "phone tel call mobile fax telefon téléphone teléfono handy móvil",
    "iban": "iban bank account konto compte cuenta banque banco",
    "social": "sécurité sociale nir insee secu",
    "tax": "steuer steuer-id steuernummer identifikationsnummer tin idnr",
    "identity": "dni nie nif documento identidad",
    "ssn": "ssn social security",
    "birth": "born birth birthday dob geboren geburtsdatum né née naissance nacido nacida nacimiento",
}
AGAINST = frozenset("invoice order version build release isbn issn sku serial ticket part rechnung bestellung facture commande factura pedido".split())
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.8, "social": 0.6, "tax": 0.3, "identity": 0.3, "ssn": 0.3, "birth": 0.2}
# End of the fixed values.

WORDS = {kind: frozenset(words.split()) for kind, words in CONTEXT.items()}
WORD = re.compile(r"[^\W_]+(?:-[^\W_]+)*")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    for d in map(int, digits[-2::-2]):
        total += 2 * d - 9 * (d > 4)
    return total % 10 == 0


def mod97(text: str) -> int:
    """ISO 7064 mod 97,10 of digits and capital letters, A being 10."""
    return int("".join(str(int(c, 36)) for c in text)) % 97


def iso_11_10(digits: str) -> bool:
    product = 10
    for d in map(int, digits[:-1]):
        product = ((d + product) % 10 or 10) * 2 % 11
    return (11 - product) % 10 == int(digits[-1])


def small_parts(address: str) -> bool:
    return all(len(part := p.lstrip("0")) < 4 and int(part or 0) <= 255 for p in address.split("."))


def is_card(found: str) -> bool:
    digits = found.replace(" ", "").replace("-", "")
    return 14 <= len(digits) <= 19 and luhn(digits)


def is_phone(found: str) -> bool:
    return 10 <= sum(map(len, DIGITS.findall(found))) <= 15


def is_social(found: str) -> bool:
    plain = found.replace(" ", "")
    month = int(plain[3:5])
    # Corsica's departments count as 19 and 18
    number = int(plain[:13].replace("2A", "19").replace("2B", "18"))
    return (1 <= month <= 12 or 20 <= month) and number % 97 + int(plain[13:]) == 97


def is_tax(found: str) -> bool:
    plain = found.replace(" ", "")
    most = max(plain[:10].count(d) for d in set(plain[:10]))
    return 2 <= most <= 3 and iso_11_10(plain)


def is_identity(found: str) -> bool:
    plain = found.replace("-", "")
    number = str("XYZ".find(plain[0])) + plain[1:8] if plain[0] in "XYZ" else plain[:8]
    return IDENTITY_LETTERS[int(number) % 23] == plain[-1]


def is_ssn(found: str) -> bool:
    area, group, serial = found.split("-")
    return area not in ("000", "666") and group != "00" and serial != "0000"


def is_date(found: str) -> bool:
    parts = re.split("[./-]", found)
    year, month, day = map(int, parts if len(parts[0]) == 4 else parts[::-1])
    for a, b in ((month, day), (day, month)):
        try:
            datetime.date(year, a, b)
        except ValueError:
            continue
        return year >= 1900
    return False


def emails(text: str):
    """(start, end) of the addresses: a domain is looked for at each @ and the name before it back to the last address, which makes one pass."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(LOCAL))
        end = at + 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            end = done = domain.end()
            yield start, end
        else:
            done = at + 1
        at = text.find("@", end)


def ibans(text: str):
    for m in IBAN.finditer(text):
        if size := IBAN_LENGTH.get(text[m.start() : m.start() + 2]):
            end, left = m.end(), size - 4
            while left and end < len(text):
                end += text[end] == " "
                if not ("0" <= text[end : end + 1] <= "9" or "A" <= text[end : end + 1] <= "Z"):
                    break
                end, left = end + 1, left - 1
            plain = text[m.start() : end].replace(" ", "")
            if not left and not text[end : end + 1].isalnum() and mod97(plain[4:] + plain[:4]) == 1:
                yield m.start(), end


def score(text: str, kind: str, start: int, end: int, *, reach: int, step: float) -> float:
    """The kind's prior, raised by ``step`` where a word of the kind's lies within ``reach`` characters, lowered where one of something else does."""
    near = set(WORD.findall(text[max(0, start - reach) : start].lower())) | set(WORD.findall(text[end : end + reach].lower()))
    moved = PRIOR[kind] + step * bool(near & WORDS[kind]) - step * bool(near & AGAINST)
    return round(min(1.0, max(0.0, moved)), 3)


def spans(text: str, *, least=0.5, reach=48, step=0.3) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind. Work is linear in the text."""
    base = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    base += [("ip", m.start(), m.end()) for m in ADDRESS.finditer(text) if small_parts(m[0])]
    base += [("card", m.start(), m.end()) for m in CARD.finditer(text) if is_card(m[0])]
    base += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if is_phone(m[0])] if "+" in text else []
    more = [("iban", a, b) for a, b in ibans(text)]
    for kind, form, right in (("social", SOCIAL, is_social), ("tax", TAX, is_tax), ("identity", IDENTITY, is_identity), ("ssn", SSN, is_ssn), ("birth", DATE, is_date)):
        more += [(kind, m.start(), m.end()) for m in form.finditer(text) if right(m[0])]
    if not base and not more:
        return []
    found = [(*x, score(text, *x, reach=reach, step=step)) for x in base]
    # both lists ascend: a further span that lies in a base span says nothing new
    taken, at, reached = sorted((a, b) for _, a, b in base), 0, 0
    for kind, a, b in sorted(more, key=lambda x: x[1]):
        while at < len(taken) and taken[at][0] <= a:
            reached = max(reached, taken[at][1])
            at += 1
        if b > reached and (value := score(text, kind, a, b, reach=reach, step=step)) >= least:
            found.append((kind, a, b, value))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan(docs: DataFrame, *, doc_id="doc_id", text="text", **options) -> DataFrame:
    """doc_id and ``found``, the spans of every text as structs (kind, start, end, score). ``least``: the score from which further kinds count; ``reach``: characters on either side that are context; ``step``: what a context word weighs.

    A null or empty text has no spans; null ids pass; repeated rows are rows of their own with equal spans; an empty table
    gives no rows. Texts are read whole in time linear in their length, and columns that clash with names used here are
    ignored. Spans of one kind don't overlap, those of different kinds may."""

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = [[dict(zip(("kind", "start", "end", "score"), x)) for x in spans(t.as_py() or "", **options)] for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "found"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, "doc_id long, found array<struct<kind:string,start:long,end:long,score:double>>")


def digest_rows(docs: DataFrame, **options) -> DataFrame:
    """Counts of the base kinds, the spans as text and the scores; see ``scan`` for nulls, repeats, empty tables and long texts."""
    found = scan(docs, **options)

    def line(of):
        return F.array_join(F.transform(of, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def number(kind):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *map(number, BASE), F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("found")).alias("spans"), F.transform("found", lambda x: x["score"]).alias("scores"))


def masked(docs: DataFrame, *, text="text", n_chars="n_chars", mask="[{}]", **options) -> DataFrame:
    """The same rows and columns; each span (overlapping ones as one, named by the first) is replaced by ``mask`` with its kind in capitals. n_chars follows; a null text stays null."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text):
                out = []
                for value in batch.column(batch.schema.get_field_index(text)):
                    value = value.as_py()
                    parts, end = [], 0
                    for kind, a, b, _ in spans(value or "", **options):
                        if a >= end:
                            parts += [value[end:a], mask.format(kind.upper())]
                        end = max(end, b)
                    out.append("".join(parts) + value[end:] if parts else value)
                columns = list(batch.columns)
                columns[batch.schema.get_field_index(text)] = pa.array(out, pa.string())
                if (i := batch.schema.get_field_index(n_chars)) >= 0:
                    columns[i] = pa.array([None if v is None else len(v) for v in out], batch.schema.field(i).type)
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
