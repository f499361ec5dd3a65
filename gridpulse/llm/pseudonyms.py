"""Format-preserving pseudonyms for personal numbers and dates.

A found value is taken apart into its format (separators, prefixes, check digits) and a number below the count of values of that format; a
keyed Feistel permutation of that range gives the pseudonym's number, which is written in the same format. It is a permutation, so equal values
get equal pseudonyms in every document, different values different ones, and the key's owner can go back. What carries a check
(card numbers, IBANs, dates, IPv4 addresses) is validated first and its pseudonym is valid, too.
"""
from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import run_folder

ROUNDS = 10
FIRST_DAY, LAST_DAY = datetime.date(1800, 1, 1).toordinal(), datetime.date(2199, 12, 31).toordinal()
#: Key of the tests and of the registered query; a deployment passes its own.
TEST_KEY = b"pseudonym test key"

FOUND = re.compile(r"""
  (?P<email>(?<![\w.%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)
| (?P<secret>(?<![0-9A-Za-z])(?:(?=[a-f]*[0-9])[0-9a-f]{32,128}|(?=[A-F]*[0-9])[0-9A-F]{32,128}|(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,64})(?![0-9A-Za-z]))
| (?P<iban>(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?:\ ?[A-Z0-9]{4}){2,7}(?:\ ?[A-Z0-9]{1,3})?(?![0-9A-Za-z]))
| (?P<date>(?<![\d/.-])(?:\d{4}(?P<s>[-/.])\d{2}(?P=s)\d{2}|\d{1,2}(?P<r>[-/.])\d{1,2}(?P=r)\d{4})(?![\d/-]|\.\d))
| (?P<ip>(?<![\d.])(?<!\bv)(?<!\bV)(?<!ersion\ )\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d))
| (?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))
| (?P<card>(?<!\d)(?:\d{13,19}|\d{4}(?P<c>[ -])\d{4}(?P=c)\d{4}(?P=c)\d{1,7}|\d{4}(?P<a>[ -])\d{6}(?P=a)\d{5})(?!\d))
| (?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}(?:[ .-]?\d{2,4}){1,2}(?!\d)|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\d.-])\d{3}(?P<q>[.-])\d{3}(?P=q)\d{4}(?!-?\d|\.\d))
""", re.X | re.A)
#: Letters and digits of an IBAN by country.
IBAN_LENGTHS = {x[:2]: int(x[2:]) for x in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 "
    "IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 "
    "SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30").split()}
#: A text without any of these has nothing to find: each kind holds a digit or an @, but for secrets, which may be letters behind their lead.
MAY_HOLD = re.compile(r"\d|@|AKIA|ASIA|gh[pousr]_|sk-")


def permute(value: int, size: int, key: bytes, kind: str, back: bool = False) -> int:
    """Keyed permutation of range(size): a Feistel network over two halves, walked until the result is in range."""
    if size < 2:
        return value
    half = math.isqrt(size - 1) + 1  # half * half >= size

    def round_value(i: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{kind}|{size}|{i}|{x}".encode(), key=key[:64], digest_size=32).digest(), "big") % half

    while True:
        left, right = divmod(value, half)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            left, right = ((right - round_value(i, left)) % half, left) if back else (right, (left + round_value(i, right)) % half)
        value = left * half + right
        if value < size:
            return value


LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def permute_chars(text: str, alphabets: list[str | None], key: bytes, kind: str, back: bool = False) -> str:
    """Each character stays within its alphabet (None: as it is); all of them together are one permuted number."""
    value, size = 0, 1
    for c, a in zip(text, alphabets):
        if a:
            value, size = value * len(a) + a.index(c), size * len(a)
    shape = "".join("." if a is None else "adxX"[(LOWER, DIGITS, "0123456789abcdef", "0123456789ABCDEF").index(a)] if a != UPPER else "A" for a in alphabets)
    value, out = permute(value, size, key, f"{kind}|{shape}", back), []
    for c, a in zip(reversed(text), reversed(alphabets)):
        if a:
            value, i = divmod(value, len(a))
            c = a[i]
        out.append(c)
    return "".join(reversed(out))


def by_class(text: str) -> list[str | None]:
    return [LOWER if c in LOWER else UPPER if c in UPPER else DIGITS if c in DIGITS else None for c in text]


def _refill(text: str, chars: str) -> str:
    """The letters and digits of ``text`` replaced in order; what stands between stays."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in text)


def luhn(digits: str) -> int:
    """Check digit that makes ``digits`` + it a valid number."""
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return -total % 10


def _card(text, key, back):
    digits = re.sub(r"\D", "", text)
    if luhn(digits[:-1]) != int(digits[-1]):
        return None
    body = f"{permute(int(digits[:-1]), 10 ** (len(digits) - 1), key, 'card', back):0{len(digits) - 1}d}"
    return _refill(text, body + str(luhn(body)))


def _iban(text, key, back):
    plain = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = permute_chars(plain[4:], by_class(plain[4:]), key, "iban" + plain[:2], back)
    return _refill(text, f"{plain[:2]}{98 - number(body + plain[:2] + '00') % 97:02d}{body}")


def _date(text, key, back):
    parts = re.split(r"[-/.]", text)
    mark = text[len(parts[0])]
    year_first = len(parts[0]) == 4
    numbers = [int(p) for p in (parts if year_first else reversed(parts))]
    month_first = not year_first and numbers[1] > 12 >= numbers[2]  # 12/31/2020; where both can be, the day comes first
    if month_first:
        numbers[1:] = reversed(numbers[1:])
    try:
        day = datetime.date(*numbers).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    d = datetime.date.fromordinal(FIRST_DAY + permute(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date", back))
    if year_first:
        return f"{d.year:04d}{mark}{d.month:02d}{mark}{d.day:02d}"
    return mark.join([f"{d.month:02d}", f"{d.day:02d}"] if month_first else [f"{d.day:02d}", f"{d.month:02d}"]) + f"{mark}{d.year:04d}"


def _ip(text, key, back):
    parts = [int(p) for p in text.split(".")]
    if max(parts) > 255:
        return None
    return ".".join(map(str, permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip", back).to_bytes(4, "big")))


def _phone(text, key, back):
    digits = re.sub(r"\D", "", text)
    if not 7 <= len(digits) <= 15:
        return None
    code = len(re.match(r"\+?(\d{0,3})(?=[ .-]|\()", text)[1]) if text.startswith("+") and re.match(r"\+\d{1,3}(?=[ .-]|\()", text) else 0
    if not code and text.startswith("+1") and len(digits) == 11:
        code = 1
    rest = digits[code:]
    region = "1" if len(rest) == 10 and digits[:code] in ("", "1") else digits[:code]  # one national number, with its code or without
    return _refill(text, digits[:code] + f"{permute(int(rest), 10 ** len(rest), key, f'phone{region}', back):0{len(rest)}d}")


def _ssn(text, key, back):
    """Areas 001 to 899 but 666, groups from 01, serial numbers from 0001."""
    area, group, serial = map(int, text.split("-"))
    if not 1 <= area <= 899 or area == 666 or not group or not serial:
        return None
    number = permute(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, key, "ssn", back)
    area, group, serial = number // (99 * 9999) + 1, number // 9999 % 99 + 1, number % 9999 + 1
    return f"{area + (area >= 666):03d}-{group:02d}-{serial:04d}"


def _email(text, key, back):
    name, at, host = text.rpartition("@")
    own, dot, top = host.rpartition(".")  # a host may name a family; its top-level domain stays
    return permute_chars(name, by_class(name), key, "email", back) + at + permute_chars(own, by_class(own), key, "host", back) + dot + top


def _secret(text, key, back):
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text):
        hexes = "0123456789abcdef" if text == text.lower() else "0123456789ABCDEF"
        return permute_chars(text, [hexes] * len(text), key, "secret", back)
    lead = len(re.match(r"AKIA|ASIA|gh[pousr]_|sk-", text)[0])
    return permute_chars(text, [None] * lead + by_class(text[lead:]), key, "secret", back)


def _iban_part(text):
    """The IBAN that ``text`` begins with, by its country's length: upper-case words and numbers behind it look like further groups."""
    length = IBAN_LENGTHS.get(text[:2])
    if length is None:
        return text
    ends = [i + 1 for i, c in enumerate(text) if c != " "]
    end = ends[length - 1] if len(ends) >= length else len(text)
    return text if text[end:end + 1].isalnum() else text[:end]


KINDS: dict[str, Callable] = {"email": _email, "secret": _secret, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "card": _card, "phone": _phone}


#: The kinds' own patterns.
ONE = {kind: re.compile(FOUND.pattern[m.start():m.end()], re.X | re.A) for kind, m in
       ((kind, re.search(rf"\(\?P<{kind}>.*", FOUND.pattern)) for kind in KINDS)}


def pseudonymise(text: str, key: bytes, back: bool = False) -> tuple[str, list[tuple[str, int, int, str]]]:
    """(new text, spans): a span is kind, start and end in the old text, and the pseudonym.

    What fails its check is tried as the later kinds, then left alone, and the search goes on at its second character.
    """
    if not MAY_HOLD.search(text):
        return text, []
    out, spans, at, m = [], [], 0, FOUND.search(text)
    while m:
        start, names = m.start(), list(KINDS)
        first = next(i for i, k in enumerate(names) if m[k])
        goes_on = start + 1
        for kind in names[first:]:
            found = m if kind == names[first] else ONE[kind].match(text, start)
            if not found:
                continue
            old = _iban_part(found[0]) if kind == "iban" else found[0]
            new = KINDS[kind](old, key, back)
            if new is not None:
                out += [text[at:start], new]
                goes_on = at = start + len(old)
                spans.append((kind, start, at, new))
                break
        m = FOUND.search(text, goes_on)
    return "".join([*out, text[at:]]), spans


def pseudonymised(docs: DataFrame, key: bytes, id_column: str = "doc_id", text_column: str = "text", back: bool = False) -> DataFrame:
    """(doc_id, text, n_found, spans) per row of ``docs``; ``back`` turns pseudonyms into the values again.

    A null text stays null and an empty one empty, without spans; null ids and repeated rows are rows like any other; whole texts of any length are
    searched; an empty table gives no row. Other columns are not read.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("i"), F.col(text_column).cast("string").alias("t"))

    def replace(batches):
        import pyarrow as pa
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("pseudonym", pa.string())]))
        for batch in batches:
            texts, found = [], []
            for t in batch.column(1):
                new, spans = pseudonymise(t.as_py(), key, back) if t.is_valid else (None, [])
                texts.append(new)
                found.append([dict(zip(("kind", "start", "end", "pseudonym"), s)) for s in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([len(f) for f in found], pa.int32()), pa.array(found, span)],
                                             names=["doc_id", "text", "n_found", "spans"])

    return rows.mapInArrow(replace, "doc_id long, text string, n_found int, spans array<struct<kind:string,start:int,end:int,pseudonym:string>>")


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms in place of personal numbers, dates, addresses and keys."""
    run_folder(spark, "pseudonyms")
    return pseudonymised(spark.read.parquet(f"{sf_dir}/documents.parquet"), TEST_KEY)
