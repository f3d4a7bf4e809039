"""Personal numbers and dates replaced by keyed pseudonyms of the same format.

Candidates are found by pattern and validated (check digits, octets, calendar).
A valid one is a number of a known range; a Feistel network over that range,
keyed by a secret, permutes it, so its pseudonym is valid too, equal values get
equal pseudonyms in all documents, and the holder of the key can go back. What
does not validate stays as it is. Only SQL functions: the matches of a text are
an array, changed by lambdas and joined with the text between them.

The range is split into two residues, ``left`` below ``a`` and ``right`` below
``b``; a round adds a keyed hash of one to the other. Adding modulo ``a`` or
``b`` is undone by subtracting, so every round is a permutation of the range.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.once import compute_once

ROUNDS = 8
KINDS = ("card", "date", "iban", "ip", "phone", "ssn")
FIRST_DAY, DAYS = "1900-01-01", 73_049      # up to 2099-12-31; 229 * 319 days
DAY_PARTS = (229, 319)
FIRST_YEAR, YEARS = 1900, 200
# Days from the 13th on of a year without a leap day: how many stand before each month's.
LATE_DAYS = tuple(accumulate((n - 12 for n in (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)), initial=0))
FIRST_LEAP, LEAP_PARTS = 1904, (7, 7)        # 49 leap days up to 2096

ISO = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
SLASHED = r"[0-9]{2}/[0-9]{2}/[0-9]{4}"     # day first; month first where only that is a date
YEAR_SLASHED = r"[0-9]{4}/[0-9]{2}/[0-9]{2}"
NAMED = r"[0-9]{2} (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) [0-9]{4}"
DOTTED = r"[0-9]{2}\.[0-9]{2}\.[0-9]{4}"    # day first
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
PHONE = (r"(?:\+[0-9]{1,3}[ -]|1-)?(?:\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{4})"
         r"|\+[0-9]{1,3} [0-9]{3} [0-9]{3} [0-9]{4}|\+[0-9]{11,13}")
IP = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
CARD = r"[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{13,19}"
# Dates and addresses also stand in timestamps, paths, file names, URLs and before prefix lengths.
ANY = (rf"(?<![0-9A-Za-z_+]|[^A-Za-z][.-]|^[.-]){ISO}(?=T[0-9]|(?![0-9A-Za-z_]|[.-][0-9]))"
       rf"|(?<![0-9A-Za-z_.+]|[^A-Za-z]-|^-){IP}(?![0-9A-Za-z_]|[.-][0-9])"
       rf"|(?<![0-9A-Za-z_.+/-])(?:{SLASHED}|{YEAR_SLASHED}|{NAMED}|{DOTTED}|{IBAN}|{SSN}|{PHONE}|{CARD})(?![0-9A-Za-z_]|[./-][0-9])")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _long(text: Column) -> Column:
    return text.cast("bigint")


def _hash(key: Column, kind: str, step: Column, value: Column, modulus: Column) -> Column:
    """A keyed number below ``modulus`` (at most 10^9, far below the hash's 60 bits)."""
    mac = F.sha2(F.concat_ws("|", key, F.lit(kind), step.cast("string"), value.cast("string"), key), 256)
    return F.pmod(F.conv(F.substring(mac, 1, 15), 16, 10).cast("bigint"), modulus)


def feistel(left: Column, right: Column, a: Column, b: Column, key: Column, kind: str, back: bool = False) -> Column:
    """Permute the pair ``left < a``, ``right < b``; gives a struct of both."""
    order = range(ROUNDS, 0, -1) if back else range(1, ROUNDS + 1)
    sign = -1 if back else 1

    def step(acc: Column, i: Column) -> Column:
        on_left = i % 2 == 1
        new_left = F.pmod(acc["left"] + _hash(key, kind, i, acc["right"], a) * sign, a)
        new_right = F.pmod(acc["right"] + _hash(key, kind, i, acc["left"], b) * sign, b)
        return F.struct(F.when(on_left, new_left).otherwise(acc["left"]).alias("left"),
                        F.when(on_left, acc["right"]).otherwise(new_right).alias("right"))

    start = F.struct(left.cast("bigint").alias("left"), right.cast("bigint").alias("right"))
    return F.aggregate(F.array(*[F.lit(i) for i in order]), start, step)


def _power(n: Column) -> Column:
    """Ten to the power of ``n``."""
    return F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("bigint")


def _pad(number: Column, width: Column | int) -> Column:
    return F.lpad(number.cast("string"), width, F.lit("0") if isinstance(width, Column) else "0")


def _permuted_digits(digits: Column, n: Column, key: Column, kind: str, back: bool) -> Column:
    """Digits of length ``n`` (up to 18), halved and permuted."""
    half = F.floor(n / 2).cast("int")
    rest = (n - half).cast("int")
    pair = feistel(_long(F.substring(digits, F.lit(1), half)), _long(F.substring(digits, half + 1, rest)),
                   _power(half), _power(rest), key, kind, back)
    # One evaluation of the pair, then both halves as text.
    return F.transform(F.array(pair), lambda p: F.concat(_pad(p["left"], half), _pad(p["right"], rest)))[0]


def luhn_sum(digits: Column) -> Column:
    """Weighted sum with the last digit counted once."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def _fill(mask: Column, digits: Column) -> Column:
    """``mask`` with its digits replaced by ``digits`` in order."""
    start = F.struct(F.lit(0).alias("i"), F.lit("").alias("out"))

    def put(acc: Column, c: Column) -> Column:
        is_digit = (c >= "0") & (c <= "9")
        return F.struct((acc["i"] + is_digit.cast("int")).alias("i"),
                        F.concat(acc["out"], F.when(is_digit, F.substring(digits, acc["i"] + 1, F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(F.split(mask, ""), start, put, lambda acc: acc["out"])


def _full(pattern: str) -> str:
    return f"^(?:{pattern})$"


def _card(h: Column, key: Column, back: bool) -> tuple[Column, Column]:
    digits = _digits(h)
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    new = _permuted_digits(body, F.length(body), key, "card", back)
    checked = F.transform(F.array(new), lambda d: F.concat(
        d, F.pmod(-luhn_sum(F.concat(d, F.lit("0"))), F.lit(10)).cast("string")))[0]
    return h.rlike(_full(CARD)) & (luhn_sum(digits) % 10 == 0), F.transform(F.array(checked), lambda d: _fill(h, d))[0]


def _phone(h: Column, key: Column, back: bool) -> tuple[Column, Column]:
    digits = _digits(h)
    code = F.length(digits) - 10
    new = _permuted_digits(F.substring(digits, code + 1, F.lit(10)), F.lit(10), key, "phone", back)
    return h.rlike(_full(PHONE)) & (code >= 0), F.transform(
        F.array(F.concat(F.substring(digits, F.lit(1), code), new)), lambda d: _fill(h, d))[0]


def _ssn(h: Column, key: Column, back: bool) -> tuple[Column, Column]:
    """Area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999."""
    area, group, serial = (_long(F.substring(h, p, n)) for p, n in ((1, 3), (5, 2), (8, 4)))
    valid = h.rlike(_full(SSN)) & area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    left = F.when(area > 666, area - 2).otherwise(area - 1) * 99 + group - 1
    pair = feistel(left, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn", back)

    def show(p: Column) -> Column:
        slot = F.floor(p["left"] / 99)
        return F.concat_ws("-", _pad(slot + F.when(slot >= 665, 2).otherwise(1), 3),
                           _pad(p["left"] % 99 + 1, 2), _pad(p["right"] + 1, 4))

    return valid, F.transform(F.array(pair), show)[0]


def _ip(h: Column, key: Column, back: bool) -> tuple[Column, Column]:
    part = [_long(F.get(F.split(h, r"\."), i)) for i in range(4)]
    plain = ~h.rlike(r"(^|\.)0[0-9]")
    valid = h.rlike(_full(IP)) & plain & (F.greatest(*part) <= 255)
    pair = feistel(part[0] * 256 + part[1], part[2] * 256 + part[3], F.lit(65536), F.lit(65536), key, "ip", back)
    return valid, F.transform(F.array(pair), lambda p: F.concat_ws(
        ".", *[x.cast("string") for half in (p["left"], p["right"]) for x in (F.floor(half / 256), half % 256)]))[0]


def _date(h: Column, key: Column, back: bool, shape: str, pattern: str) -> tuple[Column, Column]:
    day = F.try_to_date(h, pattern)
    number = F.date_diff(day, F.lit(FIRST_DAY).cast("date"))
    valid = h.rlike(_full(shape)) & F.coalesce(number.between(0, DAYS - 1), F.lit(False))
    a, b = DAY_PARTS
    pair = feistel(F.floor(number / b), number % b, F.lit(a), F.lit(b), key, "date", back)
    return valid, F.transform(F.array(pair), lambda p: F.date_format(
        F.date_add(F.lit(FIRST_DAY).cast("date"), (p["left"] * b + p["right"]).cast("int")), pattern))[0]


def _month_first(h: Column, key: Column, back: bool) -> tuple[Column, Column]:
    """MM/dd/yyyy with a day above 12, permuted among such dates; a leap day among leap days."""
    month, day, year = (_long(F.substring(h, p, n)) for p, n in ((1, 2), (4, 2), (7, 4)))
    real = F.try_to_date(h, "MM/dd/yyyy").isNotNull()
    valid = h.rlike(_full(SLASHED)) & real & (day > 12) & year.between(FIRST_YEAR, FIRST_YEAR + YEARS - 1)
    offsets = F.array(*[F.lit(n) for n in LATE_DAYS[:-1]])
    place = F.get(offsets, (month - 1).cast("int")) + day - 13
    pair = feistel(year - FIRST_YEAR, place, F.lit(YEARS), F.lit(LATE_DAYS[-1]), key, "late", back)

    def show(p: Column) -> Column:
        m = F.size(F.filter(offsets, lambda o: o <= p["right"]))
        return F.concat_ws("/", _pad(m, 2), _pad(p["right"] - F.get(offsets, m - 1) + 13, 2), _pad(p["left"] + FIRST_YEAR, 4))

    a, b = LEAP_PARTS
    leap = F.floor((year - FIRST_LEAP) / 4)
    leaps = feistel(F.floor(leap / b), leap % b, F.lit(a), F.lit(b), key, "leap", back)
    late = F.transform(F.array(pair), show)[0]
    leap_day = F.transform(F.array(leaps), lambda p: F.concat(F.lit("02/29/"), _pad((p["left"] * b + p["right"]) * 4 + FIRST_LEAP, 4)))[0]
    return valid, F.when((month == 2) & (day == 29), leap_day).otherwise(late)


def mod97(text: Column) -> Column:
    """A text of digits and capitals, A as 10 to Z as 35, as a number modulo 97."""
    def add(acc: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def _iban(h: Column, key: Column, back: bool) -> tuple[Column, Column]:
    """Up to 18 last digits of the account are permuted, the check digits follow; letters and blanks stay."""
    plain = F.replace(h, F.lit(" "), F.lit(""))
    country, check, body = F.substring(plain, 1, 2), F.substring(plain, 3, 2), F.substring(plain, F.lit(5), F.length(plain))
    digits = _digits(body)
    n = F.least(F.length(digits), F.lit(18))
    valid = h.rlike(_full(IBAN)) & F.length(plain).between(15, 34) & (n >= 2) & check.between("02", "98") & (
        mod97(F.concat(body, country, check)) == 1)
    last = F.substring(digits, F.length(digits) - n + 1, n)
    new = _permuted_digits(last, n, key, "iban", back)
    filled = F.transform(F.array(F.concat(F.substring(digits, F.lit(1), F.length(digits) - n), new)), lambda d: _fill(body, d))[0]

    def show(b: Column) -> Column:
        return _fill_all(h, F.concat(country, _pad(98 - mod97(F.concat(b, country, F.lit("00"))), 2), b))

    return valid, F.transform(F.array(filled), show)[0]


def _fill_all(mask: Column, plain: Column) -> Column:
    """``plain`` with blanks where ``mask`` has them."""
    start = F.struct(F.lit(0).alias("i"), F.lit("").alias("out"))

    def put(acc: Column, c: Column) -> Column:
        return F.struct((acc["i"] + (c != " ").cast("int")).alias("i"),
                        F.concat(acc["out"], F.when(c == " ", c).otherwise(F.substring(plain, acc["i"] + 1, F.lit(1)))).alias("out"))

    return F.aggregate(F.split(mask, ""), start, put, lambda acc: acc["out"])


def _changed(h: Column, key: Column, back: bool) -> Column:
    """``(kind, new)`` of a match; the kind is null where it does not validate."""
    options = [
        ("date", *_date(h, key, back, ISO, "yyyy-MM-dd")), ("date", *_date(h, key, back, SLASHED, "dd/MM/yyyy")),
        ("date", *_month_first(h, key, back)), ("date", *_date(h, key, back, YEAR_SLASHED, "yyyy/MM/dd")),
        ("date", *_date(h, key, back, NAMED, "dd MMM yyyy")),
        ("date", *_date(h, key, back, DOTTED, "dd.MM.yyyy")), ("iban", *_iban(h, key, back)), ("ssn", *_ssn(h, key, back)),
        ("phone", *_phone(h, key, back)), ("ip", *_ip(h, key, back)), ("card", *_card(h, key, back)),
    ]
    chain = F
    for kind, valid, new in options:
        chain = chain.when(valid, F.struct(F.lit(kind).alias("kind"), new.alias("new")))
    return chain.otherwise(F.struct(F.lit(None).cast("string").alias("kind"), h.alias("new")))


def _count(kind: str) -> Column:
    return F.coalesce(F.size(F.filter("__llm_new", lambda n: n["kind"] == kind)), F.lit(0)).cast("long")


def pseudonymize(rows: DataFrame, key: str, text: str = "text", back: bool = False) -> DataFrame:
    """Replace valid numbers and dates in ``text``; add ``n_card, n_date, n_iban, n_ip, n_phone, n_ssn``.

    ``key`` is the secret; ``back=True`` restores the originals. All columns
    stay; null texts stay null with counts of 0; empty and very long texts need
    no care, as each text is handled as a whole in its row; repeated rows get
    equal results; input columns named like the counts are replaced, other columns
    may have any name that does not begin with ``__llm_``; an empty table stays empty.
    """
    body = F.col(f"`{text}`")
    names = [f"n_{kind}" for kind in KINDS]
    found = compute_once(rows.drop(*names), __llm_hits=F.regexp_extract_all(body, F.lit(ANY), F.lit(0)))
    some = F.size("__llm_hits") > 0
    secret = F.lit(key)
    found = compute_once(found, __llm_new=F.when(some, F.transform("__llm_hits", lambda h: _changed(h, secret, back))))
    between = F.split(body, ANY, -1)
    joined = F.array_join(F.flatten(F.zip_with(between, "__llm_new", lambda t, n: F.array(t, F.coalesce(n["new"], F.lit(""))))), "")
    counts = [_count(kind).alias(f"n_{kind}") for kind in KINDS]
    plain = [F.when(some, joined).otherwise(body).alias(text) if c == text else F.col(f"`{c}`")
             for c in rows.columns if c not in names]
    return found.select(*plain, *counts)
