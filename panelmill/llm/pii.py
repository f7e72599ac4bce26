"""Format-preserving pseudonyms for personal data, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

ROUNDS = 8
#: The 4800 months of 400 years have 57600 = 240 * 240 days up to the twelfth and 88497 = 9 * 9833 after it. Fixed values.
EPOCH, MONTHS = "1800-01-01", 4800
EARLY_A, EARLY_B, LATE_A, LATE_B = 240, 240, 9, 9833
#: Digits of a card number.
CARD_LEAST, CARD_MOST = 13, 19

#: What is looked for, in this order at each place.
SHAPES = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9-]*+\.)++[A-Za-z]{2,24}",
    "secret": r"(?<![\p{L}\p{N}])(?=[0-9]{0,63}[A-Fa-f])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![\p{L}\p{N}])",
    "address": r"(?<![\p{N}.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?!\.?\p{N})",
    "iso": r"(?<![\p{N}-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![\p{N}]|-\p{N})",
    "dotted": r"(?<![\p{N}.])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?!\.?\p{N})",
    "slashed": r"(?<![\p{N}/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?!/?\p{N})",
    "phone": r"(?<![\p{L}\p{N}+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?!\p{N})",
    "national": r"(?<![\p{L}\p{N}+.-])(?:\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![.-]?\p{N})",
    "trunk": r"(?<![\p{L}\p{N}+.-])0[0-9]{2,4} [0-9]{3,4} [0-9]{3,4}(?![ .-]?\p{N})",
    "social": r"(?<![\p{N}-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![\p{N}]|-\p{N})",
    "card": r"(?<![\p{N}])[0-9](?:[ -]?[0-9]){12,24}(?![\p{N}])",
}
DATES = {"iso": "yyyy-MM-dd", "dotted": "dd.MM.yyyy", "slashed": "MM/dd/yyyy"}
ANY = "|".join(f"(?:{s})" for s in SHAPES.values())


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, tweak: Column, back: bool = False) -> Column:
    """A keyed permutation of the pairs (left, right) below (a, b): rounds add a keyed digest of one half to the other.

    Any two moduli will do, so a format's values are permuted among themselves without retries. ``back`` inverts.
    """

    def turn(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), F.when(odd, s["l"]).otherwise(s["r"]).cast("string")), 256)
        add = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
        add = -add if back else add
        l2 = F.when(odd, s["l"]).otherwise(F.pmod(s["l"] + F.pmod(add, a), a))
        r2 = F.when(odd, F.pmod(s["r"] + F.pmod(add, b), b)).otherwise(s["r"])
        return F.struct(l2.alias("l"), r2.alias("r"))

    order = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
    return F.reduce(F.array(*[F.lit(i) for i in order]), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), turn)


def ten(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def number(digits: Column, key: str, kind: str, back: bool = False) -> Column:
    """Permute the strings of n digits among themselves, n from 2 to 36."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    rest = n - half
    s = feistel(F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, rest), ten(half), ten(rest), key, F.concat_ws("/", F.lit(kind), n.cast("string")), back)
    return F.reduce(F.array(s), F.lit(""), lambda _, x: F.concat(F.lpad(x["l"].cast("string"), half, "0"), F.lpad(x["r"].cast("string"), rest, "0")))


def luhn(payload: Column) -> Column:
    """The check digit of a string of digits."""
    n = F.length(payload)

    def value(i: Column) -> Column:
        d = F.substring(payload, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    total = F.reduce(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + value(i))
    return F.pmod(-total, F.lit(10))


def card(digits: Column, key: str, back: bool = False) -> Column:
    """Permute all but the last digit, which becomes the check digit: valid numbers are permuted among themselves."""
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    return F.reduce(F.array(number(body, key, "card", back)), F.lit(""), lambda _, x: F.concat(x, luhn(x).cast("string")))


def card_span(value: Column) -> Column:
    """Where a run of digits, in groups, holds a number with a right check digit: (n digits, minus the first place, the last place) or null.

    A number starts and ends with whole groups; the longest counts, the first of these.
    """
    digit = lambda i: F.substring(value, i, F.lit(1)).rlike("[0-9]")
    places = F.sequence(F.lit(1), F.length(value))
    starts = F.filter(places, lambda i: digit(i) & ((i == 1) | ~digit(i - 1)))
    ends = F.filter(places, lambda i: digit(i) & ~digit(i + 1))
    inside = lambda s, e: digits_of(F.substring(value, s, e - s + 1))
    spans = F.flatten(F.transform(starts, lambda s: F.transform(ends, lambda e: F.struct(F.length(inside(s, e)).alias("n"), (-s).alias("s"), e.alias("e")))))
    sized = F.filter(spans, lambda x: (x["e"] > -x["s"]) & x["n"].between(CARD_LEAST, CARD_MOST))

    def right(x: Column) -> Column:
        d = inside(-x["s"], x["e"])
        return luhn(F.substring(d, F.lit(1), x["n"] - 1)) == F.substring(d, x["n"], F.lit(1)).cast("int")

    return F.array_max(F.filter(sized, right))


def refill(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced in order."""
    step = lambda s, c: F.when(
        c.rlike("[0-9]"), F.struct(F.concat(s["t"], F.substring(digits, s["i"], F.lit(1))).alias("t"), (s["i"] + 1).alias("i"))
    ).otherwise(F.struct(F.concat(s["t"], c).alias("t"), s["i"].alias("i")))
    return F.reduce(F.split(value, ""), F.struct(F.lit("").alias("t"), F.lit(1).alias("i")), step, lambda s: s["t"])


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def date(value: Column, pattern: str, key: str, back: bool = False) -> Column:
    """Permute the days of 400 years; what is no such day stays as it is.

    Days up to a month's twelfth stay among themselves, and so do the later ones: then a date with slashes is read in the same order
    before and after, and one permutation serves all ways to write a day.
    """
    day = F.to_date(F.try_to_timestamp(value, F.lit(pattern)))
    epoch = F.lit(EPOCH).cast("date")
    start = lambda m: F.datediff(F.add_months(epoch, m), epoch) - m * 12
    month = (F.year(day) - int(EPOCH[:4])) * 12 + F.month(day) - 1

    def turned(at: Column, a: int, b: int, part: str, written_out) -> Column:
        s = feistel(F.floor(at / b), F.pmod(at, F.lit(b)), F.lit(a), F.lit(b), key, F.lit(f"date {part}"), back)
        return F.reduce(F.array(s), F.lit(""), lambda _, x: F.date_format(written_out((x["l"] * b + x["r"]).cast("int")), pattern))

    def early(r: Column) -> Column:
        return F.date_add(F.add_months(epoch, F.floor(r / 12).cast("int")), r % 12)

    def late(r: Column) -> Column:
        near = F.floor(r * MONTHS / (LATE_A * LATE_B)).cast("int")
        m = F.array_max(F.filter(F.sequence(near - 2, near + 2), lambda m: start(m) <= r))
        return F.date_add(F.add_months(epoch, m), r - start(m) + 12)

    known = month.between(0, MONTHS - 1)
    return (
        F.when(known & (F.dayofmonth(day) <= 12), turned(month * 12 + F.dayofmonth(day) - 1, EARLY_A, EARLY_B, "early", early))
        .when(known, turned(start(month) + F.dayofmonth(day) - 13, LATE_A, LATE_B, "late", late))
        .otherwise(value)
    )


def social(digits: Column, key: str, back: bool = False) -> Column:
    """Permute the valid social security numbers: area 1 to 899 but 666, group from 1, serial from 1."""
    part = lambda at, n: F.substring(digits, F.lit(at), F.lit(n)).cast("long")
    area = part(1, 3)
    area = F.when(area > 666, area - 2).otherwise(area - 1)
    s = feistel(area * 99 + part(4, 2) - 1, part(6, 4) - 1, F.lit(898 * 99), F.lit(9999), key, F.lit("social"), back)

    def written_out(s: Column) -> Column:
        area = F.floor(s["l"] / 99)
        area = F.when(area > 664, area + 2).otherwise(area + 1)
        return F.concat(*[F.lpad(x.cast("string"), n, "0") for x, n in ((area, 3), (s["l"] % 99 + 1, 2), (s["r"] + 1, 4))])

    return F.reduce(F.array(s), F.lit(""), lambda _, x: written_out(x))


def address(value: Column, key: str, back: bool = False) -> Column:
    """Permute the IPv4 addresses."""
    p = F.split(value, r"\.")
    o = [p[i].cast("long") for i in range(4)]
    s = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, F.lit("address"), back)
    return F.reduce(F.array(s), F.lit(""), lambda _, x: F.concat_ws(".", *[part.cast("string") for h in ("l", "r") for part in (F.floor(x[h] / 256), x[h] % 256)]))


def kind_of(value: Column) -> Column:
    """The first shape that the value has; null for a run of digits that holds no card number."""
    out = None
    for name, shape in SHAPES.items():
        test = value.rlike(f"^(?:{shape})$")
        if name == "card":
            test = test & card_span(value).isNotNull()
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def pseudonym(value: Column, kind: Column, key: str, back: bool = False) -> Column:
    """The pseudonym of a found value. Equal digits get equal pseudonyms whatever separates them.

    Numbers, addresses and dates are permuted within their format (``back`` inverts); names of mailboxes and secrets, which
    have no small format, become keyed digests of the same length (8 at least, 64 at most) and cannot be inverted.
    """
    digest = lambda v: F.sha2(F.concat_ws("|", F.lit(key), F.lit("text"), v), 256)
    name, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    mailbox = F.concat(F.substring(digest(F.lower(value)), F.lit(1), F.greatest(F.length(name), F.lit(8))), F.lit("@"), domain)
    hexes = F.substring(digest(F.lower(value)), F.lit(1), F.length(value))
    secret = F.when(value.rlike("[A-F]"), F.upper(hexes)).otherwise(hexes)
    lead = F.regexp_extract(value, r"^\+[0-9]{1,3}?(?=[ .(-]|[0-9]{7,}$)", 0)
    tail = F.substring(value, F.length(lead) + 1, F.length(value))
    span = lambda x: F.substring(value, -x["s"], x["e"] + x["s"] + 1)
    number_in = F.reduce(
        F.array(card_span(value)),
        value,
        lambda _, x: F.concat(F.substring(value, F.lit(1), -x["s"] - 1), refill(span(x), card(digits_of(span(x)), key, back)), F.substring(value, x["e"] + 1, F.length(value))),
    )
    return (
        F.when(kind == "email", mailbox)
        .when(kind == "secret", secret)
        .when(kind == "address", address(value, key, back))
        .when(kind == "iso", date(value, DATES["iso"], key, back))
        .when(kind == "dotted", date(value, DATES["dotted"], key, back))
        .when((kind == "slashed") & F.try_to_timestamp(value, F.lit(DATES["slashed"])).isNull(), date(value, "dd/MM/yyyy", key, back))
        .when(kind == "slashed", date(value, DATES["slashed"], key, back))
        .when(kind.isin("phone", "national", "trunk"), F.concat(lead, refill(tail, number(digits_of(tail), key, "phone", back))))
        .when(kind == "social", refill(value, social(digits_of(value), key, back)))
        .when(kind == "card", number_in)
        .otherwise(value)
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text", back: bool = False) -> DataFrame:
    """Replace personal data in ``text`` by keyed pseudonyms and add n_numbers, n_dates and n_names.

    Found: mailboxes, hexadecimal secrets, IPv4 addresses, calendar dates (slashes as month first, or day first where that is no day),
    phone numbers with a plus, as 3-3-4 digits or with a leading 0 in three groups, social security numbers in their valid ranges, and card
    numbers, which are 13 to 19 digits with a right check digit; other long digits (ids, time stamps) are left alone. Numbers, addresses and dates go
    through a Feistel permutation of their own format, so equal values stay linked across documents and none collide; a day is the same
    value however it is written. Row-local column expressions: no shuffle and no Python.

    A null text stays null with counts 0; an empty text stays empty. Digits that are no such value (a date that does not exist,
    an octet above 255) are left alone. Repeated rows get equal results, an empty table stays empty, a text of any length is one pass of
    the pattern. Other columns stay; columns with the names of the counts are replaced. With ``back``, numbers, addresses and dates are
    turned back (but for a card number with further groups of digits right beside it, where another span may have become valid).
    """
    column = F.col(f"`{text}`")
    found, = free_name(docs, "_found")
    some = F.when(column.rlike("[0-9@]"), F.regexp_extract_all(column, F.lit(f"({ANY})"), F.lit(1)))
    none = F.array().cast("array<struct<v:string,k:string>>")
    hits = F.coalesce(F.transform(some, lambda v: F.struct(v.alias("v"), kind_of(v).alias("k"))), none)
    out = docs.withColumn(found, hits)
    turned = F.transform(F.col(found), lambda x: pseudonym(x["v"], x["k"], key, back))
    woven = F.array_join(F.zip_with(F.split(column, ANY, -1), turned, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    many = lambda *kinds: F.size(F.filter(F.col(found), lambda x: x["k"].isin(*kinds))).cast("long")
    counts = {"n_numbers": many("address", "phone", "national", "trunk", "social", "card"), "n_dates": many(*DATES), "n_names": many("email", "secret")}
    return out.withColumns(counts | {text: F.when(F.size(found) > 0, woven).otherwise(column)}).drop(found)
