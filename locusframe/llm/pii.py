"""Personal data replaced by format-preserving Feistel pseudonyms, in native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import let

#: Feistel rounds; the halves swap roles in each.
ROUNDS = 10

# What counts as personal data, in the order in which alternatives are tried.
# An address starts where a run of its characters starts, or where the match before it ends;
# a name in the DNS has 127 labels at most.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){0,125}\.[A-Za-z]{2,}"
IBAN = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"
IPV4 = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)"
ISO_DATE = r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])"
DAY_DATE = r"(?<![\d./])\d{1,2}([./])\d{1,2}\1\d{4}(?![\d./])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}[ -]\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])"
NUMBER = r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])"
KINDS = ("email", "iban", "ip", "date", "ssn", "phone", "number")
_DAY = r"(?<![\d./])\d{1,2}(?:\.\d{1,2}\.|/\d{1,2}/)\d{4}(?![\d./])"
ANY = "|".join((EMAIL, IBAN, IPV4, ISO_DATE, _DAY, SSN, PHONE, NUMBER))
#: Years of one Gregorian cycle have 146,097 = 189 * 773 days.
CYCLE_DAYS, DAYS_A, DAYS_B = 146_097, 189, 773


def _round(key: str, label: str, turn: Column, other: Column, size: Column) -> Column:
    """A keyed value below ``size``: 52 bits of a SHA-256 over key, use, round and the other half."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(label), size.cast("string"), turn.cast("string"), other.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 13), 16, 10).cast("long"), size)


def feistel(value: Column, a: Column, b: Column, key: str, label: str) -> Column:
    """A keyed permutation of 0 .. a*b-1: halves below ``a`` and ``b`` are shifted by turns, modulo their sizes."""
    return let(F.struct(value.cast("long").alias("v"), a.cast("long").alias("a"), b.cast("long").alias("b")), lambda x: _feistel(x["v"], x["a"], x["b"], key, label))


def _feistel(value: Column, a: Column, b: Column, key: str, label: str) -> Column:
    start = F.struct(F.floor(value / b).cast("long").alias("l"), F.pmod(value, b).alias("r"))

    def turn(acc: Column, i: Column) -> Column:
        left, right = acc["l"], acc["r"]
        odd = F.pmod(i, F.lit(2)) == 1
        moved_left = F.pmod(left + _round(key, label, i, right, a), a)
        moved_right = F.pmod(right + _round(key, label, i, left, b), b)
        return F.struct(F.when(odd, moved_left).otherwise(left).alias("l"), F.when(odd, right).otherwise(moved_right).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda acc: acc["l"] * b + acc["r"])


def permuted_digits(digits: Column, key: str, label: str | Column) -> Column:
    """Digits permuted among all strings of the same length (1 to 18)."""
    return let(digits, lambda d: _permuted_digits(d, key, label))


def _permuted_digits(digits: Column, key: str, label: str) -> Column:
    n = F.length(digits)
    low = F.floor(n / 2).cast("int")
    power = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    high = digits.substr(F.lit(1), n - low)
    rest = digits.substr(n - low + 1, low)
    value = high.cast("long") * power(low) + F.when(low > 0, rest.cast("long")).otherwise(F.lit(0))
    return F.lpad(feistel(value, power(n - low), power(low), key, label).cast("string"), n, "0")


def _refill(template: Column, digits: Column) -> Column:
    """``template`` with its digits replaced, in order, by ``digits``; other characters keep their places."""
    return let(digits, lambda d: _refilled(template, d))


def _refilled(template: Column, digits: Column) -> Column:
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))
    step = lambda acc, c: F.when(
        c.rlike("^[0-9]$"), F.struct(F.concat(acc["s"], digits.substr(acc["i"], F.lit(1))).alias("s"), (acc["i"] + 1).alias("i"))
    ).otherwise(F.struct(F.concat(acc["s"], c).alias("s"), acc["i"].alias("i")))
    return F.aggregate(F.split(template, ""), start, step, lambda acc: acc["s"])


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum, the last digit counted once."""
    return let(digits, _luhn_sum)


def _luhn_sum(digits: Column) -> Column:
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = digits.substr(i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(F.pmod(n - i, F.lit(2)) == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + value(i))


def _is_card(match: Column) -> Column:
    return F.pmod(luhn_sum(F.regexp_replace(match, "[^0-9]", "")), F.lit(10)) == 0


def _number(match: Column, key: str) -> Column:
    """Numbers that pass the Luhn check get new digits and pass it again; others keep their text."""

    def renumbered(body: Column) -> Column:
        check = F.pmod(10 - F.pmod(luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
        return _refill(match, F.concat(body, check.cast("string")))

    digits = F.regexp_replace(match, "[^0-9]", "")
    body = permuted_digits(digits.substr(F.lit(1), F.length(digits) - 1), key, "card")
    return F.when(_is_card(match), let(body, renumbered)).otherwise(match)


def _day_of(match: Column) -> Column:
    """(day, american): the day that a match names, null where there is none."""
    iso = match.rlike(r"^\d{4}-")
    part = lambda i: F.get(F.split(match, "[./-]"), F.lit(i))
    # D.M.Y and D/M/Y; where that is no date, D/M/Y is read as M/D/Y.
    y, first, second = part(2), part(0), part(1)
    dmy = F.try_to_timestamp(F.concat_ws("-", y, F.lpad(second, 2, "0"), F.lpad(first, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")
    mdy = F.try_to_timestamp(F.concat_ws("-", y, F.lpad(first, 2, "0"), F.lpad(second, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")
    day = F.when(iso, F.try_to_timestamp(match, F.lit("yyyy-MM-dd")).cast("date")).otherwise(F.coalesce(dmy, mdy))
    day = F.when(F.year(day) >= 400, day)  # the cycle of year 0 has no first day to count from
    return F.struct(day.alias("day"), (~iso & dmy.isNull() & mdy.isNotNull()).alias("american"))


def _date(match: Column, key: str) -> Column:
    """Valid dates move to another day of their 400-year cycle and keep their layout; others keep their text."""

    def moved(x: Column) -> Column:
        origin = F.make_date((F.floor(F.year(x["day"]) / 400) * 400).cast("int"), F.lit(1), F.lit(1))
        place = F.date_diff(x["day"], origin).cast("long")
        return let(F.date_add(origin, feistel(place, F.lit(DAYS_A), F.lit(DAYS_B), key, "date").cast("int")), lambda to: text(x, to))

    def text(x: Column, to: Column) -> Column:
        sep = F.when(match.contains("/"), F.lit("/")).otherwise(F.lit("."))
        y, m, d = (F.date_format(to, p) for p in ("yyyy", "MM", "dd"))
        return F.when(match.rlike(r"^\d{4}-"), F.concat_ws("-", y, m, d)).when(x["american"], F.concat_ws("/", m, d, y)).otherwise(F.concat(d, sep, m, sep, y))

    return let(_day_of(match), lambda x: F.when(x["day"].isNotNull(), moved(x)).otherwise(match))


def _ip(match: Column, key: str) -> Column:
    octet = lambda i: F.get(F.split(match, r"\."), F.lit(i)).cast("long")
    value = ((octet(0) * 256 + octet(1)) * 256 + octet(2)) * 256 + octet(3)
    moved = feistel(value, F.lit(65536), F.lit(65536), key, "ip")
    at = lambda k: F.pmod(F.floor(moved / k).cast("long"), F.lit(256)).cast("string")
    return F.concat_ws(".", at(1 << 24), at(1 << 16), at(1 << 8), at(1))


def _remainder(code: Column) -> Column:
    """An IBAN's letters and digits as a number, modulo 97; letters count from 10."""
    digits = F.array_join(F.transform(F.split(code, ""), lambda c: F.when(c.rlike("^[A-Z]$"), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")
    return F.aggregate(F.split(digits, ""), F.lit(0), lambda r, c: F.pmod(r * 10 + F.coalesce(c.try_cast("int"), F.lit(0)), F.lit(97)))


def _is_iban(match: Column) -> Column:
    bare = F.replace(match, F.lit(" "), F.lit(""))
    return _remainder(F.concat(bare.substr(F.lit(5), F.length(bare)), bare.substr(F.lit(1), F.lit(4)))) == 1


def _iban(match: Column, key: str) -> Column:
    """Valid IBANs keep country and layout and get new digits and check digits; others keep their text."""
    bare = F.replace(match, F.lit(" "), F.lit(""))
    country, body = bare.substr(F.lit(1), F.lit(2)), bare.substr(F.lit(5), F.length(bare))
    digits = F.regexp_replace(body, "[^0-9]", "")
    first, rest = digits.substr(F.lit(1), F.lit(16)), digits.substr(F.lit(17), F.lit(30))
    moved = F.concat(
        F.when(F.length(first) > 0, permuted_digits(first, key, "iban")).otherwise(first),
        F.when(F.length(rest) > 0, permuted_digits(rest, key, "iban2")).otherwise(rest),
    )

    def checked(changed: Column) -> Column:
        check = F.lpad((98 - _remainder(F.concat(changed, country, F.lit("00")))).cast("string"), 2, "0")
        return _refill(match, F.concat(check, F.regexp_replace(changed, "[^0-9]", "")))

    return F.when(_is_iban(match), let(_refill(body, moved), checked)).otherwise(match)


def _email(match: Column, key: str) -> Column:
    """The name becomes letters of a keyed digest of the whole address; the domain becomes a reserved one."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(match)), 256)
    return F.concat(F.lit("user-"), F.translate(F.substring(digest, 1, 16), "0123456789", "ghijklmnop"), F.lit("@example.invalid"))


def kind_of(match: Column) -> Column:
    """The kind of a match of ``ANY``, by its shape."""
    return (
        F.when(match.contains("@"), "email")
        .when(match.rlike("^[A-Z]"), "iban")
        .when(match.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), "ip")
        .when(match.rlike(r"^\d{4}-\d{2}-\d{2}$|^\d{1,2}([./])\d{1,2}\1\d{4}$"), "date")
        .when(match.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(match.rlike(r"^[+(]|^\d{3}-\d{3}-\d{4}$"), "phone")
        .otherwise("number")
    )


def _phone(match: Column, key: str) -> Column:
    """The country code stays; all other digits are permuted together, those beyond 16 as a second block keyed by the first."""
    code = F.regexp_extract(match, r"^\+\d{1,3}(?=[ .(-])", 0)
    rest = match.substr(F.length(code) + 1, F.length(match))

    def moved(digits: Column) -> Column:
        first, last = digits.substr(F.lit(1), F.lit(16)), digits.substr(F.lit(17), F.lit(16))
        return F.concat(permuted_digits(first, key, "phone"), F.when(F.length(last) > 0, permuted_digits(last, key, F.concat(F.lit("phone2|"), first))).otherwise(last))

    return F.concat(code, _refill(rest, let(F.regexp_replace(rest, "[^0-9]", ""), moved)))


def pseudonym(match: Column, key: str) -> Column:
    return let(kind_of(match), lambda kind: _pseudonym(match, kind, key))


def _pseudonym(match: Column, kind: Column, key: str) -> Column:
    return (
        F.when(kind == "email", _email(match, key))
        .when(kind == "iban", _iban(match, key))
        .when(kind == "ip", _ip(match, key))
        .when(kind == "date", _date(match, key))
        .when(kind == "ssn", _refill(match, permuted_digits(F.regexp_replace(match, "[^0-9]", ""), key, "ssn")))
        .when(kind == "phone", _phone(match, key))
        .otherwise(_number(match, key))
    )


def is_private(match: Column) -> Column:
    """Whether a match passes the check of its kind; kinds without a check always do."""
    return let(kind_of(match), lambda kind: F.when(kind == "number", _is_card(match)).when(kind == "iban", _is_iban(match)).when(kind == "date", _day_of(match)["day"].isNotNull()).otherwise(True))


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced and ``n_private``, the number of values replaced.

    Numbers and dates are permuted within their format by a keyed Feistel
    network: equal values have equal pseudonyms in all documents and different
    values of a format have different ones. Luhn and IBAN check digits, valid
    dates, octets, separators and lengths stay right; long numbers, IBANs and
    dates that fail their check are no personal data and keep their text. Mail addresses get a keyed
    name at a reserved domain. Everything is built-in expressions, without a
    shuffle; each distinct value of a text is computed once.

    A null text stays null with 0 found; texts without such values are
    unchanged. Repeated rows give equal rows; an empty table gives no rows; a
    column ``n_private`` is replaced and other columns are kept.
    """
    found = F.regexp_extract_all(F.col(text), F.lit(f"({ANY})"), F.lit(1))
    docs = docs.drop("n_private").withColumn("n_private", F.when(F.col(text).rlike("[0-9@]"), F.coalesce(F.size(F.filter(found, is_private)), F.lit(0))).otherwise(0).cast("long"))
    names = F.transform(found, lambda m: pseudonym(m, key))
    between = F.split(F.col(text), ANY, -1)
    pieces = F.zip_with(between, names, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return docs.withColumn(text, F.when(F.col("n_private") > 0, F.array_join(pieces, "")).otherwise(F.col(text)))
