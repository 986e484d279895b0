"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Each kind of value is found by a pattern and checked (Luhn digit of payment cards, octets of
IPv4 addresses, real calendar dates, ...). A valid value is mapped by a keyed Feistel network
to another valid value of its own format: digits to digits, the check digit anew, dates to
dates. The network permutes the values of a format, so equal values get equal pseudonyms in all
documents and different values different ones. The format of mail boxes, host names and tokens is the
kind of each character (letter, digit, sign), which stays. The key is a parameter: the same key keeps
values linked over many runs, and without it the mapping can't be undone.

A text is split at the matches, the matches are mapped, and the two are put together
again. All of it is Column expressions; long texts are scanned once a pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: Rounds of the Feistel network.
ROUNDS = 8
#: Days that dates are permuted in: 1900-01-01 and so many after it.
DAYS = 73_049  # to 2099-12-31

# The patterns. Order matters: at one place the first that matches wins.
PATTERNS = {
    "email": r"[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ssn": r"(?<![\w.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "date": r"(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![\w/-]|\.[0-9])",
    "ip": r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])",
    "card": r"(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-]|\.[0-9])",
    "phone": r"(?<![\w.])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![\w-]|\.[0-9])|(?<![\w.])\+[0-9]{8,15}(?![\w-]|\.[0-9])",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{40}|[0-9A-F]{40}|[0-9a-f]{64}|[0-9a-f]{32})(?![0-9A-Za-z])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every match holds: texts without it are passed on as they are.
HINT = r"@[A-Za-z0-9]|[0-9][0-9 ()./-]{5}|[0-9a-f]{32}|[0-9A-F]{40}"


def _whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _round(key: str, kind: Column | str, r: Column, half: Column) -> Column:
    """60 pseudo-random bits from the key, the format, the round and the other half."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    text = F.concat_ws("|", F.lit(key), kind, r.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("bigint")


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), (n + 1).cast("int"), "0").cast("bigint")


def permute_digits(digits: Column, key: str, kind: Column | str) -> Column:
    """Keyed permutation of digit strings of each length from 2 to 36; one digit is shifted.

    The halves of an unbalanced network: rounds change them in turn, each by a
    function of the other, modulo its own power of ten.
    """
    n = F.length(digits)
    left = F.greatest(F.floor(n / 2), F.lit(0)).cast("int")
    right = (n - left).cast("int")
    kind = F.concat_ws(":", F.lit(kind) if isinstance(kind, str) else kind, n.cast("string"))
    a = F.when(left > 0, F.substring(digits, F.lit(1), left)).otherwise(F.lit("0")).cast("bigint")
    b = F.substring(digits, left + 1, right).cast("bigint")

    def step(x: Column, r: Column) -> Column:
        even = r % 2 == 0
        new_a = F.when(even & (left > 0), F.pmod(x["a"] + _round(key, kind, r, x["b"]) % _power(left), _power(left))).otherwise(x["a"])
        new_b = F.when(~even, F.pmod(x["b"] + _round(key, kind, r, x["a"]) % _power(right), _power(right))).otherwise(x["b"])
        return F.struct(new_a.alias("a"), new_b.alias("b"))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.alias("a"), b.alias("b")), step)
    joined = F.struct(done.alias("x"))["x"]
    return F.concat(
        F.when(left > 0, F.lpad(joined["a"].cast("string"), left, "0")).otherwise(F.lit("")),
        F.lpad(joined["b"].cast("string"), right, "0"),
    )


def permute_number(n: Column, size: int, key: str, kind: str) -> Column:
    """Keyed permutation of 0..size-1: a network on ceil(sqrt(size))**2 values, walked until inside."""
    side = int(size**0.5)
    while side * side < size:
        side += 1

    def once(v: Column) -> Column:
        def step(x: Column, r: Column) -> Column:
            return F.struct(x["b"].alias("a"), F.pmod(x["a"] + _round(key, kind, r, x["b"]) % side, F.lit(side).cast("bigint")).alias("b"))

        start = F.struct(F.floor(v / side).cast("bigint").alias("a"), F.pmod(v, F.lit(side)).cast("bigint").alias("b"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda x: x["a"] * side + x["b"])

    # The walk leaves the range with probability below 2 / side a step: 12 steps are ample, and
    # the last resort is the value itself, whose own walk no other value ends in.
    def walk(x: Column, _: Column) -> Column:
        return F.when(x < 0, once(-x - 1)).otherwise(x)

    def marked(x: Column, i: Column) -> Column:
        new = walk(x, i)
        return F.when((x < 0) & (new >= size), -new - 1).otherwise(new)

    return F.aggregate(F.sequence(F.lit(1), F.lit(12)), -n.cast("bigint") - 1, marked, lambda x: F.when(x < 0, n).otherwise(x))


def _luhn_sum(digits: Column, last_counts: bool) -> Column:
    """Luhn sum; ``last_counts``: the last digit is the check digit."""
    at = F.split(F.reverse(digits), "")
    start = 0 if last_counts else 1

    def value(x: Column, i: Column) -> Column:
        v = x.cast("int")
        double = v * 2 - F.when(v > 4, 9).otherwise(0)
        return F.when((i + start) % 2 == 1, double).otherwise(v)

    return F.aggregate(F.transform(F.filter(at, lambda x: x != ""), value), F.lit(0), lambda a, x: a + x)


def _refill(value: Column, new: Column) -> Column:
    """The value's own separators around the new digits."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")

    def step(x: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        return F.struct(F.concat(x["s"], F.when(digit, F.substring(new, x["i"], F.lit(1))).otherwise(c)).alias("s"), (x["i"] + F.when(digit, 1).otherwise(0)).alias("i"))

    return F.aggregate(chars, F.struct(F.lit("").alias("s"), F.lit(1).alias("i")), step, lambda x: x["s"])


def _card(v: Column, key: str) -> Column:
    d = _digits(v)
    ok = (_luhn_sum(d, True) % 10 == 0) & ~d.rlike("^0+$")
    body = permute_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
    new = F.transform(F.array(body), lambda b: F.concat(b, F.pmod(10 - _luhn_sum(b, False) % 10, F.lit(10)).cast("string")))[0]
    return F.when(ok, _refill(v, new)).otherwise(v)


def _ip(v: Column, key: str) -> Column:
    parts = F.split(v, r"\.")
    ok = ~F.exists(parts, lambda x: (x.cast("int") > 255) | x.rlike("^0[0-9]"))
    number = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, x: a * 256 + x.cast("bigint"))

    def step(x: Column, r: Column) -> Column:
        return F.struct(x["b"].alias("a"), F.pmod(x["a"] + _round(key, "ip", r, x["b"]), F.lit(65536).cast("bigint")).alias("b"))

    start = F.struct(F.floor(number / 65536).cast("bigint").alias("a"), F.pmod(number, F.lit(65536)).cast("bigint").alias("b"))
    new = F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step,
        lambda x: F.concat_ws(".", F.floor(x["a"] / 256).cast("string"), (x["a"] % 256).cast("string"), F.floor(x["b"] / 256).cast("string"), (x["b"] % 256).cast("string")),
    )
    return F.when(ok, new).otherwise(v)


def _date(v: Column, key: str) -> Column:
    def mapped(pattern: str, format_: str) -> Column:
        # A date is real if its format gives it back; 31/12 and 12/31 orders are told apart by that, day first.
        day = F.try_to_timestamp(v, F.lit(format_)).cast("date")
        number = F.date_diff(day, F.lit("1900-01-01").cast("date"))
        new = F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), permute_number(number, DAYS, key, "date").cast("int")), format_)
        return F.when(v.rlike(pattern) & day.isNotNull() & (number >= 0) & (number < DAYS), new)

    return F.coalesce(
        mapped(r"^[0-9]{4}-", "yyyy-MM-dd"), mapped(r"^[0-9]{2}\.", "dd.MM.yyyy"), mapped(r"^[0-9]{2}/", "dd/MM/yyyy"), mapped(r"^[0-9]{2}/", "MM/dd/yyyy"), v
    )


def _ssn(v: Column, key: str) -> Column:
    """Area 001-899 without 666, group 01-99, serial 0001-9999, as one number."""
    area, group, serial = (F.substring(v, at, n).cast("bigint") for at, n in ((1, 3), (5, 2), (8, 4)))
    number = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1
    new = F.transform(F.array(permute_number(number, 898 * 99 * 9999, key, "ssn")), lambda n: F.struct(F.floor(n / (99 * 9999)).alias("a"), F.pmod(F.floor(n / 9999), F.lit(99)).alias("g"), F.pmod(n, F.lit(9999)).alias("s")))[0]
    text = F.concat_ws(
        "-",
        F.lpad((new["a"] + F.when(new["a"] >= 665, 2).otherwise(1)).cast("string"), 3, "0"),
        F.lpad((new["g"] + 1).cast("string"), 2, "0"),
        F.lpad((new["s"] + 1).cast("string"), 4, "0"),
    )
    return F.when(~v.rlike("^(000|666|9..)|-00-|-0000$"), text).otherwise(v)


def _phone(v: Column, key: str) -> Column:
    """The digits after a country code; a number of another length is another format."""
    head = F.regexp_extract(v, r"^(\+[0-9]{1,3}[ .-](?=.))?", 1)
    rest = F.when(F.length(head) > 0, F.substring(v, F.length(head) + 1, F.length(v))).otherwise(v)
    d = _digits(rest)
    ok = (F.length(d) >= 7) & (F.length(d) <= 15)
    return F.when(ok, F.concat(head, _refill(rest, permute_digits(d, key, F.concat(F.lit("phone"), head))))).otherwise(v)


def _alphabet(c: Column, by: Column) -> Column:
    """A digit or small letter moved on by so many places among its kind; other characters stay."""
    return (
        F.when(c.rlike("[0-9]"), F.chr(F.pmod(F.ascii(c) - 48 + by, F.lit(10)) + 48))
        .when(c.rlike("[a-z]"), F.chr(F.pmod(F.ascii(c) - 97 + by, F.lit(26)) + 97))
        .otherwise(c)
    )


def _hexadecimal(c: Column, by: Column) -> Column:
    at = F.instr(F.lit("0123456789abcdef"), c) - 1
    return F.substring(F.lit("0123456789abcdef"), F.pmod(at + by, F.lit(16)) + 1, F.lit(1))


def permute_characters(v: Column, key: str, kind: str, moved=_alphabet) -> Column:
    """Keyed permutation of the strings of one pattern of kinds of characters (small letters, digits, others as they are).

    The halves change in turn, each character by a place of its own in a digest of the other half.
    """
    half = F.floor(F.length(v) / 2).cast("int")
    pattern = F.regexp_replace(F.regexp_replace(v, "[a-z]", "a"), "[0-9]", "0") if moved is _alphabet else F.length(v).cast("string")

    def shifted(mine: Column, other: Column, r: Column) -> Column:
        stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), pattern, r.cast("string"), other).cast("binary"), 512)
        by = lambda i: F.conv(F.substring(stream, F.pmod(i, F.lit(63)) * 2 + 1, F.lit(2)), 16, 10).cast("int") + i
        chars = F.filter(F.split(mine, ""), lambda c: c != "")
        return F.concat_ws("", F.transform(chars, lambda c, i: moved(c, by(i))))

    def step(x: Column, r: Column) -> Column:
        even = r % 2 == 0
        a = F.when(even, shifted(x["a"], x["b"], r)).otherwise(x["a"])
        b = F.when(even, x["b"]).otherwise(shifted(x["b"], x["a"], r))
        return F.struct(a.alias("a"), b.alias("b"))

    start = F.struct(F.substring(v, F.lit(1), half).alias("a"), F.substring(v, half + 1, F.length(v)).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda x: F.concat(x["a"], x["b"]))


def _cased(v: Column, new: Column) -> Column:
    """``new`` with capitals where ``v`` has them."""
    split = lambda t: F.filter(F.split(t, ""), lambda c: c != "")
    both = F.zip_with(split(v), split(new), lambda old, c: F.when(old.rlike("[A-Z]"), F.upper(c)).otherwise(c))
    return F.when(v.rlike("[A-Z]"), F.concat_ws("", both)).otherwise(new)


def _email(v: Column, key: str) -> Column:
    """The mail box gets a pseudonym; the host stays only if it is one for examples. Capitals link with small letters."""
    box, host = F.regexp_extract(v, "^(.*)@", 1), F.regexp_extract(v, "@(.*)$", 1)
    name = F.regexp_extract(host, r"^(.*)\.[^.]+$", 1)
    ending = F.regexp_extract(host, r"(\.[^.]+)$", 1)
    new = _cased(box, permute_characters(F.lower(box), key, "box"))
    hidden = _cased(name, permute_characters(F.lower(name), key, "host"))
    return F.concat(new, F.lit("@"), F.when(name.rlike(r"(^|\.)example$"), name).otherwise(hidden), ending)


def _secret(v: Column, key: str) -> Column:
    """Hexadecimal digits to hexadecimal digits of the same length."""
    new = permute_characters(F.lower(v), key, "secret", _hexadecimal)
    return F.when(v.rlike("[A-F]"), F.upper(new)).otherwise(new)


def _iban(v: Column, key: str) -> Column:
    """Digits after the check digits are permuted, and the check digits made anew."""
    plain = F.regexp_replace(v, " ", "")

    def modulo(text: Column) -> Column:
        chars = F.filter(F.split(text, ""), lambda c: c != "")
        value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return F.aggregate(chars, F.lit(0), lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)

    turned = lambda t: F.concat(F.substring(t, F.lit(5), F.length(t)), F.substring(t, 1, 4))
    ok = (modulo(turned(plain)) == 1) & (F.length(plain) >= 15)
    body = F.substring(plain, F.lit(5), F.length(plain))
    head = F.substring(plain, 1, 2)
    new = _refill(body, permute_digits(_digits(body), key, F.concat(F.lit("iban"), head)))
    full = F.transform(F.array(new), lambda b: F.concat(F.lpad((98 - modulo(F.concat(b, head, F.lit("00")))).cast("string"), 2, "0"), _digits(b)))[0]
    return F.when(ok & (F.length(_digits(body)) >= 2), _refill(v, full)).otherwise(v)


_MAPPED = {"email": _email, "iban": _iban, "ssn": _ssn, "date": _date, "ip": _ip, "card": _card, "phone": _phone, "secret": _secret}


def kind_of(v: Column) -> Column:
    """The first kind whose pattern the whole value has."""
    found = F.lit(None).cast("string")
    for kind in reversed(PATTERNS):
        # The look-arounds hold where the value was found; alone they see its ends only.
        found = F.when(v.rlike(_whole(PATTERNS[kind])), F.lit(kind)).otherwise(found)
    return found


def pseudonym(v: Column, key: str) -> Column:
    """A found value's pseudonym; an invalid value stays as it is."""
    kind = kind_of(v)
    out = v
    for name, mapped in _MAPPED.items():
        out = F.when(kind == name, mapped(v, key)).otherwise(out)
    return out


def _between(text: Column) -> Column:
    return F.split(text, ANY, -1)


def _found(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def pseudonyms(docs: DataFrame, key: str = "tally", text: str = "text", found: str = "pii_found", changed: str = "pii_changed") -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and two columns behind its own: values found, and values replaced.

    A null text stays null, with counts of 0; texts without personal data stay as they are, and invalid
    values (a card number with a wrong check digit, an octet over 255) too. All other columns and
    repeated rows stay. Where ``docs`` has a column of the name ``found`` or ``changed``, the new one gets a number behind its name.
    An empty table gives an empty one.
    """
    has = F.coalesce(F.col(text).rlike(HINT), F.lit(False))
    values = F.when(has, _found(F.col(text))).otherwise(F.array().cast("array<string>"))
    # Values are mapped on rows of their own columns, so that each expression is computed once.
    old, mapped = free_name(docs.columns, "pii_values"), free_name(docs.columns, "pii_new")
    out = docs.withColumn(old, values)
    new = F.transform(F.col(old), lambda v: pseudonym(v, key))
    out = out.withColumn(mapped, F.when(F.size(old) > 0, new).otherwise(F.array().cast("array<string>")))
    parts = F.zip_with(_between(F.col(text)), F.concat(F.col(mapped), F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    hidden = F.when(F.size(old) > 0, F.concat_ws("", parts)).otherwise(F.col(text))
    count = F.size(F.filter(F.zip_with(old, mapped, lambda a, b: a != b), lambda x: x))
    out = out.withColumn(text, hidden).withColumn(free_name(docs.columns, found), F.size(old)).withColumn(free_name(docs.columns, changed), count)
    return out.drop(old, mapped)
