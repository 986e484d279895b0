"""Money and figures as text, and text as money: Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Symbols and minor units.
SYMBOLS = {"usd": "$", "eur": "€", "gbp": "£", "jpy": "¥"}
MINOR = {"jpy": 0, "krw": 0, "kwd": 3, "bhd": 3}
SCALES = {"k": 3, "thousand": 3, "m": 6, "mm": 6, "million": 6, "b": 9, "bn": 9, "billion": 9}


def money(value: Column, symbol: str = "$", decimals: int = 0) -> Column:
    """Grouped digits with the symbol; negatives in parentheses."""
    x = value.cast("decimal(38,10)")
    body = F.concat(F.lit(symbol), F.format_number(F.abs(F.round(x, decimals)), decimals))
    return F.when(F.round(x, decimals) < 0, F.concat(F.lit("("), body, F.lit(")"))).otherwise(body)


def compact(value: Column, symbol: str = "$") -> Column:
    """With K, M or B from a thousand on, one decimal."""
    x = value.cast("decimal(38,10)")
    size = F.abs(x)
    out = F.format_number(F.round(size, 0), 0)
    for power, letter in ((3, "K"), (6, "M"), (9, "B")):
        # What would be shown as 1,000 of the smaller unit is 1 of this one.
        shown = F.round(size / 10 ** (power - 3), 1 if power > 3 else 0) >= 1000
        out = F.when(shown, F.concat(F.format_number(F.round(size / 10**power, 1), 1), F.lit(letter))).otherwise(out)
    return F.when(x < 0, F.concat(F.lit(f"({symbol}"), out, F.lit(")"))).otherwise(F.concat(F.lit(symbol), out))


def figure(value: Column, unit: Column) -> Column:
    """A figure by its unit: pct, ratio, count, days, else money."""
    x = value.cast("decimal(38,10)")
    return (
        F.when(unit == "pct", F.concat(F.format_number(F.round(x * 100, 1), 1), F.lit("%")))
        .when(unit == "ratio", F.concat(F.format_number(F.round(x, 1), 1), F.lit("x")))
        .when(unit == "count", F.format_number(F.round(x, 0), 0))
        .when(unit == "days", F.concat(F.format_number(F.round(x, 0), 0), F.lit(" days")))
        .otherwise(money(value))
    )


# Currency codes and signs that may stand before or behind an amount.
CODES = "usd|eur|gbp|jpy|chf|cad|aud|krw|kwd|bhd"
_SIGNS = "".join(SYMBOLS.values())
_AMOUNT = rf"^(\()?\s*([-−])?\s*(?:(?:{CODES})\s*|us)?(?:[{_SIGNS}]\s*)?([-−])?\s*((?:[0-9]{{1,3}}(?:,[0-9]{{3}})+|[0-9]+)(?:\.[0-9]+)?|\.[0-9]+)\s*({'|'.join(sorted(SCALES, key=len, reverse=True))})?\s*(?:{CODES}|[{_SIGNS}])?\s*(\))?$"


def parse_money(text: Column) -> Column:
    """The value of text such as ``($1,204.50)``, ``EUR 3.2m`` or ``12 million``; null if the whole text isn't one."""
    t = F.lower(F.trim(text))
    part = lambda i: F.regexp_extract(t, _AMOUNT, i)
    ok = t.rlike(_AMOUNT) & ((part(1) == "") == (part(6) == ""))
    power = F.lit(0)
    for name, p in SCALES.items():
        power = F.when(part(5) == name, p).otherwise(power)
    number = F.when(ok, F.regexp_replace(part(4), ",", "")).cast("decimal(28,6)")
    value = number * F.pow(F.lit(10), power).cast("decimal(10,0)")
    negative = (part(1) != "") | (part(2) != "") | (part(3) != "")
    return F.when(ok, F.when(negative, -value).otherwise(value)).cast("double")


def months_elapsed(start: Column, at: Column) -> Column:
    """Months from start to at by month boundaries, the first one counted; not below 0."""
    return F.greatest(F.lit(0), (F.year(at) - F.year(start)) * 12 + F.month(at) - F.month(start) + 1)


def carrying_amount(amount: Column, start: Column, months: int, at: Column) -> Column:
    """What is left of an amount written off in a straight line; what is written off so far is rounded to the cent."""
    value = amount.cast("decimal(18,6)")
    gone = F.round(value * F.least(F.lit(months), months_elapsed(start, at)) / F.lit(months), 2)
    return F.round(value - gone, 2)
