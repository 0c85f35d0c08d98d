"""Price expressions: six price patterns, option modifiers, formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as lex
from .text import extract_all, let, strip, strip_tags

PRICE_PATTERNS = [
    lex.PRICE_LABELLED,
    lex.PRICE_RANGE,
    lex.PRICE_SYMBOL,
    lex.PRICE_CODE,
    lex.PRICE_FROM,
    lex.PRICE_BASE,
]
# Which groups hold the amount and the symbol or code; the range pattern has two amounts.
CODE_LAST = {0, 3}
RANGE = 1

def amount(text: Column) -> Column:
    """Number in a price text, NULL when there is none ("," alone)."""
    # a cast of '' costs an exception, and most lines have no price
    return F.when(text != "", F.regexp_replace(text, r"[$€£¥₹,\s]", "").try_cast("double"))


def currency_of(mark: Column) -> Column:
    out = F.when(mark == lex.CURRENCY_OF[0][0], lex.CURRENCY_OF[0][1])
    for symbol, code in lex.CURRENCY_OF[1:]:
        out = out.when(mark == symbol, code)
    return out.otherwise("USD")


def symbol_of(currency: Column) -> Column:
    out = F.when(currency == lex.SYMBOL_OF[0][0], lex.SYMBOL_OF[0][1])
    for code, symbol in lex.SYMBOL_OF[1:]:
        out = out.when(currency == code, symbol)
    return out.otherwise("$")


def format_price(value: Column, currency: Column) -> Column:
    return F.concat(symbol_of(currency), F.format_number(value, 2), F.lit(" "), currency)


def format_fact(fact: Column, ranges: bool = True) -> Column:
    """Text of a price; a range shows both ends unless told otherwise."""
    single = format_price(fact["value"], fact["currency"])
    if not ranges:
        return single
    symbol = symbol_of(fact["currency"])
    both = F.concat(
        symbol, F.format_number(fact["value"], 2), F.lit(" - "),
        symbol, F.format_number(fact["max_price"], 2), F.lit(" "), fact["currency"],
    )
    return F.when(fact["max_price"].isNotNull(), both).otherwise(single)


def parse_match(match: Column, number: int) -> Column:
    """struct(value, currency, max_price, raw) for the matched text of a pattern.

    value is NULL when the text holds no number; only a range has max_price.
    """
    pattern = PRICE_PATTERNS[number]
    g1 = F.regexp_extract(match, pattern, 1)
    g2 = F.regexp_extract(match, pattern, 2)
    value, mark = (g1, g2) if number in CODE_LAST else (g2, g1)
    high = amount(F.regexp_extract(match, pattern, 3)) if number == RANGE else F.lit(None).cast("double")
    return F.struct(
        amount(value).alias("value"),
        currency_of(mark).alias("currency"),
        high.alias("max_price"),
        match.alias("raw"),
    )


def _parser(number: int):
    return lambda match: parse_match(match, number)


def _non_zero(facts: Column) -> Column:
    return F.filter(facts, lambda f: f["value"] > 0)


def first_price(text: Column) -> Column:
    """First match of the first pattern that gives a non-zero value."""
    tries = [
        let(F.regexp_extract(text, pattern, 0), _parser(number)) for number, pattern in enumerate(PRICE_PATTERNS)
    ]
    return F.get(_non_zero(F.array(*tries)), 0)


def all_prices(text: Column) -> Column:
    """Every match of every pattern, in pattern order then text order."""
    per_pattern = [
        F.transform(extract_all(text, pattern), _parser(number)) for number, pattern in enumerate(PRICE_PATTERNS)
    ]
    return _non_zero(F.concat(*per_pattern))


def explicit_base_price(text: Column) -> Column:
    def read(match: Column) -> Column:
        value = amount(F.regexp_extract(match, lex.PRICE_EXPLICIT_BASE, 2))
        code = F.regexp_extract(match, lex.PRICE_EXPLICIT_BASE, 3)
        by_symbol = currency_of(F.regexp_extract(match, lex.PRICE_EXPLICIT_BASE, 1))
        return F.struct(value.alias("value"), F.when(code != "", F.upper(code)).otherwise(by_symbol).alias("currency"))

    fact = let(F.regexp_extract(text, lex.PRICE_EXPLICIT_BASE, 0), read)
    return let(fact, lambda f: format_fact(f, ranges=False))


def plain_price(text: Column) -> Column:
    """Any price in a short text, formatted (a range shows its lower end)."""
    return let(first_price(text), lambda f: format_fact(f, ranges=False))


def page_price(text: Column) -> Column:
    return F.coalesce(explicit_base_price(text), let(first_price(text), format_fact))


def modifier_text(sign: Column, value: Column) -> Column:
    def write(v: Column) -> Column:
        digits = F.when(v % 1 == 0, F.format_number(v, 0)).otherwise(F.format_number(v, 2))
        return F.concat(F.when(sign == "-", "-").otherwise("+"), F.lit("$"), digits)

    return let(value, write)


def _has_symbol(text: Column) -> Column:
    """Cheap test before the option patterns, which all need a currency symbol."""
    return text.rlike("[$€£¥₹]")


def _clean_option_price(clean: Column) -> Column:
    def by(pattern: str, sign: Column | None, group: int) -> Column:
        found = amount(F.regexp_extract(clean, pattern, group))
        return modifier_text(F.lit("+") if sign is None else sign, found)

    return F.when(clean.rlike(lex.OPTION_FREE), "+$0").when(
        _has_symbol(clean),
        F.coalesce(
            by(lex.OPTION_PRICE_PAREN, F.regexp_extract(clean, lex.OPTION_PRICE_PAREN, 1), 3),
            by(lex.OPTION_PRICE_SIGNED, F.regexp_extract(clean, lex.OPTION_PRICE_SIGNED, 1), 3),
            by(lex.OPTION_PRICE_EXTRA, None, 2),
        ),
    )


def option_price(text: Column) -> Column:
    """Modifier text of an option ("+$120"); free or included gives "+$0"."""
    return let(strip_tags(text), _clean_option_price)


def _split_name_and_price(clean: Column) -> Column:
    parts = F.struct(
        F.regexp_extract(clean, lex.NAME_WITH_PRICE, 1).alias("paren_name"),
        F.regexp_extract(clean, lex.NAME_WITH_PRICE, 2).alias("sign"),
        amount(F.regexp_extract(clean, lex.NAME_WITH_PRICE, 4)).alias("paren"),
        F.regexp_extract(clean, lex.NAME_DASH_PRICE, 1).alias("dash_name"),
        amount(F.regexp_extract(clean, lex.NAME_DASH_PRICE, 2)).alias("dash"),
    )

    def choose(p: Column) -> Column:
        by_paren = p["paren"].isNotNull()
        signed = F.when(by_paren & (p["sign"] == "-"), -p["paren"]).otherwise(F.coalesce(p["paren"], p["dash"]))
        row = F.struct(
            strip(F.when(by_paren, p["paren_name"]).otherwise(p["dash_name"])).alias("name"),
            modifier_text(F.when(by_paren, p["sign"]).otherwise("+"), F.coalesce(p["paren"], p["dash"])).alias("price"),
            signed.alias("value"),
        )
        return F.when(by_paren | p["dash"].isNotNull(), row)

    return F.when(_has_symbol(clean), let(parts, choose))


def name_and_price(text: Column) -> Column:
    """struct(name, price, value) for "Name (+$n)" or "Name - $n", else NULL."""
    return let(strip_tags(text), _split_name_and_price)


def strip_title_price(title: Column) -> Column:
    out = title
    for pattern in lex.TITLE_PRICE_STRIPS:
        out = F.regexp_replace(out, pattern, "")
    out = F.regexp_replace(out, r"\s*[-–—|:]\s*$", "")
    return strip(F.regexp_replace(out, r"\s+", " "))


def modifier_value(price: Column) -> Column:
    """Signed number of a modifier text."""
    return amount(price)


