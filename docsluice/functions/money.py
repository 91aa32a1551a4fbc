"""Amounts of money: parsing, and whole amounts in Russian words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsluice.functions import text as tx
from docsluice.functions.patterns import extract, matches, replace_all

# How amounts and currencies are written, and the words of numbers.
AMOUNT = r"(?:\d{1,3}(?:\s\d{3})+(?:[.,]\d{1,2})?|\d+(?:[.,]\d{1,2})?)"
CURRENCY_AFTER = r"(?:BYN|руб\.?|бел\.?\s*руб|Br|USD|US\$|\$|EUR|€|евро|CNY|CN¥|юан|юаней|RUB|российск\w*\s*руб|₽)"
CURRENCY_BEFORE = r"(?:USD|US\$|\$|EUR|€)"
BYN_AFTER = r"(?:BYN|руб\.?|бел\.?\s*руб|Br)"
MAJOR_CURRENCY = r"(?:BYN|бел\.?\s*руб\w*|белорусск\w*\s*руб\w*|руб\.?|₽|RUB)"
ONES_M = ["", "один", "два", "три", "четыре", "пять", "шесть", "семь", "восемь", "девять"]
ONES_F = ["", "одна", "две", "три", "четыре", "пять", "шесть", "семь", "восемь", "девять"]
TENS = ["", "", "двадцать", "тридцать", "сорок", "пятьдесят", "шестьдесят", "семьдесят", "восемьдесят", "девяносто"]
TEENS = [
    "десять", "одиннадцать", "двенадцать", "тринадцать", "четырнадцать",
    "пятнадцать", "шестнадцать", "семнадцать", "восемнадцать", "девятнадцать",
]
HUNDREDS = ["", "сто", "двести", "триста", "четыреста", "пятьсот", "шестьсот", "семьсот", "восемьсот", "девятьсот"]
GROUPS = [
    ("миллиард", "миллиарда", "миллиардов"),
    ("миллион", "миллиона", "миллионов"),
    ("тысяча", "тысячи", "тысяч"),
    ("белорусский рубль", "белорусских рубля", "белорусских рублей"),
]
ZERO = "ноль белорусских рублей"


def to_number(c: Column) -> Column:
    """A matched amount as a double: grouping dropped, decimal comma read as a point."""
    return F.replace(replace_all(c, r"\s", ""), F.lit(","), F.lit(".")).try_cast("double")


def line_amount(line: Column, dialect: str = "intended") -> Column:
    """First amount of a line with its currency behind it, else before it."""
    tail = extract(line, rf"(?<![\d.,])({AMOUNT})\s*{CURRENCY_AFTER}(?!\w)", dialect=dialect)
    head = extract(line, rf"(?<!\w){CURRENCY_BEFORE}\s*({AMOUNT})(?![\d])", dialect=dialect)
    return F.coalesce(to_number(tail), to_number(head))


def byn_amount(line: Column, dialect: str = "intended") -> Column:
    return to_number(extract(line, rf"(?<![\d.,])({AMOUNT})\s*{BYN_AFTER}(?!\w)", dialect=dialect))


def parse_money(c: Column) -> Column:
    """A whole text as an amount: grouping blanks, decimal comma, thousand or million, currency; NULL otherwise."""
    shape = r"^([\d ]+)(?:[.,](\d{1,2}))?\s*(тыс\.?|млн\.?)?$"

    def parsed(flat: Column) -> Column:
        whole = F.replace(extract(flat, shape, 1), F.lit(" "), F.lit(""))
        fraction, scale = extract(flat, shape, 2), extract(flat, shape, 3)
        number = F.concat(whole, F.coalesce(F.concat(F.lit("."), fraction), F.lit(""))).try_cast("double")
        factor = tx.let(scale, lambda s: F.when(matches(s, "млн"), 1_000_000).when(matches(s, "тыс"), 1000).otherwise(1))
        return number * factor

    return tx.let(tx.collapse_ws(replace_all(tx.js_trim(c), rf"\s*{MAJOR_CURRENCY}\s*$", "")), parsed)


def plural_ru(n: Column, forms: tuple[str, str, str]) -> Column:
    """one, few or many by the last digits."""
    last, two = n % 10, n % 100
    return (
        F.when((two >= 11) & (two <= 14), forms[2]).when(last == 1, forms[0])
        .when((last >= 2) & (last <= 4), forms[1]).otherwise(forms[2])
    )


def _word(words: list[str], at: Column) -> Column:
    return F.nullif(F.element_at(F.array(*map(F.lit, words)), at.cast("int") + 1), F.lit(""))


def _triplet(n: Column, feminine: bool) -> Column:
    tens, ones = F.floor(n / 10) % 10, n % 10
    teen = tens == 1
    return F.concat_ws(
        " ",
        _word(HUNDREDS, F.floor(n / 100)),
        F.when(teen, _word(TEENS, ones)).otherwise(_word(TENS, tens)),
        F.when(~teen, _word(ONES_F if feminine else ONES_M, ones)),
    )


def amount_words(n: Column) -> Column:
    """A whole amount in words, up to 999 billion; higher groups are left out; '' for a negative or missing one."""
    x = F.floor(n).cast("bigint")
    parts = []
    for i, forms in enumerate(GROUPS):
        group = F.floor(x / F.lit(1000 ** (3 - i))).cast("bigint") % 1000 if i < 3 else x % 1000
        said = F.concat_ws(" ", _triplet(group, i == 2), plural_ru(group, forms))
        empty = F.lit(GROUPS[3][2]) if i == 3 else F.lit(None)
        parts.append(F.when(group > 0, said).otherwise(empty))
    return F.when(x == 0, ZERO).when(x > 0, F.concat_ws(" ", *parts)).otherwise("")
