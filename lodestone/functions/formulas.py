"""Column functions on chemical formulas and labels, without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the halogens, and Roman numerals of coordination numbers
HALOGENS = ["F", "Cl", "Br", "I"]
ROMAN = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII", "XIII", "XIV", "XV", "XVI"]


def parts(formula: Column) -> Column:
    """An array of (symbol, amount) in the order of first mention: amount 1 where none is written, repeated symbols added up."""
    found = F.regexp_extract_all(formula, F.lit("[A-Z][a-z]?[0-9]*\\.?[0-9]*"), F.lit(0))
    each = F.transform(found, lambda x: F.struct(F.regexp_extract(x, "^[A-Za-z]+", 0).alias("symbol"), F.coalesce(F.nullif(F.regexp_extract(x, "[0-9.]+$", 0), F.lit("")).cast("double"), F.lit(1.0)).alias("amount")))
    symbols = F.array_distinct(F.transform(each, lambda x: x["symbol"]))
    total = lambda s: F.aggregate(F.filter(each, lambda x: x["symbol"] == s), F.lit(0.0), lambda acc, x: acc + x["amount"])
    return F.transform(symbols, lambda s: F.struct(s.alias("symbol"), total(s).alias("amount")))


def total(of: Column) -> Column:
    return F.aggregate(of, F.lit(0.0), lambda acc, x: acc + x["amount"])


def fractions(of: Column) -> Column:
    """Parts whose amounts sum to 1; none if the sum is not positive."""
    return F.when(total(of) > 0, F.transform(of, lambda x: F.struct(x["symbol"].alias("symbol"), (x["amount"] / total(of)).alias("amount"))))


def is_halogen(symbol: Column, halogens: list[str] | None = None) -> Column:
    """Whether it is one of the four halogens, or of ``halogens``."""
    return symbol.isin(halogens or HALOGENS)


def largest(of: Column, halogen: bool, halogens: list[str] | None = None) -> Column:
    """Symbol of the part with the largest amount among halogens or among all others; the first in order in ties."""
    some = F.filter(of, lambda x: is_halogen(x["symbol"], halogens) if halogen else ~is_halogen(x["symbol"], halogens))
    best = F.array_max(F.transform(some, lambda x: x["amount"]))
    return F.get(F.filter(some, lambda x: x["amount"] == best), F.lit(0))["symbol"]


def first(of: Column, halogen: bool, halogens: list[str] | None = None) -> Column:
    """Symbol of the first halogen or other part in token order."""
    return F.get(F.filter(of, lambda x: is_halogen(x["symbol"], halogens) if halogen else ~is_halogen(x["symbol"], halogens)), F.lit(0))["symbol"]


def rendered(of: Column) -> Column:
    """The formula of the parts: an amount of 1 is left out, whole amounts have no point."""
    number = lambda a: F.when(a == 1, "").when(a == F.floor(a), F.floor(a).cast("string")).otherwise(a.cast("string"))
    return F.array_join(F.transform(of, lambda x: F.concat(x["symbol"], number(x["amount"]))), "")


def reduced(of: Column) -> Column:
    """Parts with whole amounts divided by their greatest common divisor, by symbol; as they are if an amount is not whole."""
    whole = F.forall(of, lambda x: x["amount"] == F.floor(x["amount"]))
    divides = lambda k: F.forall(of, lambda x: x["amount"].cast("long") % k == 0)
    least = F.array_min(F.transform(of, lambda x: x["amount"])).cast("int")
    gcd = F.array_max(F.filter(F.sequence(F.lit(1), F.greatest(least, F.lit(1))), divides))
    each = F.transform(of, lambda x: F.struct(x["symbol"].alias("symbol"), F.when(whole, x["amount"] / gcd).otherwise(x["amount"]).alias("amount")))
    return F.array_sort(each)


def symbol(text: Column) -> Column:
    """Letters alone, the first in upper case and the others in lower case."""
    return F.initcap(F.regexp_replace(text, "[^A-Za-z]", ""))


def binary_halide(of: Column) -> Column:
    """Why a formula is no compound of one halogen and one other element: not_binary, no_hx or halogen_pair; null if it is one."""
    halogens = F.size(F.filter(of, lambda x: is_halogen(x["symbol"])))
    return F.when(F.size(of) != 2, "not_binary").when(halogens == 0, "no_hx").when(halogens == 2, "halogen_pair")


def from_letters(code: Column, width: int = 8) -> Column:
    """The number that a fixed-width id of the letters a to z (digits of base 26) stands for; null for any other text."""
    digits = F.transform(F.split(code, ""), lambda c: (F.ascii(c) - 97).cast("long"))
    return F.when(code.rlike(f"^[a-z]{{{width}}}$"), F.aggregate(digits, F.lit(0).cast("long"), lambda acc, x: acc * 26 + x))


def roman(number: Column) -> Column:
    """Roman numeral of 1 to 16; null for all others."""
    return F.when((number >= 1) & (number <= len(ROMAN)), F.get(F.array(*map(F.lit, ROMAN)), (number - 1).cast("int")))


def from_roman(text: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, ROMAN)), F.upper(F.trim(text)))
    return F.nullif(at, F.lit(0)).cast("int")


def looks_like_date(text: Column) -> Column:
    """Whether a spreadsheet made a date of a formula, as in 2-Feb."""
    return text.rlike("(?i)^[0-9]{1,2}-(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)$")


def of_file(name: Column) -> Column:
    """The formula before _mp- in the name of a file; null if there is none."""
    return F.nullif(F.regexp_extract(name, "^(.+?)_mp-", 1), F.lit(""))


def repaired(formula: Column, name: Column) -> Column:
    """The formula, or that of the file's name where it is missing or looks like a date."""
    bad = formula.isNull() | (F.trim(formula) == "") | looks_like_date(formula)
    return F.when(bad, of_file(name)).otherwise(formula)


def similarity(a: Column, b: Column) -> Column:
    """1 minus the edit distance over the longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def group_of(name: Column, groups: dict[str, str], other: str = "other") -> Column:
    """The group of the longest prefix in ``groups`` that a feature's name begins with."""
    out = F.lit(other)
    for prefix, group in sorted(groups.items(), key=lambda x: len(x[0])):
        out = F.when(name.startswith(prefix), group).otherwise(out)
    return out
