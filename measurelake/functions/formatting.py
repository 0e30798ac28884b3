"""Numbers as text, as native column expressions: fractions, scientific and spelled forms, and all notations of a value."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from measurelake.functions.text import bound, let

#: Largest denominator of a fraction; relative floor of errors; error up to which a notation stands for a value.
DENOMINATORS, EPSILON, THRESHOLD = 1000, 2.220446049250313e-16, 0.03
#: Moves that bring neighbours to the largest denominators, at most; from which size on doubles are no finer than 2.4e-7.
_STEPS, _COARSE = 40, 2.0**30
_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "zero ten twenty thirty forty fifty sixty seventy eighty ninety".split()
_GROUPS = ((12, "trillion"), (9, "billion"), (6, "million"), (3, "thousand"))


def relative_error(expected: Column, found: Column) -> Column:
    """Distance in shares of the expected value, whose size counts as EPSILON at least."""
    return F.abs(found - expected) / F.greatest(F.abs(expected), F.lit(EPSILON))


def _between(value: Column) -> Column:
    """Denominators of the two neighbours of a value among all fractions: the nearest one up to the value, and from it on.

    Starting with the whole numbers around the value, in turn one of the two moves towards the other as far as it stays on
    its side. So it takes as many steps as a continued fraction has terms, not one for each denominator.
    """
    f = F.abs(value).cast("double") - F.floor(F.abs(value))
    off = lambda p, q: F.abs(f * q - p)

    def step(s: Column) -> Column:
        times = F.floor(F.least(F.try_divide(off(s["p"], s["q"]), off(s["r"], s["s"])), (DENOMINATORS - s["q"]) / s["s"]))
        return let(times, lambda k: F.struct(s["r"].alias("p"), s["s"].alias("q"), (s["p"] + k * s["r"]).alias("r"), (s["q"] + k * s["s"]).alias("s")))

    def walked(f: Column) -> Column:
        start = F.struct(*(F.lit(v).alias(n) for n, v in (("p", 0.0), ("q", 1.0), ("r", 1.0), ("s", 1.0))))
        return F.aggregate(F.sequence(F.lit(1), F.lit(_STEPS)), start, lambda s, _: F.when(s["q"] + s["s"] > DENOMINATORS, s).otherwise(step(s)))

    return let(walked(f), lambda s: F.array(s["q"].cast("int"), s["s"].cast("int")))


@bound
def nearest_fraction(value: Column) -> Column:
    """struct<numerator, denominator>: the nearest fraction, of equally near ones that of the least denominator.

    It is one of the value's two neighbours, as others on their sides are off by a millionth more. Only where doubles are
    too coarse to tell that, every denominator is tried.
    """
    off = lambda d: F.round(F.abs(F.round(value * d) / d - value), 12)
    every = F.sequence(F.lit(1), F.lit(DENOMINATORS))
    tried = F.when(value.isNull() | (off(F.lit(1)) == 0), F.array(F.lit(1))).when(F.abs(value) < _COARSE, _between(value)).otherwise(every)
    each = F.transform(tried, lambda d: F.struct(off(d).alias("off"), d.alias("d")))
    return let(F.array_min(each)["d"], lambda d: F.struct(F.round(value * d).cast("long").alias("numerator"), d.cast("long").alias("denominator")))


def grouped(whole: Column, separator: str = "") -> Column:
    """A whole number with a separator between groups of three digits."""
    return F.replace(F.format_number(whole, 0), F.lit(","), F.lit(separator))


def fraction_text(value: Column, line: str = "/", separator: str = "") -> Column:
    """`3/4`; a whole number stands alone."""
    return let(nearest_fraction(value), lambda f: F.when(f["denominator"] == 1, grouped(f["numerator"], separator)).otherwise(F.concat(grouped(f["numerator"], separator), F.lit(line), grouped(f["denominator"], separator))))


def number_text(value: Column, base: str = "×10^", exponent: int = 0, spell: bool = False, separator: str = "", precision: int = 2, pad: int = 0, plus: bool = False) -> Column:
    """The value as a mantissa of `precision` decimals, and behind it a power of ten: `1.20×10^3`, `1.20e+03`, `1.20 thousand`.

    `pad` digits of exponent at least; with `spell` a power that has a word is written so. Without an exponent the
    mantissa stands alone; `plus` writes the sign of positive numbers.
    """
    mantissa = F.replace(F.format_number(value / F.lit(10.0**exponent), precision), F.lit(","), F.lit(separator))
    words = {p: w for p, w in _GROUPS} | {2: "hundred"}
    power = "" if not exponent else f" {words[exponent]}" if spell and exponent in words else f"{base}{'-' if exponent < 0 else '+' if plus and base.lower() == 'e' else ''}{abs(exponent):0{pad}d}"
    return F.concat(F.when(value > 0, "+").otherwise("") if plus else F.lit(""), mantissa, F.lit(power))


def _hundreds(n: Column, hyphen: str, link: str) -> Column:
    """Words of 1 to 999; an empty text for 0."""
    ones, tens = F.array(*map(F.lit, _ONES)), F.array(*map(F.lit, _TENS))
    low, high = (n % 100).cast("int"), F.floor(n / 100).cast("int")
    two = F.when(low < 20, F.get(ones, low)).otherwise(F.concat(F.get(tens, F.floor(low / 10).cast("int")), F.when(low % 10 > 0, F.concat(F.lit(hyphen), F.get(ones, low % 10))).otherwise("")))
    return F.concat_ws(" ", F.when(high > 0, F.concat(F.get(ones, high), F.lit(" hundred"))), F.when((high > 0) & (low > 0) & F.lit(bool(link)), link), F.when(low > 0, two))


def spelled(number: Column, hyphen: bool = True, link: bool = True, comma: bool = False) -> Column:
    """English words of a whole number below 10^15: with a hyphen in tens, an `and` behind hundreds, commas between groups."""
    h, a = "-" if hyphen else " ", "and" if link else ""

    def words(n: Column) -> Column:
        parts = [F.when(F.floor(n / 10**p) % 1000 > 0, F.concat(_hundreds(F.floor(n / 10**p) % 1000, h, a), F.lit(f" {w}"))) for p, w in _GROUPS]
        rest = n % 1000
        small = F.when((n >= 1000) & (rest > 0) & (rest < 100) & F.lit(link), F.concat(F.lit("and "), _hundreds(rest, h, a))).when(rest > 0, _hundreds(rest, h, a))
        joined = F.concat_ws(", " if comma else " ", *parts, small)
        return F.when(n == 0, "zero").otherwise(F.replace(joined, F.lit(", and "), F.lit(" and ")) if comma else joined)

    return let(F.abs(number).cast("long"), lambda n: F.concat(F.when(number < 0, "minus ").otherwise(""), words(n)))


def spellings(number: Column) -> Column:
    """All spellings over the options of `spelled`, each once."""
    return F.array_sort(F.array_distinct(F.array(*(spelled(number, *options) for options in product((True, False), repeat=3)))))


def notations(value: Column, exponents: tuple[int, ...] = (0, 3, 6), threshold: float = THRESHOLD) -> Column:
    """All digit notations whose own value is within `threshold` of this one, each once: bases, powers, words, groupings, decimals."""
    made = []
    for e, precision, separator in product(exponents, (0, 1, 2), ("", ",", " ")):
        close = relative_error(value, F.round(value / F.lit(10.0**e), precision) * F.lit(10.0**e)) <= threshold
        forms = [number_text(value, separator=separator, precision=precision)] if not e else [*(number_text(value, base, e, False, separator, precision, pad) for base in ("×10^", "*10^", "e") for pad in (0, 2)), number_text(value, exponent=e, spell=True, separator=separator, precision=precision)]
        made += [F.when(close, f) for f in forms]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*made))))


def split_exponent(code: Column) -> Column:
    """struct<unit, exponent> of a UCUM factor: cm2, s-1, m."""
    pattern = r"^(.*?)([-+]?\d+)?$"
    return F.struct(F.regexp_extract(code, pattern, 1).alias("unit"), F.coalesce(F.regexp_extract(code, pattern, 2).try_cast("int"), F.lit(1)).alias("exponent"))
