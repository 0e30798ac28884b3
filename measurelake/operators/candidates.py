"""Readings of a quantity span: tokens, the roles each may have, and a ranking of all combinations; native columns.

A reading is a text with one letter for each token: n number, u unit, m modifier, e uncertainty, s blank, and the
separators r range, l list, x dimensions, q ratio. So combining, cutting and ranking are patterns over short texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from measurelake.functions import lexicon
from measurelake.functions.numbers import str2num
from measurelake.functions.text import let, normalize_quantity, trie

#: Readings of a span, at most; a span with more is not read.
MOST = 4096
TYPES = {"": "single_quantity", "r": "range", "l": "list", "x": "multidim", "q": "ratio"}
_WORDS = [*lexicon.NUMBER_WORDS, *lexicon.MAGNITUDES, *lexicon.STANDALONE]
_PHRASES = [*lexicon.PREFIXED_MODIFIERS, *lexicon.SUFFIXED_MODIFIERS, *lexicon.IMPRECISE_QUANTITIES, *_WORDS, *lexicon.RATIO_SEPARATORS]
_NUMBER = r"\d+(?:[.,' ]\d{3}(?!\d))*(?:[.,]\d+)?(?: ?\* ?10\^[-+]?\d+|\^[-+]?\d+|/\d+)?"
_TOKEN = rf"(\s+|± ?{_NUMBER}|{_NUMBER}|(?<![A-Za-z])(?:{trie([p for p in _PHRASES if p[0].isalnum()])})(?![A-Za-z])|-{{1,3}}|[A-Za-zµμ°%$€£¥]+(?:\^-?\d|(?<=[a-z]) -\d(?!\d))?|.)"
_SEGMENT = "m*u*m*n+e*u*m*"
_SEPARATED = f"^{_SEGMENT}(?:[rlxq]{_SEGMENT})*$"


def tokens(text: Column) -> Column:
    """All of a text in order: phrases of the lexicon whole, numbers, blanks, dashes, words, and single other characters.

    A text that comes out as a single token without a digit is cut at its word borders instead.
    """

    def made(found: Column) -> Column:
        return F.when((F.size(found) == 1) & ~text.rlike(r"\d"), F.filter(F.split(text, r"\b"), lambda t: t != "")).otherwise(found)

    return let(F.regexp_extract_all(text, F.lit("(?i)" + _TOKEN), F.lit(1)), made)


def _one_of(terms: list[str] | tuple[str, ...]) -> str:
    return f"(?i)^(?:{trie(terms)})$"


def roles(found: Column) -> Column:
    """For each token the letters of the roles it may have, in order of preference; neighbours count past blanks."""
    is_number = lambda t: F.coalesce(t.rlike(rf"^{_NUMBER}$") | t.rlike(_one_of([*_WORDS, *lexicon.IMPRECISE_QUANTITIES])), F.lit(False))

    def role(x: Column, t: Column, i: Column) -> Column:
        known = lambda marks, k: F.coalesce(F.get(marks, k), F.lit(False))
        numeric = lambda k: known(x["numbers"], k)
        back, on = i - F.when((i > 1) & known(x["blanks"], i - 1), 2).otherwise(1), i + F.when(known(x["blanks"], i + 1), 2).otherwise(1)
        between = numeric(back) & numeric(on)
        before = F.when(i == 0, "").otherwise(F.get(found, back))
        cut = lambda letter, other: F.when(between, F.array(*map(F.lit, letter + other))).otherwise(F.array(*map(F.lit, (other or "") + letter)))
        return (
            F.when(F.get(x["blanks"], i), F.array(F.lit("s")))
            .when(t.rlike("^±"), F.array(F.lit("e")))
            .when(t.rlike("(?i)^an?$"), F.array(F.lit("n"), F.lit("m")))
            .when(t.rlike(r"^(?:19|20)\d\d$") & before.rlike("[$€£¥]$"), F.array(F.lit("u"), F.lit("n")))
            .when(t.rlike(_one_of(lexicon.ALSO_UNITS)) & numeric(back), F.array(F.lit("u"), F.lit("n")))
            .when(numeric(i), F.array(F.lit("n")))
            .when(t.rlike("^-+$"), F.when(between, F.array(F.lit("r"), F.lit("m"))).otherwise(F.array(F.lit("m"), F.lit("r"))))
            .when(t.rlike("(?i)^to$"), F.array(F.lit("r")))
            .when(t.rlike(_one_of(lexicon.LIST_SEPARATORS)), F.array(F.lit("l")))
            .when(t.rlike(_one_of(lexicon.MULTIDIM_SEPARATORS)), cut("x", "u"))
            .when(t.rlike(_one_of(lexicon.RATIO_SEPARATORS)), cut("q", "u"))
            .when(t.rlike("(?i)^(?:min|max)$"), F.when(numeric(back), F.array(F.lit("u"), F.lit("m"))).otherwise(F.array(F.lit("m"), F.lit("u"))))
            .when(t.rlike(_one_of([*lexicon.PREFIXED_MODIFIERS, *lexicon.SUFFIXED_MODIFIERS])), F.array(F.lit("m")))
            .otherwise(F.array(F.lit("u")))
        )

    # what a token's neighbours ask of it is found once
    marks = F.struct(F.transform(found, is_number).alias("numbers"), F.transform(found, lambda t: t.rlike(r"^\s+$")).alias("blanks"))
    return let(marks, lambda x: F.transform(found, lambda t, i: role(x, t, i)))


def readings(options: Column) -> Column:
    """Every combination of roles, the preferred ones first; null if there are more than MOST.

    Two range separators in a row make no sense, and where a ratio stands between numbers a unit is no other reading.
    """
    count = F.aggregate(options, F.lit(1).cast("long"), lambda a, o: F.least(a * F.size(o), F.lit(MOST + 1).cast("long")))
    every = F.aggregate(options, F.array(F.lit("")), lambda a, o: F.flatten(F.transform(a, lambda p: F.transform(o, lambda x: F.concat(p, x)))))
    ratios = lambda kept: F.transform(F.filter(kept, lambda r: r.contains("q")), lambda r: F.translate(r, "q", "u"))
    sound = lambda e: let(F.filter(e, lambda r: ~r.rlike("rs?r")), lambda kept: let(ratios(kept), lambda as_unit: F.filter(kept, lambda r: ~F.array_contains(as_unit, r))))
    return F.when(count <= MOST, let(every, sound))


def _kind(reading: Column) -> Column:
    marks = F.regexp_replace(reading, "[^rlxq]", "")
    named = F.create_map(*(F.lit(x) for kv in TYPES.items() for x in kv))
    return F.when(marks.rlike(r"^(?:(.)\1*)?$"), F.element_at(named, F.left(marks, F.lit(1)))).otherwise("unknown")


def ranked(df: DataFrame, found: str, every: str, out: str) -> DataFrame:
    """`df` with `out`: of the readings in `every` the one that stands after all rules; null if there is none.

    Each rule only holds if it leaves a reading. In order: whole segments of a known type, or else one of both; no
    range whose first part has a unit while the last is a bare small number; no single quantity beside a dash range; of
    a range that falls the other readings, and beside one that rises no single quantity; three dimensions; the fewest
    quantities; the first.
    """
    values = unused_name(df, "__values")
    work = unused_name(df, "__readings")
    size = lambda r, letters: F.length(F.regexp_replace(r, f"[^{letters}]", ""))
    close = lambda r: F.translate(r, "s", "")
    first = lambda r: F.get(values, F.length(F.regexp_extract(r, "^([^n]*)n", 1)))
    last = lambda r: F.get(values, F.length(F.regexp_extract(r, "^(.*)n", 1)))
    tier = lambda r: F.when(close(r).rlike(_SEPARATED), 0).otherwise(2) + F.when(_kind(r) == "unknown", 1).otherwise(0)
    small = lambda r: F.coalesce((last(r) == F.floor(last(r))) & (F.abs(last(r)) < 10), F.lit(False))
    dash = lambda r: (_kind(r) == "range") & F.coalesce(F.get(found, F.length(F.regexp_extract(r, "^([^r]*)r", 1))).rlike("^-+$"), F.lit(False))
    falls = lambda r: (_kind(r) == "range") & F.coalesce(first(r) > last(r), F.lit(False))
    single = lambda r: _kind(r) == "single_quantity"
    rs = F.col(work)
    which = lambda rule: F.filter(rs, rule)
    least = lambda key: let(F.transform(rs, key), lambda keys: let(F.array_min(keys), lambda low: F.filter(rs, lambda _, i: F.get(keys, i) == low)))
    no_single_beside = lambda other: let(F.exists(rs, other), lambda there: F.filter(rs, lambda r: ~(single(r) & there)))
    rules = [
        least(tier),
        which(lambda r: ~((_kind(r) == "range") & close(r).rlike("nu+r[^u]*n$") & small(r))),
        no_single_beside(dash),
        which(lambda r: ~falls(r)),
        no_single_beside(lambda o: (_kind(o) == "range") & ~falls(o)),
        which(lambda r: (_kind(r) == "multidim") & (size(r, "x") == 2)),
        least(lambda r: size(r, "rlxq")),
    ]
    # nothing is to be ranked where there is one reading, and only tokens that some reading takes for a number have a value
    counts = lambda i: F.exists(F.col(every), lambda r: F.substring(r, i + 1, F.lit(1)) == "n")
    value = F.when(F.size(every) > 1, F.transform(found, lambda t, i: F.when(counts(i), str2num(t, normalize=False))))
    out_df = df.withColumn(values, value).withColumn(work, F.col(every))
    kept = unused_name(df, "__kept")
    for rule in rules:
        out_df = out_df.withColumn(kept, F.when(F.size(rs) > 1, rule)).withColumn(work, F.when(F.size(kept) > 0, F.col(kept)).otherwise(rs))
    return out_df.withColumn(out, F.get(work, F.lit(0))).drop(values, work, kept)


def unused_name(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def interpret(df: DataFrame, text: Column, out: str = "reading") -> DataFrame:
    """`df` with `out`: struct<tokens, roles, type, quantities> of a span's best reading; null for null, and if it has too many."""
    found, every, best = (unused_name(df, f"__{x}") for x in ("tokens", "every", "best"))
    x = df.withColumn(found, normalize_quantity(text)).withColumn(found, tokens(F.col(found)))
    x = x.withColumn(every, roles(F.col(found))).withColumn(every, readings(F.col(every)))
    x = ranked(x, found, every, best)
    r = F.col(best)
    reading = F.struct(F.col(found).alias("tokens"), r.alias("roles"), _kind(r).alias("type"), (F.length(F.regexp_replace(r, "[^rlxq]", "")) + 1).alias("quantities"))
    return x.withColumn(out, F.when(r.isNotNull() & (r != ""), reading)).drop(found, every, best)
