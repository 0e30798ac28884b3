"""Words and symbols of quantity expressions."""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------------------------------------------
#: Power of ten of each magnitude word, short scale.
MAGNITUDES = {
    "hundred": 2, "thousand": 3, "million": 6, "billion": 9, "trillion": 12, "quadrillion": 15, "quintillion": 18,
    "sextillion": 21, "septillion": 24, "octillion": 27, "nonillion": 30, "decillion": 33, "undecillion": 36,
    "duodecillion": 39, "tredecillion": 42, "quattuordecillion": 45, "quindecillion": 48, "sexdecillion": 51,
    "septendecillion": 54, "octodecillion": 57, "novemdecillion": 60, "vigintillion": 63, "unvigintillion": 66,
    "duovigintillion": 69, "tresvigintillion": 72, "quattuorvigintillion": 75, "quinquavigintillion": 78,
    "sesvigintillion": 81, "septemvigintillion": 84, "octovigintillion": 87, "novemvigintillion": 90,
    "trigintillion": 93, "untrigintillion": 96, "duotrigintillion": 99, "trestrigintillion": 102,
    "quattuortrigintillion": 105, "quinquatrigintillion": 108, "sestrigintillion": 111, "septentrigintillion": 114,
    "octotrigintillion": 117, "noventrigintillion": 120, "quadragintillion": 123, "quinquagintillion": 153,
    "sexagintillion": 183, "septuagintillion": 213, "octogintillion": 243, "nonagintillion": 273, "centillion": 303,
    "uncentillion": 306, "duocentillion": 309, "trescentillion": 312, "decicentillion": 333, "undecicentillion": 336,
    "viginticentillion": 363, "unviginticentillion": 366, "trigintacentillion": 393, "quadragintacentillion": 423,
    "quinquagintacentillion": 453, "sexagintacentillion": 483, "septuagintacentillion": 513,
    "octogintacentillion": 543, "nonagintacentillion": 573, "ducentillion": 603, "trecentillion": 903,
    "quadringentillion": 1203, "quingentillion": 1503, "sescentillion": 1803, "septingentillion": 2103,
    "octingentillion": 2403, "nongentillion": 2703, "millinillion": 3003,
}
CARDINALS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16,
    "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50,
    "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}
ORDINALS = {
    "first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8, "ninth": 9,
    "tenth": 10, "eleventh": 11, "twelfth": 12, "thirteenth": 13, "fourteenth": 14, "fifteenth": 15,
    "sixteenth": 16, "seventeenth": 17, "eighteenth": 18, "nineteenth": 19, "twentieth": 20, "thirtieth": 30,
    "fortieth": 40, "fiftieth": 50, "sixtieth": 60, "seventieth": 70, "eightieth": 80, "ninetieth": 90,
    "hundredth": 100, "thousandth": 1000, "millionth": 1000000, "billionth": 1000000000,
}
PLURALS = {
    "ones": 1, "twos": 2, "threes": 3, "fours": 4, "fives": 5, "sixes": 6, "sevens": 7, "eights": 8, "nines": 9,
    "tens": 10, "elevens": 11, "twelves": 12, "thirteens": 13, "fourteens": 14, "fifteens": 15, "sixteens": 16,
    "seventeens": 17, "eighteens": 18, "nineteens": 19, "twenties": 20, "thirties": 30, "forties": 40,
    "fifties": 50, "sixties": 60, "seventies": 70, "eighties": 80, "nineties": 90,
}
GROUPS = {
    "half": 0.5, "halves": 0.5, "thirds": 1 / 3, "quarter": 0.25, "dozen": 12, "dozens": 12, "gross": 144,
    "great gross": 1728, "small gross": 120, "twelfty": 120, "great hundred": 120, "long hundred": 120,
    "long thousand": 1200,
}
ALONE = {
    "a third": 1 / 3, "a quarter": 0.25, "once": 1, "twice": 2, "thrice": 3, "single": 1, "double": 2, "triple": 3,
    "quadruple": 4, "quintuple": 5, "zeroth": 0, "zeros": 0,
}
#: Number words that are units too.
ALSO_UNITS = ("second", "quarter")
IMPRECISE = (
    "multi", "multiple", "quadrillions of", "tens of thousands", "tens of millions", "tens of billions",
    "hundreds of thousands", "hundreds of millions", "hundreds of billions", "various", "several", "handful",
    "handful of", "many", "few", "few of", "couple", "couple of", "some", "lots of", "lot of", "not much",
    "not many", "ton of", "tons of", "bunch of", "bunchs of", "gobs of", "oodles and oodles of", "lots and lots of",
    "plenty", "plenty of", "multitude of", "cornucopia of", "great deal of", "all kinds of", "too many to count",
    "way too many", "uncountable", "hell of a lot", "lions share of", "waist deep in", "infinitesimally small",
    "infinitely more", "up the wazoo", "infinitely small", "infinitely", "less", "infinitely large",
)
AMOUNTS = (
    "dozen", "hundred", "thousand", "million", "billion", "trillion", "oodle", "plethora", "myriad", "butt load",
    "crap load", "shit load", "truck load", "gazillion", "bazillion",
)
AMOUNT_ADJECTIVES = ("few", "several", "some", "couple", "couple of", "handful", "handful of", "many", "multiple")
NEUTRAL = {"number": "numbers", "amount": "amounts", "quantity": "quantities"}
NEUTRAL_ADJECTIVES = (
    "tiny", "very tiny", "small", "very small", "vanishingly small", "large", "very large", "great", "miniscule",
    "minuscule", "significant", "considerable", "vast", "huge", "massive",
)
#: Amounts that are exact, or units, when nothing follows.
EXACT = ("hundred", "thousand", "million", "billion", "trillion", "dozen", "ton")
#: What modifiers are normalized to.
SYMBOLS = ("", "=", "!=", "±", "<", ">", "<=", ">=", ">>", "<<", "~", "~<", "~>=", "<~", ">~", ">~=", "<~=", "<>", "><", "<>=", "∝", "mean", "median")
SIGNS = ("+", "-", "−")
STATISTICAL_BEFORE = {
    "mean": ("average", "average of", "average over", "average value of", "averaging", "on average", "mean", "mean over", "mean value of"),
    "median": ("median", "median over", "median value of", "a median of"),
}
STATISTICAL_AFTER = {"mean": ("on average,", "on average", "average", "mean"), "median": ("median",)}
#: Words and symbols before a quantity, by what they are normalized to; None: recognised only.
BEFORE = {
    "=": ("=", "equal to", "equals", "stabilized at a value of"),
    "!=": ("!=", "not", "not equal", "not equals", "not equal to", "≠", "¬", "non-"),
    "±": ("±", "∓"),
    "-": ("minus", "negative"),
    "<": ("<", "below", "well below", "just below", "less than", "smaller than", "or below", "lower than"),
    ">": (">", "higher than", "above", "just above", "over", "just over", "more than", "beyond", "greater than", "exceed", "varied widely from", "still above", "exceeded", "over more than", "over the"),
    "<=": ("<=", "≤", "<or=", "up to", "max.", "max", "maximum", "as high as", "as much as", "at most", "upper limit of", "not more than", "not exceed", "possibly be made as high as", "uppermost", "⩽", "upto", "reached a maximum of", "a maximum of"),
    ">=": (">=", "≥", ">or=", "min.", "min", "minimum", "as low as", "at least", "lower limit of", "not less than", "could drop to", "a minimum of", "become as low as"),
    ">>": (">>", "much greater than", "≫", "well above", "well over", "significantly higher than", "far more than", "way more than"),
    "<<": ("<<", "much less than", "≪"),
    "~": ("~", "∼", "≃", "≈", "approximately", "approx.", "approx", "around", "about", "some", "close to", "circa", "ca.", "ca", "of around", "near the", "near", "nearly", "roughly", "order of", "at around", "in the order of", "at about", "initially around", "after about", "of the order of", "on the order of", "approximate", "appro."),
    "~<": ("~<", "almost", "slightly less"),
    "~>=": ("~>=", "slightly above the critical value of"),
    "<~": ("<~", "less than ∼", "below around", "below ∼"),
    ">~": (">~", "from approximately", "from ∼", "above ∼"),
    ">~=": (">~=", "≳"),
    "<~=": ("<~=", "values as high as ~", "up to around", "up to approximately"),
    "<>": ("<>",),
    "><": ("><", "over <"),
    "<>=": ("<>=", "up to at least"),
    "∝": ("∝", "proportional to"),
    "": ("between", "about ±"),
    None: (
        "inbetween", "was obtained as", "estimated", "up to exceed", "is identified to be", "within <",
        "evaluated to be", "range of", "ranging from", "until", "top", "within the top", "before", "past",
        "between ∼", "range", "after", "ranged between", "approximately every", "low as", "increases from",
        "decreased from the initial", "decreased from", "toward", "approached", "ranges", "calculated to",
        "increased from", "lower", "ranged from", "found to be", "was as high as", "between the ages of",
        "starts on", "from", "average maximum", "‡", "better than", "the range between", "every",
        "in the range of", "comes to", "within", "an initial value between", "last", "between about", "upper",
        "increases from ∼", "down to", "declined from", "reach", "mean and 2sd of", "decreased below",
        "range from", "decrease to", "worse than", "in the amount of", "fallen from", "were revealed to be",
    ),
}
AFTER = {
    "<=": ("or lower", "or less", "at maximum", "at best", "seems to be the ultimate upper limit"),
    ">=": ("or higher", "or more", "at least", "at minimum", "at worst", "seems to be the ultimate lower limit"),
    "~": ("approximately", "approx.", "approx", "range"),
    None: ("at most", "higher", "nominally", "larger"),
}
#: Text before and after a quantity, or its own ends, that makes it relative.
RELATIVE_BEFORE = ("by", "twice as much as", "half as much as", "by more than", "by less than")
RELATIVE_AFTER = ("above", "below", "higher than", "lower than")
SPAN_PREFIXES = ("with a", "with an", "from", "of")
SPAN_SUFFIXES = (".", ":", ",", ";", "?", "!", " of")
RANGE_SEPARATORS = ("-", "to")
LIST_SEPARATORS = ("and", "or", "and/or", ";", ",", "vs", "vs.", "versus")
RATIO_SEPARATORS = (":", "of the", "out of the", "out of", "of", "per")
MULTIDIM_SEPARATORS = ("x", "*", "times", "by")
PHYSICAL_CONSTANTS = (
    "planck time", "planck length", "speed of gravity", "solar constant", "planck mass", "bohr radius",
    "rydberg constant", "planck temperature", "bohr magneton", "planck energy", "nuclear magneton",
    "gaussian gravitational constant", "proton-to-electron mass ratio", "neutron magnetic moment",
    "molar mass constant", "pion decay constant", "einstein's constant", "angstrom star", "proton magnetic moment",
    "planck acceleration", "josephson constant", "alpha particle mass", "electron compton wavelength",
    "planck magnetic flux density", "planck magnetic flux", "gram-force", "muon mass", "tau mass", "copper x unit",
    "molybdenum x unit", "molar planck constant", "speed of light", "light speed", "lightspeed", "planck speed",
    "speed of electromagnetic waves in vacuum", "speed of light in vacuum", "vacuum speed of light",
    "velocity of light", "boltzmann constant", "fine-structure constant", "fine structure constant",
    "sommerfeld's constantvacuum permittivity", "electric constant", "permittivity of free space",
    "permittivity of vacuum", "vacuum electric permittivityavogadro constant",
    "avogadro's constantgravitational constant", "newton's gravitational constant",
    "newtonian constant of gravitationlight-year", "l.y.", "light year", "light years", "light-years", "lightyear",
    "lightyears", "elementary charge", "elementary electric charge", "elementary positive charge",
    "speed of light in a vacuum", "electronvolt", "electron volt",
    "stefan-boltzmann constant", "stefan boltzmann constantcosmological constant",
    "einstein's cosmological constantplanck constant", "planck's constant", "molar gas constant",
    "ideal gas constant", "universal gas constantfaraday constant", "standard atmosphere", "gas constant",
    "impedance of free space", "planck impedance", "characteristic impedance of vacuum", "vacuum impedance",
    "von klitzing constant", "hartree energy", "hartree", "loschmidt constant", "loschmidt's number",
    "tolman–oppenheimer–volkoff limit", "tov limit", "magnetic constant", "permeability of free space",
    "permeability of vacuum", "vacuum permeability", "reduced planck constant", "dirac constant",
    "dirac's constant", "planck action", "planck angular momentum", "reduced planck's constant",
    "classical electron radius", "electron radius", "lorentz radius", "thomson scattering length",
    "magnetic flux quantum", "flux quantum", "electron rest mass", "electron mass", "von kármán constant",
    "kármán's constant", "unified atomic mass constant", "atomic mass constant", "proton gyromagnetic ratio",
    "gyromagnetic coefficient of the proton", "gyromagnetic ratio of the proton", "magnetogyric ratio of the proton",
    "coulomb's constant", "electric force constant", "electrostatic constant",
    "wien wavelength displacement law constant", "wien constant", "wien's displacement constant",
    "standard acceleration of free fall", "standard gravity", "standard acceleration of gravity", "rydberg energy",
    "rydberg", "conductance quantum", "avogadro number", "avogadro's number", "weak mixing angle constant",
    "weak mixing angle", "proton rest mass", "proton mass", "electron gyromagnetic ratio",
    "gyromagnetic coefficient of the electron", "gyromagnetic ratio of the electron",
    "magnetogyric ratio of the electron", "neutron rest mass", "neutron mass", "neutron gyromagnetic ratio",
    "gyromagnetic coefficient of the neutron", "gyromagnetic ratio of the of the neutron",
    "magnetogyric ratio of the neutron",
)
# --- end of fixed values ----------------------------------------------------------------------------------------

#: Names that the list above has only run together with others.
_APART = ("sommerfeld's constant", "vacuum permittivity", "avogadro constant", "avogadro's constant", "gravitational constant", "newtonian constant of gravitation", "light-year", "stefan boltzmann constant", "cosmological constant", "planck constant", "universal gas constant", "faraday constant")
#: Reduced gyromagnetic ratios are named in five ways for each particle.
CONSTANTS = PHYSICAL_CONSTANTS + _APART + tuple(
    n
    for p in ("electron", "proton", "neutron")
    for n in (f"reduced {p} gyromagnetic ratio", f"{p} reduced gyromagnetic ratio", *(f"reduced {k} of the {p}" for k in ("gyromagnetic coefficient", "gyromagnetic ratio", "magnetogyric ratio")))
)

_th = {w: v for w, v in ORDINALS.items() if w.endswith("th")}
#: Words that are numbers on their own or in a row of number words; "sevenths" is a seventh.
NUMBER_WORDS: dict[str, float] = CARDINALS | ORDINALS | PLURALS | GROUPS | {f"{w}s": 1 / v for w, v in _th.items()}
STANDALONE: dict[str, float] = ALONE | {f"a {w}": 1 / v for w, v in _th.items()}
ALL_NUMBER_WORDS: dict[str, float] = NUMBER_WORDS | STANDALONE
#: Behind a number under 20 these divide.
FRACTION_WORDS = ("third", "thirds", "half", "halves", "quarter", *_th, *(f"{w}s" for w in _th))


def _imprecise() -> list[str]:
    out = list(IMPRECISE)
    for one in (*AMOUNTS, *(a.replace(" ", "") for a in AMOUNTS if a.endswith(" load"))):
        many = f"{one}s"
        out += [one, many, f"{one} of", f"{many} of", *(f"{adj} {x}" for adj in AMOUNT_ADJECTIVES for x in (one, many))]
    for one, many in NEUTRAL.items():
        out += [x for adj in NEUTRAL_ADJECTIVES for x in (f"{adj} {one} of", f"a {adj} {one} of", f"the {adj} {one} of", f"{adj} {many} of")]
    gone = {*EXACT, *(f"{x}s" for x in EXACT)}
    return [x for x in out if x not in gone] + ["tens", *(f"{m}s" for m in MAGNITUDES)]


def longest_first(terms: list[str] | tuple[str, ...]) -> list[str]:
    """Without repeats; a longer term before any that it starts with, as alternatives of a pattern need it."""
    return sorted(dict.fromkeys(terms), key=lambda x: (-len(x), x))


IMPRECISE_QUANTITIES = longest_first(_imprecise())


def _surfaces(by_symbol: dict[str | None, tuple[str, ...]]) -> dict[str, str | None]:
    return {surface: symbol for symbol, surfaces in by_symbol.items() for surface in surfaces}


def _parenthesized(d: dict[str, str | None]) -> dict[str, str | None]:
    return d | {f"({k})": v for k, v in d.items() if not k.endswith((",", ")"))}


_before = _surfaces(BEFORE)
#: Modifier surfaces and what they mean; every word or symbol in front may be followed by " a".
PREFIXED: dict[str, str | None] = _before | {f"{k} a": v for k, v in _before.items() if not k.endswith(" a") and k not in ("non-", "negative")}
SUFFIXED = _parenthesized(_surfaces(AFTER))
STATISTICAL_PREFIXED: dict[str, str | None] = _surfaces(STATISTICAL_BEFORE)
STATISTICAL_SUFFIXED = _parenthesized(_surfaces(STATISTICAL_AFTER))
PREFIXED_MODIFIERS = longest_first([*PREFIXED, *STATISTICAL_PREFIXED])
SUFFIXED_MODIFIERS = longest_first([*SUFFIXED, *STATISTICAL_SUFFIXED])
#: surface -> symbol, for those that have one; a statistical meaning goes first.
PREFIX_SYMBOLS = {k: v for k, v in (PREFIXED | STATISTICAL_PREFIXED).items() if v is not None}
SUFFIX_SYMBOLS = {k: v for k, v in (SUFFIXED | STATISTICAL_SUFFIXED).items() if v is not None}
