"""The unit catalog, built by rule from public knowledge of SI, customary units and ISO 4217; not the official ontology.

Rows: uri, dimension exponents (amount, current, length, luminous, mass, temperature, time, dimensionless), factor
and offset to SI, systems, surfaces, UCUM code. Names follow the public QUDT style (KiloW-HR, M-PER-SEC).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

UNIT = "http://qudt.org/vocab/unit/"
PLACEHOLDER = "http://qudt.org/PLACEHOLDER_"
AXES = "AELIMHTD"

# --- fixed values -----------------------------------------------------------------------------------------------
PREFIXES = {
    "Quetta": ("Q", 30), "Ronna": ("R", 27), "Yotta": ("Y", 24), "Zetta": ("Z", 21), "Exa": ("E", 18), "Peta": ("P", 15), "Tera": ("T", 12), "Giga": ("G", 9),
    "Mega": ("M", 6), "Kilo": ("k", 3), "Hecto": ("h", 2), "Deca": ("da", 1), "Deci": ("d", -1), "Centi": ("c", -2), "Milli": ("m", -3), "Micro": ("μ", -6),
    "Nano": ("n", -9), "Pico": ("p", -12), "Femto": ("f", -15), "Atto": ("a", -18), "Zepto": ("z", -21), "Yocto": ("y", -24),
}
#: name: symbols; labels; dimensions; factor to SI; UCUM code. These take prefixes.
METRIC = {
    "M": ("m", "metre meter", "L1", "1", "m"), "GM": ("g gm", "gram gramme", "M1", "0.001", "g"), "SEC": ("s sec sec.", "second", "T1", "1", "s"), "A": ("A", "ampere amp", "E1", "1", "A"),
    "K": ("K", "kelvin", "H1", "1", "K"), "MOL": ("mol", "mole", "A1", "1", "mol"), "CD": ("cd", "candela", "I1", "1", "cd"), "HZ": ("Hz", "hertz", "T-1", "1", "Hz"),
    "N": ("N", "newton", "L1M1T-2", "1", "N"), "PA": ("Pa", "pascal", "L-1M1T-2", "1", "Pa"), "J": ("J", "joule", "L2M1T-2", "1", "J"), "W": ("W", "watt", "L2M1T-3", "1", "W"),
    "C": ("C", "coulomb", "E1T1", "1", "C"), "V": ("V", "volt", "E-1L2M1T-3", "1", "V"), "FARAD": ("F", "farad", "E2L-2M-1T4", "1", "F"), "OHM": ("Ω Ohm", "ohm", "E-2L2M1T-3", "1", "Ohm"),
    "S": ("S", "siemens", "E2L-2M-1T3", "1", "S"), "WB": ("Wb", "weber", "E-1L2M1T-2", "1", "Wb"), "T": ("T", "tesla", "E-1M1T-2", "1", "T"), "H": ("H", "henry", "E-2L2M1T-2", "1", "H"),
    "LM": ("lm", "lumen", "I1", "1", "lm"), "LUX": ("lx", "lux", "I1L-2", "1", "lx"), "BQ": ("Bq", "becquerel", "T-1", "1", "Bq"), "GRAY": ("Gy", "gray", "L2T-2", "1", "Gy"),
    "SV": ("Sv", "sievert", "L2T-2", "1", "Sv"), "KAT": ("kat", "katal", "A1T-1", "1", "kat"), "L": ("L l", "litre liter", "L3", "0.001", "L"), "TONNE": ("t", "tonne metric-ton ton", "M1", "1000", "t"),
    "EV": ("eV", "electronvolt electron-volt", "L2M1T-2", "1.602176634E-19", "eV"), "BAR": ("bar", "bar", "L-1M1T-2", "100000", "bar"), "W-HR": ("Wh W⋅h", "watt-hour", "L2M1T-2", "3600", "W.h"),
    "CAL": ("cal", "calorie", "L2M1T-2", "4.184", "cal"), "BIT": ("bit", "bit", "D1", "1", "bit"), "BYTE": ("B", "byte", "D1", "8", "By"), "MOLAR": ("M", "molar", "A1L-3", "1000", "mol/L"),
    "V-A": ("VA", "volt-ampere", "L2M1T-3", "1", "V.A"), "W-PEAK": ("Wp", "watt-peak", "L2M1T-3", "1", "W"), "A-HR": ("Ah", "ampere-hour", "E1T1", "3600", "A.h"),
}
#: The same without prefixes.
PLAIN = {
    "HR": ("h hr hrs", "hour", "T1", "3600", "h"), "MIN": ("min min.", "minute", "T1", "60", "min"), "DAY": ("d", "day", "T1", "86400", "d"), "WK": ("wk", "week", "T1", "604800", "wk"),
    "MO": ("mo", "month", "T1", "2629800", "mo"), "YR": ("a yr yrs", "year annum", "T1", "31557600", "a"), "DEG": ("°", "degree", "D1", "0.017453292519943295", "deg"), "RAD": ("rad", "radian", "D1", "1", "rad"),
    "PERCENT": ("%", "percent per-cent percentage", "D1", "0.01", "%"), "PERMILLE": ("‰", "permille per-mille", "D1", "0.001", "[ppth]"), "PPM": ("ppm", "parts-per-million", "D1", "0.000001", "[ppm]"), "PPB": ("ppb", "parts-per-billion", "D1", "1E-9", "[ppb]"),
    "ERG": ("erg", "erg", "L2M1T-2", "1E-7", "erg"), "DYN": ("dyn", "dyne", "L1M1T-2", "0.00001", "dyn"), "GAUSS": ("G", "gauss", "E-1M1T-2", "0.0001", "G"), "ANGSTROM": ("Å", "angstrom ångström", "L1", "1E-10", "Ao"),
    "ATM": ("atm", "atmosphere", "L-1M1T-2", "101325", "atm"), "TORR": ("Torr", "torr", "L-1M1T-2", "133.322368421053", "mm[Hg]"), "MilliM_HG": ("mmHg", "millimetre-of-mercury", "L-1M1T-2", "133.322387415", "mm[Hg]"), "PSI": ("psi", "psi", "L-1M1T-2", "6894.757293168", "[psi]"),
    "IN": ("in in. ″", "inch", "L1", "0.0254", "[in_i]"), "FT": ("ft ft. ′", "foot feet", "L1", "0.3048", "[ft_i]"), "YD": ("yd", "yard", "L1", "0.9144", "[yd_i]"), "MI": ("mi", "mile", "L1", "1609.344", "[mi_i]"), "MI_N": ("nmi", "nautical-mile", "L1", "1852", "[nmi_i]"),
    "LB": ("lb lbs", "pound", "M1", "0.45359237", "[lb_av]"), "OZ": ("oz", "ounce", "M1", "0.028349523125", "[oz_av]"), "TON_SHORT": ("", "short-ton", "M1", "907.18474", "[ston_av]"), "AC": ("ac", "acre", "L2", "4046.8564224", "[acr_us]"), "HA": ("ha", "hectare", "L2", "10000", "har"),
    "GAL_US": ("gal", "gallon", "L3", "0.003785411784", "[gal_us]"), "PINT_US": ("pt", "pint", "L3", "0.000473176473", "[pt_us]"), "PINT_UK": ("", "pint-(uk)", "L3", "0.00056826125", "[pt_br]"), "BBL": ("bbl", "barrel", "L3", "0.158987294928", "[bbl_us]"),
    "BTU_IT": ("Btu BTU", "british-thermal-unit", "L2M1T-2", "1055.05585262", "[Btu_IT]"), "MegaBTU_IT": ("MMBtu MMBTU", "", "L2M1T-2", "1055055852.62", "10*6.[Btu_IT]"), "HP": ("hp", "horsepower", "L2M1T-3", "745.699871582", "[HP]"), "KN": ("kn", "knot", "L1T-1", "0.514444444444444", "[kn_i]"),
    "BEAT-PER-MIN": ("bpm", "beats-per-minute", "T-1", "0.0166666666666667", "{beats}/min"), "REV-PER-MIN": ("rpm", "revolutions-per-minute", "T-1", "0.104719755119660", "{rev}/min"), "MI-PER-HR": ("mph", "miles-per-hour", "L1T-1", "0.44704", "[mi_i]/h"),
    "AU": ("au AU", "astronomical-unit", "L1", "149597870700", "AU"), "PARSEC": ("pc", "parsec", "L1", "3.0856775814913673E16", "pc"), "LY": ("ly", "light-year lightyear", "L1", "9460730472580800", "[ly]"), "EarthMass": ("M⊕", "earth-mass", "M1", "5.97219E24", ""), "SolarMass": ("M☉", "solar-mass", "M1", "1.988435E30", ""),
    "ARCMIN": ("", "arcminute", "D1", "0.0002908882086657216", "'"), "ARCSEC": ("arcsec", "arcsecond", "D1", "0.00000484813681109536", "''"), "PERSON": ("", "person people", "D1", "1", "{person}"), "DECADE": ("", "decade", "T1", "315576000", "10.a"), "CENTURY": ("", "century", "T1", "3155760000", "100.a"),
}
OFFSETS = {"DEG_C": ("°C degC", "degree-celsius celsius degrees-celsius", "1", "273.15", "Cel"), "DEG_F": ("°F degF", "degree-fahrenheit fahrenheit degrees-fahrenheit", "0.5555555555555555555555555556", "459.67", "[degF]")}
PLACEHOLDERS = {"CENT": ("¢ ⊄", "cent cents"), "PERCENT_BY_MASS": ("wt.% wt% wt.-%", "percent-by-mass weight-percent"), "PERCENT_BY_VOLUME": ("vol.% vol%", "percent-by-volume"), "GW_EL": ("GWel", "GW-el")}
CURRENCIES = {
    "USD": ("$ US$ USD", "us-dollar dollar"), "EUR": ("€ EUR", "euro"), "GBP": ("£ GBP", "pound-sterling british-pound"), "JPY": ("¥ JPY", "yen japanese-yen"), "CNY": ("CNY RMB", "yuan renminbi"), "INR": ("₹ INR", "indian-rupee rupee"),
    "CHF": ("CHF", "swiss-franc"), "CAD": ("CAD C$ CA$", "canadian-dollar"), "AUD": ("AUD A$ AU$", "australian-dollar"), "KRW": ("₩ KRW", "won"), "BRL": ("R$ BRL", "real"), "RUB": ("₽ RUB", "rouble ruble"), "SEK": ("SEK", "swedish-krona"), "NOK": ("NOK", "norwegian-krone"), "DKK": ("DKK", "danish-krone"),
    "ZAR": ("ZAR", "rand"), "MXN": ("MXN", "mexican-peso"), "TRY": ("₺ TRY", "turkish-lira"), "NGN": ("₦ NGN", "naira"), "PLN": ("PLN zł", "zloty"), "HKD": ("HK$ HKD", "hong-kong-dollar"), "NZD": ("NZ$ NZD", "new-zealand-dollar"), "SGD": ("S$ SGD", "singapore-dollar"),
}
#: Lower goes first; None: never.
PRIORITIES = {
    "$": {"CCY_USD": 1, "CCY_CAD": 2, "CCY_AUD": 3, "CCY_MXN": None}, "a": {"YR": 1, "AC": 2}, "min.": {"MIN": 1, "ARCMIN": 2}, "T": {"T": 1, "TONNE": 2}, "M": {"MOLAR": 1, "M": 2}, "h": {"HR": 1, "H": 2}, "d": {"DAY": 1}, "in": {"IN": 1},
    "t": {"TONNE": 1}, "C": {"C": 1, "DEG_C": 2}, "F": {"FARAD": 1, "DEG_F": 2}, "G": {"GAUSS": 1}, "pt": {"PINT_US": 1}, "pint": {"PINT_US": 1, "PINT_UK": 2}, "ton": {"TONNE": 1, "TON_SHORT": 2}, "pound": {"LB": 1, "CCY_GBP": 2}, "B": {"BYTE": 1}, "Pa": {"PA": 1}, "mo": {"MO": 1},
}
# --- end of fixed values ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Unit:
    uri: str
    dims: tuple[int, ...]
    factor: Decimal | None
    offset: Decimal = Decimal(0)
    systems: tuple[str, ...] = ("SI",)
    symbols: tuple[str, ...] = ()
    labels: tuple[str, ...] = ()
    ucum: str = ""
    currency: bool = False
    #: Parts of a compound unit, as (uri, exponent).
    parts: tuple[tuple[str, int], ...] = field(default=())


def dimensions(text: str) -> tuple[int, ...]:
    """`L2M1T-2` as eight exponents."""
    out, i = dict.fromkeys(AXES, 0), 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[j] in "-0123456789":
            j += 1
        out[text[i]], i = int(text[i + 1 : j]), j
    return tuple(out.values())


def vector(dims: tuple[int, ...] | list[int]) -> str:
    """Eight exponents as `A0E0L2I0M1H0T-2D0`."""
    return "".join(f"{a}{d:g}" for a, d in zip(AXES, dims, strict=True))


def _words(text: str) -> tuple[str, ...]:
    """Labels in lower case, in singular and plural, with blanks and with hyphens."""
    out: list[str] = []
    for word in text.split():
        for w in (word, word.replace("-", " "), word.replace("-(", "(")):
            out += [w, w if w.endswith("s") else w[:-1] + "ies" if w.endswith("ry") else f"{w}es" if w.endswith(("ch", "x")) else f"{w}s"]
    return tuple(dict.fromkeys(x.lower() for x in out))


_SI = ("CGS", "SI")


@lru_cache(maxsize=1)
def units() -> dict[str, Unit]:
    """All units by URI."""
    out: list[Unit] = []
    for name, (symbols, labels, dims, factor, ucum) in METRIC.items():
        system = ("SI",)
        out.append(Unit(UNIT + name, dimensions(dims), Decimal(factor), systems=_SI if name in ("M", "GM", "SEC", "K") else system, symbols=tuple(symbols.split()), labels=_words(labels), ucum=ucum))
        for prefix, (sign, power) in PREFIXES.items():
            signs = ("μ", "µ", "u") if prefix == "Micro" else (sign,)
            short = [s for s in symbols.split() if not s.endswith(".") and s not in ("gm", "sec", "Ohm")]
            own = [f"{p}{s}" for p in signs for s in short]
            names = [f"{prefix.lower()}{w}" for w in _words(labels)]
            out.append(Unit(f"{UNIT}{prefix}{name}", dimensions(dims), Decimal(factor) * Decimal(10) ** power, systems=_SI if name in ("M", "GM", "SEC") else system, symbols=tuple(own), labels=tuple(names), ucum=("u" if prefix == "Micro" else sign) + ucum))
    for name, (symbols, labels, dims, factor, ucum) in PLAIN.items():
        out.append(Unit(UNIT + name, dimensions(dims), Decimal(factor), systems=_SI if name in ("HR", "MIN", "DAY", "WK", "MO", "YR", "ERG", "DYN", "GAUSS") else ("IMPERIAL", "USCS") if name in ("IN", "FT", "YD", "MI", "LB", "OZ", "AC", "GAL_US", "PINT_US", "PINT_UK", "BTU_IT", "HP", "PSI") else ("SI",), symbols=tuple(symbols.split()), labels=_words(labels), ucum=ucum))
    for name, (symbols, labels, factor, offset, ucum) in OFFSETS.items():
        out.append(Unit(UNIT + name, dimensions("H1"), Decimal(factor), Decimal(offset), systems=_SI if name == "DEG_C" else ("IMPERIAL", "USCS"), symbols=tuple(symbols.split()), labels=_words(labels), ucum=ucum))
    for code, (symbols, labels) in CURRENCIES.items():
        out.append(Unit(f"{UNIT}CCY_{code}", dimensions("D1"), Decimal(1), symbols=tuple(symbols.split()), labels=_words(labels), currency=True))
    for name, (symbols, labels) in PLACEHOLDERS.items():
        percent = name.startswith("PERCENT")
        out.append(Unit(PLACEHOLDER + name, dimensions("L2M1T-3" if name == "GW_EL" else "D1"), Decimal("1E9") if name == "GW_EL" else Decimal("0.01") if percent else Decimal(1), symbols=tuple(symbols.split()), labels=_words(labels), currency=name == "CENT"))
    simple = {u.uri: u for u in out}

    def compound(name: str, *parts: tuple[str, int]) -> None:
        made = [(simple[UNIT + n], e) for n, e in parts]
        dims = tuple(sum(u.dims[i] * e for u, e in made) for i in range(8))
        factor = Decimal(1)
        for u, e in made:
            factor *= u.factor**e
        shared = set.intersection(*(set(u.systems) for u, _ in made))
        surfaces = ["".join(f"/{u.symbols[0]}{-e if e < -1 else ''}" if e < 0 else f"{u.symbols[0]}{e if e > 1 else ''}" for u, e in made)]
        out.append(Unit(UNIT + name, dims, factor, systems=tuple(sorted(shared)), symbols=tuple(surfaces), parts=tuple((u.uri, e) for u, e in made)))

    for base in ("M", "CentiM", "MilliM", "KiloM", "MicroM", "NanoM", "IN", "FT", "MI"):
        for n in (2, 3):
            compound(f"{base}{n}", (base, n))
    over = {
        ("M", "KiloM", "CentiM", "MilliM", "FT", "IN"): (("SEC", 1), ("HR", 1), ("SEC", 2), ("MIN", 1), ("DAY", 1), ("YR", 1)),
        ("GM", "KiloGM", "MilliGM", "MicroGM", "NanoGM", "PicoGM", "MOL", "MilliMOL", "MicroMOL", "NanoMOL"): (("L", 1), ("MilliL", 1), ("DeciL", 1), ("MicroL", 1), ("M", 3), ("CentiM", 3), ("KiloGM", 1), ("GM", 1), ("SEC", 1), ("MIN", 1), ("HR", 1), ("DAY", 1), ("MOL", 1)),
        ("W", "KiloW", "MilliW", "J", "KiloJ", "MegaJ", "KiloW-HR", "W-HR", "N", "A", "MilliA", "V", "KiloV", "ERG"): (("M", 1), ("M", 2), ("CentiM", 2), ("KiloGM", 1), ("GM", 1), ("K", 1), ("MOL", 1), ("HR", 1), ("DAY", 1), ("YR", 1), ("L", 1), ("M", 3), ("CentiM", 1)),
        ("L", "MilliL", "MicroL"): (("MIN", 1), ("HR", 1), ("SEC", 1), ("DAY", 1), ("KiloGM", 1)),
    }
    for tops, bottoms in over.items():
        for top in tops:
            for bottom, n in bottoms:
                compound(f"{top}-PER-{bottom}{n if n > 1 else ''}", (top, 1), (bottom, -n))
    return {u.uri: u for u in out}


@lru_cache(maxsize=1)
def surfaces() -> dict[str, tuple[str, ...]]:
    """Surface -> URIs: symbols as they are, labels in lower case."""
    out: dict[str, dict[str, None]] = {}
    for u in units().values():
        for s in (*u.symbols, *u.labels):
            out.setdefault(s, {})[u.uri] = None
    return {s: tuple(uris) for s, uris in out.items()}


def _rank(surface: str, uri: str) -> tuple[float, int, str]:
    given = PRIORITIES.get(surface, {}).get(uri.removeprefix(UNIT), 1000)
    return (float("inf") if given is None else given, len(uri), uri)


@lru_cache(maxsize=1)
def best_uri() -> dict[str, str]:
    """Surface -> the URI of least priority, then the shortest; a surface on which only never-used ones are left has none."""
    ranked = {s: min((_rank(s, u), u) for u in uris) for s, uris in surfaces().items()}
    return {s: u for s, ((p, _, _), u) in ranked.items() if p != float("inf")}


def catalog(spark: SparkSession) -> DataFrame:
    """One row for each unit; a dimension of bounded size."""
    rows = [(u.uri, vector(u.dims), list(u.dims), float(u.factor), float(u.offset), list(u.systems), u.currency, u.ucum or None) for u in units().values()]
    return spark.createDataFrame(rows, "uri string, dimension_vector string, dims array<int>, multiplier double, offset double, systems array<string>, is_currency boolean, ucum string")


def surface_table(spark: SparkSession) -> DataFrame:
    """(surface, kind, uri, priority): symbols keep their case, labels have none."""
    rows = [(s, "symbol" if s in u.symbols else "label", uri, (lambda p: p if p is not None else None)(PRIORITIES.get(s, {}).get(uri.removeprefix(UNIT), 1000))) for s, uris in surfaces().items() for uri in uris for u in (units()[uri],)]
    return spark.createDataFrame(rows, "surface string, kind string, uri string, priority int")
