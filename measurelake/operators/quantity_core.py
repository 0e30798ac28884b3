"""Reading one normalized quantity expression; `quantities` applies it to columns.

Uncertainties are lifted out first, then all numbers are found. What stands between two numbers is read as unit of
the left one, separator, and modifier and unit of the right one; what stands outside as modifiers and units.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from fractions import Fraction

from measurelake.functions import lexicon
from measurelake.operators.unit_core import Part, parse as parse_unit

_alt = lambda terms: "|".join(re.escape(t) for t in lexicon.longest_first(list(terms)))
_DIGITS = r"\d+(?:[,' ]\d{3}(?!\d))*(?:[.,]\d+)*"
_WORD = _alt([*lexicon.NUMBER_WORDS, *lexicon.MAGNITUDES])
_ROW = rf"(?:(?:(?:{_WORD})[- ](?:and )?)*(?:{_WORD})|{_alt(lexicon.STANDALONE)})"
_MAGNITUDE = _alt(lexicon.MAGNITUDES)
_SCALED = rf"{_DIGITS}(?: ?[x×*∙⋅·] ?10\^ ?[-+]?\d+|\^[-+]?\d+| ?[-+]?{_DIGITS}/\d+|/\d+(?![\d.])| (?:{_MAGNITUDE})\b|(?:k|M|B)\b(?=\s*$))?"
NUMBER = re.compile(rf"(?<![\w.,^])(?:[-+] ?)?{_SCALED}(?![\d])|\b(?:(?:an?|the) )?(?:{_alt(lexicon.IMPRECISE_QUANTITIES)})\b(?! than\b)|\b(?:{_ROW})\b", re.IGNORECASE)
_N = rf"[-+]?{_DIGITS}(?: ?[x*] ?10\^-?\d+)?"
_UNIT = r"[^\s()\[\];,±]*"
_TYPED = r"(?:\d+(?:\.\d+)? ?% ?)?(?P<kind>confidence intervals?|credible intervals?|uncertainty intervals?|prediction intervals?|interquartile range|CI|UI|CrI|IQR|PI)"
UNCERTAINTY = [
    ("tolerance", re.compile(rf"[(\[]? ?± ?(?P<v>{_N})(?P<unit> ?[%°]?{_UNIT})[)\]]?")),
    ("interval", re.compile(rf"[,;]? ?[(\[]? ?{_TYPED}[ :,=\[(]*(?P<lb>{_N}) ?{_UNIT}(?: ?- ?| to |, ?|; ?)(?P<ub>{_N})(?P<unit> ?{_UNIT})[)\]]*", re.IGNORECASE)),
    ("interval", re.compile(rf"[(\[](?P<lb>{_N})(?: ?- ?| to |, ?)(?P<ub>{_N})(?P<unit> ?{_UNIT})[, ;]*{_TYPED}[)\]]", re.IGNORECASE)),
    ("unknown", re.compile(rf"(?<=\d|[%\w]) ?[(\[](?P<lb>{_N})(?: ?- ?| to |, ?)(?P<ub>{_N})(?P<unit> ?{_UNIT})[)\]]")),
    ("standard_deviation", re.compile(rf"[,;]? ?[(\[]? ?(?:standard deviation|std\.? ?dev\.?|SD|s\.d\.)[ :=]*(?P<v>{_N})(?P<unit> ?{_UNIT})[)\]]?", re.IGNORECASE)),
]
_MARK = "\ue000"
_IMPRECISE = re.compile(rf"(?:(?:an?|the) )?(?:{_alt(lexicon.IMPRECISE_QUANTITIES)})(?: of)?", re.IGNORECASE)
_BEFORE = re.compile(rf"\s*(?:{_alt([*lexicon.PREFIXED_MODIFIERS, *lexicon.SIGNS])})(?!\w)|\s*(?:{_alt([m for m in lexicon.PREFIXED_MODIFIERS if not m[-1].isalnum()] + list(lexicon.SIGNS))})", re.IGNORECASE)
_AFTER = re.compile(rf"(?:^|(?<=[\s\d%)]))(?:{_alt(lexicon.SUFFIXED_MODIFIERS)})\s*$", re.IGNORECASE)
_SEPARATORS = [
    ("ratio", re.compile(r"\bout of(?: the)?\b|\bof(?: the)?\b|\bper\b|:")),
    ("range", re.compile(r"-?\s*\bto\b|-{1,3}")),
    ("list", re.compile(r"\band/or\b|\band\b|\bor\b|\bvs\b\.?|\bversus\b|[;,]")),
    ("multidim", re.compile(r"\btimes\b|\bby\b|(?<![\w])x(?![\w])|(?<=\d)x|\*")),
]


def _plain(text: str) -> float | None:
    """Digits with one kind of grouping and a decimal mark."""
    t = text.replace(" ", "").replace("'", "")
    if re.fullmatch(r"[-+]?\d{1,3}(?:,\d{3})+(?:\.\d+)?", t) and not re.fullmatch(r"[-+]?0,\d+", t):
        t = t.replace(",", "")
    elif re.fullmatch(r"[-+]?\d{1,3}(?:\.\d{3}){2,}(?:,\d+)?", t):
        t = t.replace(".", "").replace(",", ".")
    elif t.count(",") == 1 and "." not in t:
        t = t.replace(",", ".")
    try:
        return float(t)
    except ValueError:
        return None


def number(text: str) -> float | None:
    """The value of a found number; None for imprecise amounts."""
    t = text.strip().lower()
    if m := re.fullmatch(r"([-+]?) ?(.*)", t):
        sign, t = (-1.0 if m[1] == "-" else 1.0), m[2]
    else:
        sign = 1.0
    if (m := re.fullmatch(rf"({_DIGITS}) ?[x×*∙⋅·] ?10\^ ?([-+]?\d+)", t)) and (v := _plain(m[1])) is not None:
        return sign * float(f"{v!r}e{int(m[2])}") if "e" not in repr(v) else sign * v * 10.0 ** int(m[2])
    if (m := re.fullmatch(rf"({_DIGITS})\^([-+]?\d+)", t)) and (v := _plain(m[1])) is not None:
        return sign * (float(f"1e{m[2]}") if v == 10 else v ** int(m[2]))
    if m := re.fullmatch(r"(?:(\d+) ?([-+]?) ?)??(\d+)/(\d+)", t):
        return None if not int(m[4]) else sign * float((Fraction(int(m[1])) if m[1] else 0) + (-1 if m[2] == "-" else 1) * Fraction(int(m[3]), int(m[4])))
    if (m := re.fullmatch(rf"({_DIGITS}) ?(k|m|b)", t)) and (v := _plain(m[1])) is not None:
        return sign * v * {"k": 1e3, "m": 1e6, "b": 1e9}[m[2]]
    if (v := _plain(t)) is not None:
        return sign * v
    if t in lexicon.ALL_NUMBER_WORDS:
        return sign * lexicon.ALL_NUMBER_WORDS[t]
    total = 0.0
    for part in re.sub(r"^an? ", "1 ", t).split(" and "):
        run = 0.0
        for w in re.split(r"[\s-]+", part):
            one = w.removesuffix("s")
            if w in lexicon.MAGNITUDES:
                power = 10.0 ** min(308, lexicon.MAGNITUDES[w])
                run = power if run == 0 else run * power
            elif (v := lexicon.ALL_NUMBER_WORDS.get(w, lexicon.ALL_NUMBER_WORDS.get(one) if w != "tens" else None)) is not None:
                run = (run / v if v > 1 else run * v) if w in lexicon.FRACTION_WORDS and 0 < abs(run) < 20 else run + v
            elif (v := _plain(w)) is not None and re.match(r"\d", w):
                run += v
            else:
                return None
        total += run
    return sign * total


@dataclass
class Uncertainty:
    kind: str
    lb: float
    ub: float
    unit: str | None


@dataclass
class Quantity:
    modifier: tuple[str, str | None] | None = None
    prefix: tuple[str, tuple[Part, ...] | None] | None = None
    text: str = ""
    value: float | None = None
    imprecise: bool = False
    uncertainty: Uncertainty | None = None
    suffix: tuple[str, tuple[Part, ...] | None] | None = None
    after: tuple[str, str | None] | None = None
    ellipsed: bool = False


@dataclass
class Parsed:
    kind: str
    quantities: list[Quantity] = field(default_factory=list)
    separators: list[tuple[str, str]] = field(default_factory=list)
    success: bool | None = False


def _lift(s: str) -> tuple[str, list[Uncertainty]]:
    """The text with a mark for each uncertainty, its unit staying behind the mark."""
    found: list[Uncertainty] = []
    for kind, pattern in UNCERTAINTY:
        while m := pattern.search(s):
            if kind != "interval" and not re.search(r"[\d\w%°)]\s*$", s[: m.start()]):
                break
            g = m.groupdict()
            lb, ub = (number(g["lb"]), number(g["ub"])) if g.get("lb") else (-(number(g["v"]) or 0.0), number(g["v"]))
            if lb is None or ub is None:
                break
            unit = (g.get("unit") or "").strip()
            found.append(Uncertainty((g.get("kind") or kind).lower() if kind == "interval" else kind, lb, ub, unit or None))
            closed = m.group().endswith((")", "]")) or kind in ("interval", "unknown")
            s = f"{s[: m.start()]}{_MARK}{'' if closed and kind != 'tolerance' else unit}{s[m.end() :]}"
    return s, found


def _modifier(text: str) -> tuple[tuple[str, str | None] | None, str]:
    """Modifiers at the start, and the rest; several are joined."""
    rest, taken = text, []
    while (m := _BEFORE.match(rest)) and m.end():
        taken.append(m.group().strip())
        rest = rest[m.end() :]
    if not taken:
        return None, text.strip()
    shown = " ".join(taken)
    symbols = [t.lower() if t in lexicon.SIGNS else lexicon.PREFIX_SYMBOLS.get(t.lower(), "=" if t.lower() in ("a", "an") else None) for t in taken]
    whole = lexicon.PREFIX_SYMBOLS.get(shown.lower(), lexicon.PREFIX_SYMBOLS.get(shown.lower().replace(" ", "")))
    return (shown, whole if whole is not None else symbols[-1] if len(symbols) == 1 else "".join(x or "" for x in symbols) if all(x is not None for x in symbols) else None), rest.strip()


def _unit(text: str) -> tuple[str, tuple[Part, ...] | None] | None:
    t = text.strip()
    if re.fullmatch(r"\[.*\]|\(.*\)", t):
        t = t[1:-1].strip()
    t = t.removeprefix("-").strip().rstrip(":;,").strip() if t not in ("-",) else ""
    if not t:
        return None
    return t, (None if re.search(r"\d\.\d", t) else parse_unit(t))


def _tail(text: str, q: Quantity, marks: list[Uncertainty]) -> None:
    """Unit, uncertainty and modifiers behind a number."""
    while _MARK in text:
        text = text.replace(_MARK, " ", 1) if not text.startswith(_MARK) else text[1:]
        if marks and q.uncertainty is None:
            q.uncertainty = marks.pop(0)
    if m := _AFTER.search(text):
        surface = m.group().strip()
        q.after = (surface, lexicon.SUFFIX_SYMBOLS.get(surface.lower()))
        text = text[: m.start()]
    q.suffix = _unit(text)


def _head(text: str, q: Quantity) -> None:
    q.modifier, rest = _modifier(text)
    q.prefix = _unit(rest)


def _good_unit(text: str) -> bool:
    u = _unit(_AFTER.sub("", text.replace(_MARK, " ")))
    return u is None or u[1] is not None


def _good_head(text: str) -> bool:
    u = _unit(_modifier(text)[1])
    return u is None or u[1] is not None


def _cut(gap: str) -> tuple[str, tuple[str, str], str] | None:
    """Left unit, separator (surface, kind) and right head of a gap; the cut that leaves most in place."""
    found = []
    for order, (kind, pattern) in enumerate(_SEPARATORS):
        for m in pattern.finditer(gap):
            left, right = gap[: m.start()], gap[m.end() :]
            bad = (not _good_unit(left)) * 2 + (not _good_head(right)) * 2
            inside = m.start() > 0 and m.end() < len(gap) and gap[m.start() - 1].isalnum() and gap[m.end()].isalnum()
            found.append(((bad + 3 * inside, order if kind != "ratio" or not (left.strip() or right.strip()) else 9, -m.start()), left, (m.group(), f"{kind}_separator"), right))
    if not found:
        return None
    best = min(found, key=lambda x: x[0])
    return best[1:]


def _exponent(before: str, t: str) -> bool:
    """Whether a signed digit at the end of nothing but a unit (`J mol -1`) is its exponent."""
    head = _modifier(before)[1]
    return bool(re.fullmatch(r"-\d", t) and re.search(r"[A-Za-zμΩ°]\s?$", head) and (u := _unit(head)) and u[1] is not None)


def _numbers(s: str) -> list[re.Match[str]]:
    """Numbers that stand for values: not those that are exponents of units or words that are units."""
    out: list[re.Match[str]] = []
    for m in NUMBER.finditer(s):
        t = m.group().strip()
        before = s[: m.start()]
        if out:
            gap = s[out[-1].end() : m.start()]
            if re.fullmatch(r"[-+]? ?\d", t) and re.search(r"[A-Za-zμΩ°%)]\s?$", gap) and (t[0] in "-+" or not gap.endswith(" ")) and not re.search(r"\b(?:and|or|to|of|by|x|vs)\s*$", gap):
                continue
            if not gap.strip() and re.fullmatch(r"[a-z]+", t, re.IGNORECASE) and t.lower() in lexicon.ALSO_UNITS + tuple(f"{u}s" for u in lexicon.ALSO_UNITS):
                continue
            if re.fullmatch(r"(?:19|20)\d\d", t) and re.search(r"[$€£¥]\s?_?\{?$", gap):
                continue
        elif re.search(r"[$€£¥]\s?_\{?$", before) or _exponent(before, t):
            continue
        out.append(m)
    return out


def parse(s: str) -> Parsed:
    """All of a normalized span."""
    s = re.sub(r"(?: and|,)$", "", s.strip())
    lifted, marks = _lift(s)
    found = _numbers(lifted)
    if not found:
        return Parsed("unknown")
    out = Parsed("single_quantity")
    heads, tails, kept = [lifted[: found[0].start()]], [], [found[0]]
    for m in found[1:]:
        gap = lifted[kept[-1].end() : m.start()]
        text = m.group()
        # a sign between two numbers is a separator
        signed = re.match(r"[-+] ?", text)
        if signed and not gap.strip():
            cut: tuple[str, tuple[str, str], str] | None = ("", ("-", "range_separator"), "") if text[0] == "-" else None
            shown = text[signed.end() :]
        else:
            cut, shown = _cut(gap), text
        if cut is None:
            continue
        tails.append(cut[0])
        out.separators.append(cut[1])
        heads.append(cut[2])
        kept.append(m)
        if shown is not text:
            heads[-1] = ""
    ends = [*tails, lifted[kept[-1].end() :]]
    for i, m in enumerate(kept):
        q = Quantity(text=m.group().strip())
        if i and q.text[0] in "-+" and not lifted[kept[i - 1].end() : m.start()].strip():
            q.text = q.text[1:].strip()
        _head(heads[i], q)
        q.value = number(q.text)
        q.imprecise = q.value is None or _IMPRECISE.fullmatch(q.text) is not None
        if q.imprecise:
            q.value = None
        _tail(ends[i], q, marks)
        out.quantities.append(q)
    _settle(out, s)
    return out


def _settle(out: Parsed, s: str) -> None:
    """Kind, ellipses, and how far the reading is to be trusted."""
    qs = out.quantities
    kinds = {k.removesuffix("_separator") for _, k in out.separators}
    if len(qs) > 1:
        out.kind = kinds.pop() if len(kinds) == 1 else "unknown"
        if out.kind == "range" and len(qs) != 2:
            out.kind = "unknown"
        if out.kind == "list" and re.search(r"\bbetween\b", s, re.IGNORECASE):
            out.kind = "range"
    last = qs[-1]
    for q in qs[:-1]:
        if q.prefix is None and q.suffix is None and out.kind != "ratio" and (last.prefix or last.suffix):
            q.prefix, q.suffix, q.ellipsed = last.prefix, last.suffix, True
        if out.kind in ("range", "list") and (m := re.search(rf" ({_MAGNITUDE})$", last.text, re.IGNORECASE)) and q.value is not None and last.value is not None and re.fullmatch(_DIGITS, q.text):
            q.value *= 10.0 ** lexicon.MAGNITUDES[m[1].lower()]
    arity = {"single_quantity": len(qs) == 1, "range": len(qs) == 2}.get(out.kind, len(qs) >= 2)
    if not arity or any(q.uncertainty is not None and not q.uncertainty.lb < q.uncertainty.ub for q in qs):
        out.success = False
        return
    score = 0
    for q in qs:
        score += 3 * (q.value is None and not q.imprecise)
        score += sum(u is not None and u[1] is None and not re.fullmatch(r"[A-Za-z \-]{3,}", u[0]) or u is not None and u[1] is None and " " in u[0] for u in (q.prefix, q.suffix)) * (not q.ellipsed)
    if out.kind == "range" and None not in (qs[0].value, qs[1].value):
        score += qs[0].value >= qs[1].value > 0
    score += out.kind == "unknown"
    out.success = False if score > 2 else None if score > 0 else True
