"""Modifiers in and around a span of a text, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from measurelake.functions import lexicon
from measurelake.functions.text import let, trie

_WORDS = trie([m for m in lexicon.PREFIXED_MODIFIERS if m[-1].isalnum() or m.endswith(".")])
_SIGNS = trie([m for m in lexicon.PREFIXED_MODIFIERS if not (m[-1].isalnum() or m.endswith("."))])
_SUFFIXES = trie(lexicon.SUFFIXED_MODIFIERS)
_PREFIX = rf"(?:(?:(?<!\w)(?:{_WORDS})(?!\w)|(?:{_SIGNS}))\s?)+"
_BEFORE, _FIRST = rf"(?i)({_PREFIX})$", rf"(?i)^({_PREFIX})"
_AFTER, _LAST = rf"(?i)^(\s?(?:{_SUFFIXES})(?!\w))", rf"(?i)((?<!\w)(?:{_SUFFIXES}))$"
#: The sentence that a text ends in, and the one before it.
_TWO_SENTENCES = r"((?:(?:[^.!?]|[.!?](?!\s))*[.!?]\s+)?(?:[^.!?]|[.!?](?!\s)|[.!?]\s+(?=\W*$))*)$"


def with_modifiers(text: Column, start: Column, end: Column) -> Column:
    """struct<modifiers, start, end, text>: modifiers of the span text[start:end] in order, and the span widened to hold them.

    A modifier touches the span or is one blank away, or begins or ends the span itself; neighbours are one. What is
    before is looked for in the span's sentence and the one before. A span that begins with a bracket is misaligned
    and has none.
    """

    # each search is bound, as a lambda's body looks again for whatever it names twice
    def searched(x: Column) -> Column:
        return F.struct(x["span"], F.regexp_extract(x["left"], _BEFORE, 1).alias("before"), F.regexp_extract(x["right"], _AFTER, 1).alias("after"), F.trim(F.regexp_extract(x["span"], _FIRST, 1)).alias("first"), F.trim(F.regexp_extract(x["span"], _LAST, 1)).alias("last"))

    def made(x: Column) -> Column:
        span, before, after, first, last = (x[k] for k in ("span", "before", "after", "first", "last"))
        aligned = ~span.rlike(r"^[(\[{]")
        led = F.trim(F.concat(before, first))
        found = F.when(aligned, F.array_remove(F.array(led, F.when((first == span) & (last == span), "").otherwise(last), F.trim(after)), "")).otherwise(F.array().cast("array<string>"))
        a = F.when(aligned, start - F.length(F.ltrim(before))).otherwise(start).cast("int")
        b = F.when(aligned, end + F.length(after)).otherwise(end).cast("int")
        return F.struct(found.alias("modifiers"), a.alias("start"), b.alias("end"), F.substring(text, a + 1, b - a).alias("text"))

    parts = F.struct(F.substring(text, start + 1, end - start).alias("span"), F.regexp_extract(F.substring(text, F.lit(1), start), _TWO_SENTENCES, 1).alias("left"), F.substring(text, end + 1, F.length(text)).alias("right"))
    return let(let(parts, searched), made)


def modifiers(text: Column, start: Column, end: Column) -> Column:
    """The modifiers of the span text[start:end]; an empty array if there are none."""
    return with_modifiers(text, start, end)["modifiers"]
