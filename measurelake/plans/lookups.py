"""The unit lookups as a dataflow: from triples to units, surfaces, priorities and differences.

Triples are rows (s, p, o, lang). Units are rows with `uri` and columns or arrays of what is known of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TYPE = "rdf:type"


def units_of(triples: DataFrame, classes: list[str], properties: dict[str, str], languages: tuple[str, ...] = ("en",)) -> DataFrame:
    """(uri, key, value): what is known of the subjects of one of `classes`, each value once; keys by property name.

    Values with a language are kept in `languages` only; a subject without any property has one row of nulls. One pass
    over the triples per side and one join, however many properties there are.
    """
    subjects = triples.where((F.col("p") == TYPE) & F.col("o").isin(*classes)).select(F.col("s").alias("uri")).distinct()
    keys = F.create_map(*(F.lit(x) for kv in properties.items() for x in kv))
    values = triples.where(F.col("p").isin(*properties) & (F.col("lang").isNull() | F.col("lang").isin(*languages)))
    values = values.select(F.col("s").alias("uri"), F.element_at(keys, F.col("p")).alias("key"), F.col("o").alias("value")).distinct()
    return subjects.join(values, "uri", "left")


def nested(rows: DataFrame) -> DataFrame:
    """(uri, known map<string, array<string>>) of (uri, key, value): the distinct values of each key in order."""
    per_key = rows.where(F.col("key").isNotNull()).groupBy("uri", "key").agg(F.array_sort(F.collect_set("value")).alias("values"))
    known = per_key.groupBy("uri").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "values")))).alias("known"))
    return rows.select("uri").distinct().join(known, "uri", "left").withColumn("known", F.coalesce("known", F.create_map().cast("map<string,array<string>>")))


def unique_keys(df: DataFrame, key: str, value: str = "uri") -> DataFrame:
    """(key, value) of the keys that have exactly one distinct value; others would be ambiguous in a lookup."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_high")).where(F.col(value) == F.col("_high")).drop("_high")


def unique_by_frequency(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs once; counts combine before the join back."""
    return df.join(df.groupBy(key).agg(F.count("*").alias("_n")).where("_n = 1").select(key), key, "left_semi")


def enrich_by_any(units: DataFrame, other: DataFrame, keys: list[str], take: list[str]) -> DataFrame:
    """`units` joined with `other` on any of `keys` that both have: one equi-join for each key, matches united once each."""
    found = [units.select("uri", F.col(k).alias("_k")).join(other.select(F.col(k).alias("_k"), *take), "_k").select("uri", *take) for k in keys]
    united = found[0]
    for x in found[1:]:
        united = united.unionByName(x)
    return units.join(united.distinct(), "uri", "left")


def coalesced_lookup(df: DataFrame, first: DataFrame, second: DataFrame, first_key: str, second_key: str, guard: Column | None = None) -> DataFrame:
    """`df` with uri: by the unique match of `first_key` in `first`, or else of `second_key` in `second`; null where `guard` fails."""
    a, b = (unique_keys(x, k).select(F.col(k).alias(f"_{i}k"), F.col("uri").alias(f"_{i}")) for i, (x, k) in enumerate(((first, first_key), (second, second_key))))
    out = df.join(a, df[first_key] == a["_0k"], "left").join(b, df[second_key] == b["_1k"], "left")
    uri = F.coalesce("_0", "_1")
    return out.select(*(df[c] for c in df.columns), (uri if guard is None else F.when(guard, uri)).alias("uri"))


def canonical(units: DataFrame, matches: DataFrame, rounds: int = 32) -> DataFrame:
    """(uri, canonical): the shortest, then least uri of those reachable by exact matches (a, b) between compatible units.

    Units are compatible if dimension, multiplier and offset are equal, nulls included. Ranks spread over the matches
    until nothing changes; a chain longer than `rounds` raises.
    """
    facts = units.select("uri", F.struct("dimension", "multiplier", "offset").alias("f"))
    both = matches.select("a", "b").unionByName(matches.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    fits = both.join(facts.select(F.col("uri").alias("a"), F.col("f").alias("fa")), "a").join(facts.select(F.col("uri").alias("b"), F.col("f").alias("fb")), "b").where(F.col("fa").eqNullSafe(F.col("fb"))).select("a", "b").persist()
    rank = F.struct(F.length("uri").alias("n"), F.col("uri").alias("u"))
    labels = units.select("uri", rank.alias("best"))
    for _ in range(rounds):
        near = fits.join(labels.select(F.col("uri").alias("b"), "best"), "b").groupBy(F.col("a").alias("uri")).agg(F.min("best").alias("near"))
        step = labels.join(near, "uri", "left").select("uri", F.least("best", F.coalesce("near", "best")).alias("new"), "best").persist()
        done = step.where("new <> best").isEmpty()
        labels = step.select("uri", F.col("new").alias("best"))
        if done:
            return labels.select("uri", F.col("best.u").alias("canonical"))
    raise RuntimeError("chains of matches are longer than `rounds`")


def merged(units: DataFrame, names: DataFrame, arrays: list[str]) -> DataFrame:
    """One row for each canonical uri of `names`: the united values of `arrays`, and the first non-null of the other columns."""
    rows = units.join(names, "uri")
    rest = [c for c in units.columns if c not in ("uri", *arrays)]
    aggs = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in arrays] + [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("uri"))).alias(c) for c in rest]
    return rows.groupBy(F.col("canonical").alias("uri")).agg(*aggs)


def surfaces(units: DataFrame, labels: list[str], symbols: list[str]) -> DataFrame:
    """(surface, uri, kind): labels in lower case, but those of fewer than three letters are symbols; symbols as they are."""
    each = [units.select("uri", F.explode(c).alias("surface"), F.lit(kind).alias("kind")) for kind, cols in (("label", labels), ("symbol", symbols)) for c in cols]
    out = each[0]
    for x in each[1:]:
        out = out.unionByName(x)
    short = F.length(F.regexp_replace("surface", r"\P{L}", "")) < 3
    kind = F.when((F.col("kind") == "label") & short, "symbol").otherwise(F.col("kind"))
    return out.withColumn("kind", kind).select(F.when(F.col("kind") == "label", F.lower("surface")).otherwise(F.col("surface")).alias("surface"), "uri", "kind").where("surface <> ''").distinct()


def inverted(named: DataFrame) -> DataFrame:
    """(kind, surface, uris) of (surface, uri, kind): all uris of a surface in order."""
    return named.groupBy("kind", "surface").agg(F.array_sort(F.collect_set("uri")).alias("uris"))


def pruned(index: DataFrame, special: list[str]) -> DataFrame:
    """`index` without uris that hold one of `special` (regional, dry, nautical variants) where a surface has others."""
    plain = F.filter("uris", lambda u: ~u.rlike("|".join(special)))
    return index.withColumn("uris", F.when((F.size("uris") > 1) & (F.size(plain) > 0), plain).otherwise(F.col("uris")))


def ranked(index: DataFrame) -> DataFrame:
    """(kind, surface, uri, priority) of surfaces with several uris: the name most like the surface first, then the shorter and lesser uri."""
    each = index.where(F.size("uris") > 1).select("kind", "surface", F.explode("uris").alias("uri"))
    name = F.lower(F.regexp_extract("uri", "([^/#]*)$", 1))
    alike = 1 - F.levenshtein(F.lower("surface"), name) / F.greatest(F.length("surface"), F.length(name))
    order = Window.partitionBy("kind", "surface").orderBy(F.desc(alike), F.length("uri"), "uri")
    return each.withColumn("priority", F.row_number().over(order))


def catalog(units: DataFrame, single: list[str]) -> DataFrame:
    """`uri` and the only value of each of the array columns `single`, or null; more than one value raises when it is read."""
    one = lambda c: F.when(F.assert_true(F.size(c) <= 1, F.concat(F.lit(f"several values of {c}: "), F.col("uri"))).isNull(), F.get(c, F.lit(0)))
    return units.select("uri", *(one(c).alias(c) for c in single))


def transferred(new: DataFrame, old: DataFrame) -> DataFrame:
    """`new` priorities (surface, uri) ranked as in `old` (surface, uri, priority).

    Pairs whose old priority is null stay null: they are switched off. Pairs that are new come behind the known ones,
    the shorter uri first.
    """
    was = old.select("surface", "uri", F.col("priority").alias("_old"), F.lit(True).alias("_known"))
    rows = new.select("surface", "uri").join(was, ["surface", "uri"], "left")
    off = F.col("_known").isNotNull() & F.col("_old").isNull()
    order = Window.partitionBy("surface", off).orderBy(F.col("_old").asc_nulls_last(), F.length("uri"), "uri")
    return rows.select("surface", "uri", F.when(~off, F.row_number().over(order)).alias("priority"))


def ambiguity(index: DataFrame, kinds: DataFrame) -> DataFrame:
    """One row: ambiguous surfaces, the mean number of their uris, and how many are told apart by the uris' quantity kinds (uri, kind_of)."""
    several = index.where(F.size("uris") > 1).select("kind", "surface", F.size("uris").alias("n"), F.explode("uris").alias("uri"))
    per = several.join(kinds, "uri", "left").groupBy("kind", "surface").agg(F.max("n").alias("n"), F.countDistinct("kind_of").alias("kinds"))
    return per.agg(F.count("*").alias("surfaces"), F.avg("n").alias("mean_uris"), F.count_if(F.col("kinds") == F.col("n")).alias("separable"))


def patched(df: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """Rows of `df` and `added`, each once, without those of `removed`."""
    return df.unionByName(added).distinct().join(removed, df.columns, "left_anti")


def conflicts(named: DataFrame, first: str, second: str) -> DataFrame:
    """`named` without rows of `first`-like uris where the surface also has a `second`-like one (a cent beside a currency)."""
    of = Window.partitionBy("surface")
    both = F.max(F.col("uri").contains(second)).over(of)
    return named.withColumn("_both", both).where(~(F.col("_both") & F.col("uri").contains(first))).drop("_both")


def audit(named: DataFrame) -> DataFrame:
    """(surface, reason) of what a person should look at: blanks at an end, digits only, or kinds that differ."""
    flags = {"blank": F.col("surface") != F.trim("surface"), "digits": F.col("surface").rlike(r"^\d+$")}
    rows = named.groupBy("surface").agg(F.countDistinct("kind").alias("kinds"))
    reasons = F.array_compact(F.array(*(F.when(c, n) for n, c in flags.items()), F.when(F.col("kinds") > 1, "kinds")))
    return rows.select("surface", F.explode(reasons).alias("reason"))


def differences(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, status): `new`, `removed`, `changed` or `unchanged`, by a full outer join on unique keys; nulls are values."""
    a, b = old.select(F.col(key), F.col(value).alias("_old"), F.lit(True).alias("_a")), new.select(F.col(key), F.col(value).alias("_new"), F.lit(True).alias("_b"))
    same = F.col("_old").eqNullSafe(F.col("_new"))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "removed").when(same, "unchanged").otherwise("changed").alias("status"))
