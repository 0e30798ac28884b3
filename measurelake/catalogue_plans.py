"""Queries over the driver's tables for formatting, modifiers in text, money, evaluation and lookups, with their twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from measurelake.catalogue import _pick, _table, query
from measurelake.functions import formatting as N
from measurelake.operators.candidates import interpret, tokens
from measurelake.operators.modifiers import with_modifiers
from measurelake.operators.quantities import spread
from measurelake.operators.units import exchange
from measurelake.plans import evaluation, lookups


# ---- numbers as text


@query("SELECT p_partkey, CASE WHEN p_size % 8 = 0 THEN (p_size // 8)::VARCHAR WHEN p_size % 4 = 0 THEN (p_size // 4) || '/2' WHEN p_size % 2 = 0 THEN (p_size // 2) || '/4' ELSE p_size || '/8' END AS fraction FROM part")
def fraction_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_table(spark, sf_dir, "part")).select("p_partkey", N.fraction_text(F.col("p_size") / 8).alias("fraction"))


@query("SELECT o_orderkey, printf('%.3f', o_custkey / 1000.0) || '×10^3' AS scientific, format('{:,}', o_custkey) AS grouped FROM orders")
def number_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_custkey").cast("double")
    return _table(spark, sf_dir, "orders").select("o_orderkey", N.number_text(c, exponent=3, precision=3).alias("scientific"), N.number_text(c, separator=",", precision=0).alias("grouped"))


_ONES = "list_value('one','two','three','four','five','six','seven','eight','nine')"
_TENS = "list_value('ten','twenty','thirty','forty','fifty','sixty','seventy','eighty','ninety')"


@query(f"SELECT p_partkey, {_TENS}[n // 10] || CASE WHEN n % 10 > 0 THEN '-' || {_ONES}[n % 10] ELSE '' END || ' thousand and ' || {_ONES}[n % 9 + 1] AS words FROM (SELECT p_partkey, p_partkey % 80 + 20 AS n FROM part)")
def number_spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey") % 80 + 20
    return _table(spark, sf_dir, "part").select("p_partkey", N.spelled(n * 1000 + n % 9 + 1).alias("words"))


@query("SELECT s_suppkey, 2::BIGINT AS spellings, true AS has_own FROM supplier")
def number_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_suppkey") % 9 + 21  # twenty-one to twenty-nine: hyphen or blank
    all_of = N.spellings(n)
    return _table(spark, sf_dir, "supplier").select("s_suppkey", F.size(all_of).cast("long").alias("spellings"), F.array_contains(all_of, N.spelled(n, hyphen=False)).alias("has_own"))


@query("SELECT o_orderkey, abs(o_custkey - o_orderkey)::DOUBLE / greatest(o_orderkey::DOUBLE, 2.220446049250313e-16::DOUBLE) AS error FROM orders")
def relative_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_orderkey", N.relative_error(F.col("o_orderkey").cast("double"), F.col("o_custkey").cast("double")).alias("error"))


@query("SELECT s_suppkey, true AS plain, true AS scientific, true AS word, false AS wrong FROM supplier")
def digit_notations(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("s_suppkey") % 9 + 1
    n = size.cast("double") * 1000
    holds = lambda x: F.array_contains(N.notations(n), F.concat(size.cast("string"), F.lit(x)))
    return _table(spark, sf_dir, "supplier").select("s_suppkey", holds("000").alias("plain"), holds("×10^3").alias("scientific"), holds(".0 thousand").alias("word"), holds("×10^6").alias("wrong"))


@query("SELECT CASE p_partkey % 3 WHEN 0 THEN 'cm' WHEN 1 THEN 's' ELSE 'm' END AS unit, CASE p_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN -1 ELSE 1 END AS exponent, count(*) AS n FROM part GROUP BY 1, 2")
def ucum_exponents(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = N.split_exponent(_pick(F.col("p_partkey"), "cm2", "s-1", "m"))
    return _table(spark, sf_dir, "part").select(split.alias("x")).groupBy("x.unit", "x.exponent").agg(F.count("*").alias("n"))


# ---- modifiers and money


@query(
    "SELECT CASE o_orderkey % 4 WHEN 0 THEN 'approximately' WHEN 1 THEN 'or higher' WHEN 2 THEN 'about' ELSE '' END AS modifiers, CASE o_orderkey % 4 WHEN 0 THEN 'approximately 5 kg' WHEN 1 THEN '5 kg or higher' WHEN 2 THEN 'about 5 kg' ELSE '(5 kg' END AS widened, count(*) AS n FROM orders GROUP BY 1, 2"
)
def modifiers_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    before, span, after = _pick(k, "It fell. The load is approximately ", "the load is ", "the load is ", "about "), _pick(k, "5 kg", "5 kg", "about 5 kg", "(5 kg"), _pick(k, ", it says", " or higher when seen", " there", " key")
    found = with_modifiers(F.concat(before, span, after), F.length(before), F.length(before) + F.length(span))
    return spread(_table(spark, sf_dir, "orders")).select(found.alias("x")).groupBy(F.array_join("x.modifiers", "|").alias("modifiers"), F.col("x.text").alias("widened")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey * (CASE o_orderkey % 3 WHEN 0 THEN 2.0 WHEN 1 THEN 1.5 ELSE 1.0 END) * (CASE o_orderkey % 2 WHEN 0 THEN 4.0 ELSE 1.0 END) AS amount FROM orders")
def currency_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    cpi = spark.createDataFrame([(c, y, r) for c in ("EUR", "USD") for y, r in ((2000, 1.0), (2010, 4.0 / 3.0), (2020, 2.0))], "currency string, year int, rate double")
    fx = spark.createDataFrame([("EUR", 2020, 2.0), ("USD", 2020, 0.5)], "currency string, year int, rate double")
    k = F.col("o_orderkey")
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("double").alias("v"), _pick(k, "EUR", "USD").alias("c"), F.element_at(F.array(F.lit(2000), F.lit(2010), F.lit(2020)), (k % 3 + 1).cast("int")).alias("y"))
    return exchange(rows, "v", "c", "y", "USD", 2020, cpi, fx, "amount").select("o_orderkey", F.round("amount", 6).alias("amount"))


# ---- readings


@query("SELECT p_partkey, p_size || '|-|' || (p_size + 3) || '| |kg' AS tokens FROM part")
def quantity_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.col("p_size").cast("string"), F.lit("-"), (F.col("p_size") + 3).cast("string"), F.lit(" kg"))
    return _table(spark, sf_dir, "part").select("p_partkey", F.array_join(tokens(text), "|").alias("tokens"))


@query("SELECT CASE k WHEN 0 THEN 'single_quantity' WHEN 1 THEN 'range' WHEN 2 THEN 'list' WHEN 3 THEN 'ratio' ELSE 'multidim' END AS type, CASE k WHEN 0 THEN 'msnsu' WHEN 1 THEN 'nsrsnsu' WHEN 2 THEN 'nslsnsu' WHEN 3 THEN 'nsqsn' ELSE 'nsxsnsxsnsu' END AS roles, CASE k WHEN 0 THEN 1 WHEN 4 THEN 3 ELSE 2 END::INT AS quantities, count(*) AS n FROM (SELECT p_partkey % 5 AS k FROM part) GROUP BY ALL")
def quantity_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("p_size").cast("string"), (F.col("p_size") + 12).cast("string")
    text = F.concat_ws(" ", *(F.element_at(F.array(*x), (F.col("p_partkey") % 5 + 1).cast("int")) for x in ((F.lit("about"), a, a, a, F.concat(a, F.lit(" x"))), (a, F.lit("to"), F.lit("and"), F.lit("out of"), b), (F.lit("kg"), F.concat(b, F.lit(" kg")), F.concat(b, F.lit(" kg")), b, F.concat(F.lit("x "), b, F.lit(" mm"))))))
    r = interpret(spread(_table(spark, sf_dir, "part")), text, "r")
    return r.groupBy("r.type", "r.roles", "r.quantities").agg(F.count("*").alias("n"))


# ---- evaluation


@query("SELECT CASE WHEN p_partkey % 11 = 0 THEN 'false' WHEN p_partkey % 5 = 0 THEN 'false' WHEN p_partkey % 7 = 0 THEN 'manual' ELSE 'correct' END AS decision, count(*) AS n FROM part GROUP BY 1")
def gold_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, k = _table(spark, sf_dir, "part"), F.col("p_partkey")
    value = F.col("p_size").cast("double")
    gold = part.select(k.alias("id"), F.lit("single_quantity").alias("type"), F.array(value).alias("values"), F.array(F.lit("length"), F.lit("mass")).alias("units"))
    parsed = part.where(k % 11 != 0).select(k.alias("id"), F.lit("single_quantity").alias("type"), F.array(value + F.when(k % 5 == 0, 1).otherwise(0)).alias("values"), F.when(k % 7 == 0, F.array(F.lit("time"))).otherwise(F.array(F.lit("mass"), F.lit("length"))).alias("units"))
    return evaluation.compare(gold, parsed, ["id"]).groupBy("decision").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN r <= 919 THEN 'train' ELSE 'dev' END AS split, count(*) AS n, min(o_orderkey) AS first FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders) GROUP BY 1")
def positional_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.positional_split(_table(spark, sf_dir, "orders"), "o_orderkey", 919).groupBy("split").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query("SELECT CASE WHEN o_orderkey % 3 > 0 THEN 'correct' WHEN o_orderkey % 2 = 0 THEN 'false' ELSE 'manual' END AS decision, count(*) AS n FROM orders GROUP BY 1")
def manual_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = _table(spark, sf_dir, "orders").select(F.when(k % 3 > 0, "correct").otherwise("manual").alias("decision"), F.when(k % 2 == 0, "false").alias("manual_decision"))
    return evaluation.regroup(rows).groupBy("decision").agg(F.count("*").alias("n"))


_CURATED = "SELECT c_nationkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 2 = 0 THEN 'kept' END AS note FROM customer"


@query(f"SELECT n.c_nationkey, n.segment, coalesce(n.note, o.note) AS note, count(*) AS n FROM ({_CURATED}) n LEFT JOIN (SELECT c_nationkey, segment, min(note) AS note FROM (SELECT c_nationkey, segment, 'old ' || c_nationkey AS note FROM ({_CURATED}) WHERE c_nationkey % 2 = 0) GROUP BY 1, 2) o ON n.c_nationkey = o.c_nationkey AND n.segment IS NOT DISTINCT FROM o.segment GROUP BY ALL")
def curation_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    new = _table(spark, sf_dir, "customer").select("c_nationkey", F.when(k % 4 != 0, F.col("c_mktsegment")).alias("segment"), F.when(k % 2 == 0, "kept").alias("note"))
    old = new.where(F.col("c_nationkey") % 2 == 0).withColumn("note", F.concat(F.lit("old "), F.col("c_nationkey").cast("string")))
    return evaluation.transfer_curation(new, old, ["note"]).groupBy("c_nationkey", "segment", "note").agg(F.count("*").alias("n"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return _table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("file"), (k % 5 > 0).alias("correct"), F.when(k % 3 == 0, None).otherwise(k % 3 == 1).alias("success"), F.when(k % 5 == 0, _pick(F.col("o_custkey"), "unit", "value", "gold")).alias("error_category"))


_JUDGED = "(SELECT o_orderpriority AS file, o_orderkey % 5 > 0 AS correct, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 3 = 1 END AS success, CASE WHEN o_orderkey % 5 = 0 THEN CASE o_custkey % 3 WHEN 0 THEN 'unit' WHEN 1 THEN 'value' ELSE 'gold' END END AS error_category FROM orders)"


@query(f"SELECT file, count(*) AS n, count_if(correct)::DOUBLE / count(*) AS accuracy, count_if(correct)::DOUBLE / count_if(error_category IS NULL OR error_category <> 'gold') AS accuracy_kept FROM {_JUDGED} GROUP BY file")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.accuracy(_judged(spark, sf_dir), ["file"], ("gold",))


_MATRIX = f"(SELECT file, count_if(coalesce(success, false) AND correct) AS tp, count_if(coalesce(success, false) AND NOT correct) AS fp, count_if(NOT coalesce(success, false) AND correct) AS fn, count_if(NOT coalesce(success, false) AND NOT correct) AS tn FROM {_JUDGED} GROUP BY file)"


@query(f"SELECT file, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM {_MATRIX}")
def self_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.self_assessment(_judged(spark, sf_dir), ["file"]).withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(f"SELECT error_category AS category, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM {_JUDGED} WHERE error_category IS NOT NULL GROUP BY 1")
def error_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.error_categories(_judged(spark, sf_dir))


@query(f"SELECT error_category AS category, count_if(file = '1-URGENT')::BIGINT AS \"1-URGENT\", count_if(file = '5-LOW')::BIGINT AS \"5-LOW\", 0::BIGINT AS none FROM {_JUDGED} WHERE error_category IS NOT NULL GROUP BY 1")
def error_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.category_table(_judged(spark, sf_dir), "file", ["1-URGENT", "5-LOW", "none"])


# ---- lookups


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part").withColumn("s", F.concat(F.lit("u/"), F.col("p_partkey").cast("string")))
    row = lambda p, o, lang=None: F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit(lang).cast("string").alias("lang"))
    k = F.col("p_partkey")
    facts = F.array(row("rdf:type", _pick(k, "Unit", "Derived", "Other")), row("label", F.col("p_brand"), "en"), row("label", F.lit("fremd"), "de"), row("dim", _pick(k, "L", "M")), row("note", F.lit("x")))
    return part.select("s", F.explode(facts).alias("f")).select("s", "f.*")


@query("SELECT 'u/' || p_partkey AS uri, 2::BIGINT AS keys, p_brand AS label, CASE p_partkey % 2 WHEN 0 THEN 'L' ELSE 'M' END AS dim FROM part WHERE p_partkey % 3 <> 2")
def unit_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = lookups.nested(lookups.units_of(_triples(spark, sf_dir), ["Unit", "Derived"], {"label": "label", "dim": "dimension"}))
    return units.select("uri", F.size("known").cast("long").alias("keys"), F.get(F.col("known")["label"], F.lit(0)).alias("label"), F.get(F.col("known")["dimension"], F.lit(0)).alias("dim"))


@query("SELECT s_nationkey, min(s_suppkey) AS uri FROM supplier GROUP BY 1 HAVING count(*) = 1")
def unique_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.unique_keys(_table(spark, sf_dir, "supplier").select("s_nationkey", F.col("s_suppkey").alias("uri")), "s_nationkey")


@query("SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey IN (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING count(*) = 1)")
def unique_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.unique_by_frequency(_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey")


@query("SELECT c_custkey AS uri, n_name AS name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey OR c_custkey = n_nationkey")
def enrichment_by_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uri"), F.col("c_nationkey").cast("long").alias("a"), F.col("c_custkey").cast("long").alias("b"))
    other = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("a"), F.col("n_nationkey").cast("long").alias("b"), F.col("n_name").alias("name"))
    return lookups.enrich_by_any(units, other, ["a", "b"], ["name"]).select("uri", "name")


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN n_name ELSE upper(r_name) END AS uri FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def coalesced_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    c = _table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = c.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("n_nationkey")).alias("article"), F.col("n_regionkey").alias("code"))
    articles = nation.select(F.col("n_nationkey").alias("article"), F.col("n_name").alias("uri"))
    codes = region.select(F.col("r_regionkey").alias("code"), F.upper("r_name").alias("uri"))
    return lookups.coalesced_lookup(rows, articles, codes, "article", "code", F.col("c_custkey") % 10 != 0).select("c_custkey", "uri")


@query("SELECT 'n' || min(n_nationkey) AS uri, count(*) AS members, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def exact_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _table(spark, sf_dir, "nation")
    uri = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    units = nation.select(uri("n_nationkey").alias("uri"), F.col("n_regionkey").alias("dimension"), F.lit(1.0).alias("multiplier"), F.lit(None).cast("double").alias("offset"), F.array("n_name").alias("labels"))
    matches = nation.select(uri("n_nationkey").alias("a"), F.concat(F.lit("n"), (F.col("n_nationkey") + 1).cast("string")).alias("b")).unionByName(nation.alias("x").join(nation.alias("y"), "n_regionkey").select(F.concat(F.lit("n"), F.col("x.n_nationkey").cast("string")).alias("a"), F.concat(F.lit("n"), F.col("y.n_nationkey").cast("string")).alias("b")))
    names = lookups.canonical(units, matches)
    merged = lookups.merged(units, names, ["labels"])
    return merged.select("uri", F.size("labels").cast("long").alias("members"), F.array_join("labels", "|").alias("names"))


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surfaces by nation, of which the regional variant is one of two or three readings."""
    s = _table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    units = s.select(F.concat(_pick(k, "x/metre", "x/metre_IT", "x/m"), F.lit("_"), (F.col("s_nationkey") % 4).cast("string")).alias("uri"), F.array(F.concat(F.lit("Metre "), F.col("s_nationkey").cast("string")), F.lit("M")).alias("names"), F.array(F.lit("m")).alias("marks"))
    return lookups.inverted(lookups.surfaces(units, ["names"], ["marks"]))


_NAMED = "(SELECT DISTINCT kind, surface, uri FROM (SELECT CASE s_suppkey % 3 WHEN 0 THEN 'x/metre' WHEN 1 THEN 'x/metre_IT' ELSE 'x/m' END || '_' || (s_nationkey % 4) AS uri, unnest(list_value('label', 'symbol', 'symbol')) AS kind, unnest(list_value('metre ' || s_nationkey, 'M', 'm')) AS surface FROM supplier))"
_PRUNED = f"(SELECT * FROM (SELECT *, count(*) OVER w AS n, count_if(uri NOT LIKE '%\\_IT%' ESCAPE '\\') OVER w AS plain FROM {_NAMED} WINDOW w AS (PARTITION BY kind, surface)) WHERE n = 1 OR plain = 0 OR uri NOT LIKE '%\\_IT%' ESCAPE '\\')"


@query(f"SELECT kind, surface, count(*) AS uris, min(uri) AS first FROM {_PRUNED} GROUP BY 1, 2")
def surface_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.pruned(_index(spark, sf_dir), ["_IT"]).select("kind", "surface", F.size("uris").cast("long").alias("uris"), F.get("uris", F.lit(0)).alias("first"))


_NAME = "split_part(uri, '/', 2)"


@query(
    f"SELECT kind, surface, uri, row_number() OVER (PARTITION BY kind, surface ORDER BY 1 - levenshtein(lower(surface), lower({_NAME}))::DOUBLE / greatest(length(surface), length({_NAME})) DESC, length(uri), uri)::INT AS priority"
    f" FROM (SELECT *, count(*) OVER (PARTITION BY kind, surface) AS m FROM {_NAMED}) WHERE m > 1"
)
def surface_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.ranked(_index(spark, sf_dir))


@query("SELECT p_partkey AS uri, p_brand AS brand, CASE WHEN p_size % 2 = 0 THEN p_size END AS size FROM part")
def unit_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("uri"), F.array("p_brand").alias("brand"), F.filter(F.array("p_size"), lambda s: s % 2 == 0).alias("size"))
    return lookups.catalog(units, ["brand", "size"]).withColumn("uri", F.col("uri").cast("long"))


@query(
    "SELECT surface, uri, CASE WHEN k % 5 = 0 AND k % 2 = 0 THEN NULL ELSE row_number() OVER (PARTITION BY surface, k % 5 = 0 AND k % 2 = 0 ORDER BY CASE WHEN k % 2 = 0 AND k % 5 > 0 THEN 1000000 - k END NULLS LAST, length(uri), uri) END::INT AS priority"
    " FROM (SELECT s_nationkey AS surface, 'u' || s_suppkey AS uri, s_suppkey AS k FROM supplier)"
)
def priority_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    new = _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("surface"), F.concat(F.lit("u"), k.cast("string")).alias("uri"), k.alias("k"))
    old = new.where("k % 2 = 0").withColumn("priority", F.when(F.col("k") % 5 > 0, 1000000 - F.col("k")))
    return lookups.transferred(new, old)


@query(f"SELECT count(*) AS surfaces, avg(n) AS mean_uris, count_if(kinds = n)::BIGINT AS separable FROM (SELECT kind, surface, count(*) AS n, count(DISTINCT length(uri)) AS kinds FROM {_NAMED} GROUP BY 1, 2) WHERE n > 1")
def ambiguity_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    kinds = index.select(F.explode("uris").alias("uri")).distinct().withColumn("kind_of", F.length("uri"))
    return lookups.ambiguity(index, kinds)


@query("SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_nationkey % 5 <> 0 UNION SELECT r_regionkey + 100, r_name FROM region")
def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    region = _table(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).alias("k"), F.col("r_name").alias("name"))
    return lookups.patched(nation.unionByName(nation), region, nation.where("k % 5 = 0"))


@query("SELECT s_nationkey AS surface, count(*) AS n FROM (SELECT *, max((s_suppkey % 3 = 0)::INT) OVER (PARTITION BY s_nationkey) AS money FROM supplier) WHERE NOT (money = 1 AND s_suppkey % 3 = 1) GROUP BY 1")
def surface_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("surface"), F.concat(_pick(F.col("s_suppkey"), "CCY_", "CENT_", "M_"), F.col("s_suppkey").cast("string")).alias("uri"))
    return lookups.conflicts(named, "CENT_", "CCY_").groupBy("surface").agg(F.count("*").alias("n"))


@query("SELECT reason, count(*) AS n FROM (SELECT DISTINCT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'blank' WHEN 1 THEN 'digits' ELSE 'kinds' END AS reason FROM supplier) GROUP BY 1")
def surface_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    named = _table(spark, sf_dir, "supplier").select(F.when(k % 3 == 0, F.concat(F.lit(" a"), s)).when(k % 3 == 1, s).otherwise(F.concat(F.lit("b"), s)).alias("surface"), F.explode(F.when(k % 3 == 2, F.array(F.lit("label"), F.lit("symbol"))).otherwise(F.array(F.lit("label")))).alias("kind"))
    return lookups.audit(named).groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN c_custkey % 4 = 0 THEN 'new' WHEN c_custkey % 4 = 1 THEN 'removed' WHEN c_custkey % 4 = 2 THEN 'changed' ELSE 'unchanged' END AS status, count(*) AS n FROM customer GROUP BY 1")
def lookup_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = _table(spark, sf_dir, "customer").select(k.alias("key"), F.when(k % 8 == 3, None).otherwise(F.col("c_name")).alias("value"))
    new = rows.where("key % 4 <> 1").withColumn("value", F.when(F.col("key") % 4 == 2, "other").otherwise(F.col("value")))
    return lookups.differences(rows.where("key % 4 <> 0"), new, "key", "value").groupBy("status").agg(F.count("*").alias("n"))
