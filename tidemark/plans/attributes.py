"""Queries on what a text says: name forms, amounts, dates, types, countdowns, colours and savings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import text as T
from tidemark.plans.names import LEGAL, NORM
from tidemark.tables import table

STRICT = f"regexp_replace({NORM}, '(\\s+({LEGAL}))+$', '')"


def name_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer's name in decorated spellings and the keys that see through them."""
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.concat("c_name", F.lit(" Group-"), "c_mktsegment", F.lit(" & Sons Limited (UK), *")).alias("x"), F.concat("c_mktsegment", F.lit(" parts (north), "), "c_name").alias("y"))
    clean = T.undecorated(F.col("x"))
    return c.select(
        "c_custkey", T.shallow_key(clean).alias("shallow"), T.form_key(clean).alias("form"), clean.alias("plain"), T.undecorated(clean).eqNullSafe(clean).alias("stable"),
        F.array_join(T.heads(F.col("y")), "|").alias("heads"), T.lead(F.col("y")).alias("lead"), T.keyword_string([F.col("x"), F.split("y", " ")], 60).alias("keywords"),
        F.array_join(T.number_forms(F.col("c_custkey").cast("string")), "|").alias("numbers"), F.array_join(T.word_pairs(F.col("y")), "|").alias("queries"), T.titled(F.lower(F.concat_ws(" ", F.lit("the nhs of"), "c_mktsegment", F.lit("and the rest")))).alias("title"),
    )


_H = "list_filter(list_transform(regexp_split_to_array(y, '[(),/]'), lambda c: " + STRICT.format(x="replace(c, '&', ' and ')") + "), lambda c: c <> '')"
NAME_FORMS = f"""
WITH c AS (SELECT c_custkey, c_mktsegment AS seg, c_name || ' Group-' || c_mktsegment || ' & Sons Limited' AS plain, c_name || ' Group-' || c_mktsegment || ' & Sons Limited (UK), *' AS x, c_mktsegment || ' parts (north), ' || c_name AS y FROM customer),
h AS (SELECT *, {_H} AS hs, string_split({NORM.format(x='y')}, ' ') AS w FROM c)
SELECT c_custkey, regexp_replace(trim(regexp_replace(lower(plain), '[^a-z0-9&-]+', ' ', 'g')), '(\\s+(ltd|limited|plc|inc|llc|gmbh))+$', '') AS shallow,
  regexp_replace(replace(upper(plain), '.', ''), '\\bLIMITED\\b', 'LTD', 'g') AS form, plain, true AS stable, array_to_string(hs, '|') AS heads,
  CASE WHEN length(split_part(hs[1], ' ', 1)) >= 4 THEN split_part(hs[1], ' ', 1) ELSE hs[1] END AS lead, lower(x || ' ' || y)[1:60] AS keywords,
  CASE WHEN length(c_custkey::VARCHAR) < 8 THEN c_custkey::VARCHAR || '|' || lpad(c_custkey::VARCHAR, 8, '0') ELSE c_custkey::VARCHAR END AS numbers,
  w[1] || ' ' || w[2] || '|' || w[1] || '|' || array_to_string(w, '-') AS queries, 'The NHS of ' || seg[1] || lower(seg[2:]) || ' and the Rest' AS title FROM h
"""

TYPES = [("^promo", "promotional"), ("burnished|polished", "finished"), ("tin|steel|brass", "metal"), ("economy", "plain")]
LABELS = {"A": "accepted", "R": "returned"}


def attribute_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Every part's type by the first rule that fits, with its name as fallback; amounts and dates out of text; codes as labels."""
    p = table(spark, sf, "part")
    spoken = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("£"), F.col("p_size").cast("string"), F.lit(".5m"))).when(F.col("p_size") % 4 == 1, F.concat(F.col("p_size").cast("string"), F.lit(",250"))).when(F.col("p_size") % 4 == 2, F.concat(F.lit("$ "), F.col("p_size").cast("string"), F.lit(" thousand"))).otherwise("on request")
    dated = F.concat(F.lit("from 01/02/2019 to "), F.col("p_size").cast("string"), F.lit("/7/2024, see notes"))
    code = F.substring("p_brand", -1, 1)
    label = F.create_map(*[F.lit(x) for pair in {"1": "one", "2": "two"}.items() for x in pair])
    x = p.select("p_partkey", "p_type", "p_name", "p_retailprice", "p_size", spoken.alias("spoken"), dated.alias("dated"), code.alias("code"))
    return x.select(
        "p_partkey", T.first_match(F.lower("p_type"), TYPES, T.first_match(F.lower("p_name"), [("blue|green", "coloured")])).alias("kind"), T.first_match(F.lower("p_name"), [("^small", "small"), ("^large", "large")]).alias("proven_size"),
        T.money_units(F.col("spoken")).alias("amount"), T.gbp(T.money_units(F.col("spoken")).cast("double")).alias("shown"), T.last_date(F.col("dated")).alias("ends"), F.coalesce(F.try_element_at(label, "code"), "code").alias("label"),
        F.concat(F.substring_index("p_name", " ", -1), F.lit(": "), F.substring_index("p_name", " ", 1)).alias("swapped"),
    )


def _rules(x: str, rules: list[tuple[str, str]], otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '{p}') THEN '{v}'" for p, v in rules) + f" ELSE {otherwise} END"


ATTRIBUTES = f"""
WITH x AS (SELECT *, CASE p_size % 4 WHEN 0 THEN round((p_size + 0.5) * 1000000) WHEN 1 THEN p_size * 1000 + 250 WHEN 2 THEN p_size * 1000 END::BIGINT AS amount FROM part)
SELECT p_partkey, {_rules('lower(p_type)', TYPES, _rules('lower(p_name)', [('blue|green', 'coloured')]))} AS kind, {_rules('lower(p_name)', [('^small', 'small'), ('^large', 'large')])} AS proven_size, amount,
  CASE WHEN amount >= 1000000 THEN '£' || regexp_replace(printf('%.1f', amount / 1e6), '\\.0$', '') || 'm' WHEN amount >= 1000 THEN '£' || floor(amount / 1e3 + 0.5)::BIGINT || 'k' WHEN amount IS NOT NULL THEN '£' || amount END AS shown,
  try_strptime(p_size || '/7/2024', '%d/%m/%Y')::DATE AS ends, CASE right(p_brand, 1) WHEN '1' THEN 'one' WHEN '2' THEN 'two' ELSE right(p_brand, 1) END AS label,
  string_split(p_name, ' ')[-1] || ': ' || split_part(p_name, ' ', 1) AS swapped FROM x
"""


def countdown_tones(spark: SparkSession, sf: str) -> DataFrame:
    """Days left of every order under the four threshold sets: runway, tone, alarm and review."""
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1998-06-01").cast("date"))
    bucket = lambda *steps: _buckets(days, steps)
    x = table(spark, sf, "orders").select(
        bucket((0, "ended"), (15, "fortnight"), (91, "quarter"), (366, "year")).alias("runway"), bucket((0, "past"), (8, "week"), (31, "month")).alias("tone"), bucket((0, "past"), (46, "soon")).alias("alarm"), bucket((0, "past"), (91, "due"), (181, "planned")).alias("review"),
    )
    return x.groupBy("runway", "tone", "alarm", "review").agg(F.count("*").alias("n"))


def _buckets(days, steps):
    out = F.lit("later")
    for under, name in reversed(steps):
        out = F.when(days < under, name).otherwise(out)
    return out


def _buckets_sql(*steps) -> str:
    return "CASE " + " ".join(f"WHEN d < {under} THEN '{name}'" for under, name in steps) + " ELSE 'later' END"


COUNTDOWN = f"""
WITH x AS (SELECT date_diff('day', DATE '1998-06-01', o_orderdate::DATE) AS d FROM orders)
SELECT {_buckets_sql((0, 'ended'), (15, 'fortnight'), (91, 'quarter'), (366, 'year'))} AS runway, {_buckets_sql((0, 'past'), (8, 'week'), (31, 'month'))} AS tone, {_buckets_sql((0, 'past'), (46, 'soon'))} AS alarm,
  {_buckets_sql((0, 'past'), (91, 'due'), (181, 'planned'))} AS review, count(*) AS n FROM x GROUP BY 1, 2, 3, 4
"""


def price_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Each line against its part's retail price: a unit's saving, a year's, its cashable and capacity shares, and one instance's; null if an input is missing."""
    lines, part = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount"), table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size")
    x = lines.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    unit = F.col("p_retailprice") - F.col("l_extendedprice") / F.nullif("l_quantity", F.lit(0.0))
    volume = F.when(F.col("p_size") > 5, F.col("p_size"))
    year = unit * volume
    return x.select("l_orderkey", "l_linenumber", unit.alias("per_unit"), year.alias("per_year"), (year * F.col("l_discount")).alias("cashable"), (year * (1 - F.col("l_discount"))).alias("capacity"), (year / F.nullif("l_quantity", F.lit(0.0))).alias("per_instance"))


PRICE_DIFFERENCE = """
WITH x AS (SELECT *, p_retailprice - l_extendedprice / nullif(l_quantity, 0) AS u, CASE WHEN p_size > 5 THEN p_size END AS v FROM lineitem LEFT JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, l_linenumber, u AS per_unit, u * v AS per_year, u * v * l_discount AS cashable, u * v * (1 - l_discount) AS capacity, u * v / nullif(l_quantity, 0) AS per_instance FROM x
"""


def colour_contrast(spark: SparkSession, sf: str) -> DataFrame:
    """A colour for every part, its luminance, contrast with white, its lighter form, and the argmax colour of each brand among readable ones."""
    hexed = F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 6)
    return table(spark, sf, "part").select("p_partkey", hexed.alias("colour"), F.round(T.luminance(hexed), 6).alias("luminance"), F.round(T.contrast(hexed, F.lit("ffffff")), 4).alias("contrast"), T.mixed(hexed, F.lit("ffffff"), 0.25).alias("lighter"), T.mixed(hexed, F.lit("000000"), 0.5).alias("darker"))


def _channel(at: int) -> str:
    return f"('0x' || colour[{at}:{at + 1}])::BIGINT"


def _linear(at: int) -> str:
    return f"CASE WHEN {_channel(at)} / 255.0::DOUBLE <= 0.04045 THEN {_channel(at)} / 255.0::DOUBLE / 12.92 ELSE pow(({_channel(at)} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END"


def _moved(share: float, to: int) -> str:
    return " || ".join(f"lpad(lower(to_hex(floor({_channel(at)} + ({to} - {_channel(at)}) * {share}::DOUBLE + 0.5)::BIGINT)), 2, '0')" for at in (1, 3, 5))


COLOURS = f"""
WITH c AS (SELECT p_partkey, md5(p_partkey::VARCHAR)[1:6] AS colour FROM part), l AS (SELECT *, 0.2126 * {_linear(1)} + 0.7152 * {_linear(3)} + 0.0722 * {_linear(5)} AS lum FROM c)
SELECT p_partkey, colour, round(lum, 6) AS luminance, round(1.05 / (lum + 0.05), 4) AS contrast, {_moved(0.25, 255)} AS lighter, {_moved(0.5, 0)} AS darker FROM l
"""


def dominant_colour(spark: SparkSession, sf: str) -> DataFrame:
    """The commonest colour of each brand's lines among those neither too light nor too grey."""
    part = table(spark, sf, "part").select("p_partkey", "p_brand", F.substring(F.md5("p_type"), 1, 6).alias("colour"))
    x = table(spark, sf, "lineitem").select("l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "colour").agg(F.count("*").alias("n"))
    light = T.luminance(F.col("colour"))
    return x.where((light > 0.02) & (light < 0.6)).groupBy("p_brand").agg(F.max(F.struct("n", "colour")).alias("b")).select("p_brand", "b.colour", "b.n")


DOMINANT = f"""
WITH c AS (SELECT p_brand, md5(p_type)[1:6] AS colour, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
l AS (SELECT *, 0.2126 * {_linear(1)} + 0.7152 * {_linear(3)} + 0.0722 * {_linear(5)} AS lum FROM c)
SELECT p_brand, colour, n FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, colour DESC) AS k FROM l WHERE lum > 0.02 AND lum < 0.6) WHERE k = 1
"""


def shaped_records(spark: SparkSession, sf: str) -> DataFrame:
    """Each brand's record as JSON: a keep-list without empty values, and arrays capped at three with what is left out stated."""
    p = table(spark, sf, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_name")).alias("names"), F.array_sort(F.collect_set(F.when(F.col("p_size") > 49, F.col("p_type")))).alias("large"), F.max(F.when(F.col("p_size") > 100, F.col("p_name"))).alias("never"))
    kept = F.map_filter(F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("never"), F.col("never"), F.lit("first"), F.get("names", F.lit(0))), lambda k, v: v.isNotNull() & (v != ""))
    listed = F.struct(F.slice("names", 1, 3).alias("names"), F.when(F.size("large") > 0, F.slice("large", 1, 3)).alias("large"), F.nullif(F.greatest(F.size("names") - 3, F.lit(0)), F.lit(0)).alias("not_listed"))
    return p.select("p_brand", F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("fields"), F.to_json(listed, {"ignoreNullFields": "true"}).alias("record"))


SHAPED = """
WITH g AS (SELECT p_brand, list_sort(list_distinct(list(p_name))) AS names, list_sort(list_distinct(list(p_type) FILTER (p_size > 49))) AS large FROM part GROUP BY 1)
SELECT p_brand, 'brand,first' AS fields, '{"names":' || to_json(names[1:3])::VARCHAR || CASE WHEN len(large) > 0 THEN ',"large":' || to_json(large[1:3])::VARCHAR ELSE '' END || CASE WHEN len(names) > 3 THEN ',"not_listed":' || (len(names) - 3) ELSE '' END || '}' AS record FROM g
"""

QUERIES = {
    "name_forms": (name_forms, NAME_FORMS), "attribute_cascade": (attribute_cascade, ATTRIBUTES), "countdown_tones": (countdown_tones, COUNTDOWN), "price_difference": (price_difference, PRICE_DIFFERENCE),
    "colour_contrast": (colour_contrast, COLOURS), "dominant_colour": (dominant_colour, DOMINANT), "shaped_records": (shaped_records, SHAPED),
}
