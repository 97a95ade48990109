"""Queries over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import casts, geo, identity, math, temporal, text, units
from .operators import represent as R
from .operators import resolve, validate
from .plans.template import Compiler
from .sources import shared

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _templates(df: DataFrame, keys: list[str], templates: dict[str, str], **vars) -> DataFrame:
    c = Compiler(df, vars)
    return df.select(*keys, *[c.compile(t).alias(n) for n, t in templates.items()])


# Identity and entities


@query("""SELECT 'urn:ngsi-ld:Customer:' || regexp_replace(c_name, '[^A-Za-z0-9_-]', '', 'g') AS id, c_custkey, c_mktsegment AS segment FROM customer""")
def idn_01_identity_customer(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    return c.select(identity.urn("Customer", F.col("c_name")).alias("id"), "c_custkey", F.col("c_mktsegment").alias("segment"))


@query("""SELECT '{"id":"urn:ngsi-ld:Customer:' || c_custkey || '","type":"Customer","name":"' || c_name || '","segment":"' || c_mktsegment || '","nation":' || c_nationkey || '}' AS entity FROM customer""")
def snk_03_simplified_customer(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    attributes = [R.Attribute("name", R.quoted(F.col("c_name"))), R.Attribute("segment", R.quoted(F.col("c_mktsegment"))), R.Attribute("nation", R.number(F.col("c_nationkey")))]
    return c.select(R.entity("simplified", identity.urn("Customer", F.col("c_custkey")), "Customer", attributes).alias("entity"))


@query("""SELECT '{"id":"urn:ngsi-ld:Customer:' || c_custkey || '","type":"Customer","name":{"type":"Property","value":"' || c_name || '"},"nation":{"type":"Relationship","object":"urn:ngsi-ld:Nation:' || c_nationkey || '"}}' AS entity FROM customer""")
def snk_01_normalized_customer(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    attributes = [R.Attribute("name", R.quoted(F.col("c_name"))), R.Attribute("nation", R.quoted(identity.urn("Nation", F.col("c_nationkey"))), "Relationship")]
    return c.select(R.entity("normalized", identity.urn("Customer", F.col("c_custkey")), "Customer", attributes).alias("entity"))


@query("""SELECT '{"id":"urn:ngsi-ld:Event:' || event_id || '","type":"Event","kind":"' || event_type || '","user":{"object":"urn:ngsi-ld:User:' || user_id || '","observedAt":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' WHEN microsecond(ts) % 1000 = 0 THEN '.' || lpad(CAST(CAST((microsecond(ts) % 1000000) / 1000 AS BIGINT) AS VARCHAR), 3, '0') ELSE '.' || lpad(CAST(microsecond(ts) % 1000000 AS VARCHAR), 6, '0') END || 'Z"}}' AS entity FROM events""")
def snk_02_concise_events(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    attributes = [R.Attribute("kind", R.quoted(F.col("event_type"))), R.Attribute("user", R.quoted(identity.urn("User", F.col("user_id"))), "Relationship", observed_at=F.col("ts"))]
    return e.select(R.entity("concise", identity.urn("Event", F.col("event_id")), "Event", attributes).alias("entity"))


@query("""SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' THEN NULL ELSE p_name || ' (' || p_brand || ')' END AS label, nullif(p_brand, 'Brand#11') AS brand FROM part""")
def prj_06_composite_null_part(spark, sf_dir):
    p = _t(spark, sf_dir, "part").withColumn("b", F.when(F.col("p_brand") != "Brand#11", F.col("p_brand")))
    return _templates(p, ["p_partkey"], {"label": "{{ p_name }} ({{ b }})", "brand": "{{ b }}"})


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'b' WHEN c_acctbal > 5000 THEN 'rich' ELSE lower(c_mktsegment) END AS tag, CASE WHEN c_acctbal >= 0 AND NOT (c_mktsegment = 'MACHINERY') THEN c_acctbal END AS kept FROM customer""")
def flt_03_guard_segment(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    return _templates(c, ["c_custkey"], {"tag": "{% if c_mktsegment == 'BUILDING' %}b{% elif c_acctbal > 5000 %}rich{% else %}{{ c_mktsegment | lower }}{% endif %}", "kept": "{% if c_acctbal >= 0 and not c_mktsegment == 'MACHINERY' %}{{ c_acctbal }}{% endif %}"})


@query("""SELECT o_orderkey, o_orderkey % 2 = 1 AS is_odd, o_orderkey % 3 = 0 AS by3, o_orderpriority LIKE '1-%' AS urgent, o_orderpriority LIKE '%HIGH' AS high, contains(o_orderpriority, 'I') AS has_i, regexp_matches(o_orderpriority, '^[12]') AS top, o_orderdate > TIMESTAMP '1996-01-01' AS after96, o_orderdate < TIMESTAMP '1994-06-01' AS before94 FROM orders""")
def flt_05_tests(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return _templates(o, ["o_orderkey"], {"is_odd": "{{ o_orderkey is odd }}", "by3": "{{ o_orderkey is divisible_by(3) }}", "urgent": "{{ o_orderpriority is starting_with('1-') }}", "high": "{{ o_orderpriority is ending_with('HIGH') }}", "has_i": "{{ o_orderpriority is containing('I') }}", "top": "{{ o_orderpriority is matching('^[12]') }}", "after96": "{{ o_orderdate is after('1996-01-01') }}", "before94": "{{ o_orderdate is before('1994-06-01') }}"})


@query("""SELECT event_id FROM events WHERE ts >= (SELECT min(ts) FROM events) + INTERVAL 1 DAY AND ts < (SELECT min(ts) FROM events) + INTERVAL 3 DAY""")
def flt_12_time_window(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    low = e.agg(F.min("ts").alias("low"))
    return e.where((F.col("ts") >= low.select(F.expr("low + INTERVAL 1 DAY")).scalar()) & (F.col("ts") < low.select(F.expr("low + INTERVAL 3 DAY")).scalar())).select("event_id")


# Casts

_TEXTS = "CASE o_orderkey % 8 WHEN 0 THEN ' yes ' WHEN 1 THEN 'OFF' WHEN 2 THEN '1' WHEN 3 THEN 'maybe' WHEN 4 THEN ' 12 ' WHEN 5 THEN '-7.9' WHEN 6 THEN '3,5' ELSE '00123' END"


def _texts(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.expr(_TEXTS).alias("x"))


@query(f"""SELECT o_orderkey, CASE WHEN lower(trim(x)) IN ('true','yes','on','1') THEN true WHEN lower(trim(x)) IN ('false','no','off','0') THEN false END AS b FROM (SELECT o_orderkey, {_TEXTS} AS x FROM orders)""")
def cst_01_boolean_tokens(spark, sf_dir):
    return _texts(spark, sf_dir).select("o_orderkey", casts.boolean(F.col("x")).alias("b"))


@query(f"""SELECT o_orderkey, CASE trim(x) WHEN '1' THEN 1 WHEN '12' THEN 12 WHEN '-7.9' THEN -7 WHEN '3,5' THEN 3 WHEN '00123' THEN 123 ELSE CAST(NULL AS BIGINT) END AS i FROM (SELECT o_orderkey, {_TEXTS} AS x FROM orders)""")
def cst_02_integer_trunc(spark, sf_dir):
    return _texts(spark, sf_dir).select("o_orderkey", casts.integer(F.col("x")).alias("i"))


@query(f"""SELECT o_orderkey, TRY_CAST(replace(trim(x), ',', '.') AS DOUBLE) AS f FROM (SELECT o_orderkey, {_TEXTS} AS x FROM orders)""")
def cst_03_float_comma(spark, sf_dir):
    return _texts(spark, sf_dir).select("o_orderkey", casts.float_(F.col("x")).alias("f"))


@query("""SELECT event_id, epoch_us(ts) AS us_s, epoch_us(ts) - epoch_us(ts) % 1000 AS us_ms, strftime(ts, '%Y-%m-%d') AS day FROM events""")
def cst_10_datetime_epoch(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    s = temporal.epoch(F.unix_micros(F.col("ts").cast("timestamp")).cast("decimal(38,9)") / 1000000)
    ms = temporal.epoch(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("decimal(38,9)"))
    return e.select("event_id", F.unix_micros(s).alias("us_s"), F.unix_micros(ms).alias("us_ms"), temporal.date_text(temporal.datetime(temporal.datetime_text(F.col("ts")))).alias("day"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' WHEN microsecond(ts) % 1000 = 0 THEN '.' || lpad(CAST(CAST((microsecond(ts) % 1000000) / 1000 AS BIGINT) AS VARCHAR), 3, '0') ELSE '.' || lpad(CAST(microsecond(ts) % 1000000 AS VARCHAR), 6, '0') END || 'Z' AS t FROM events""")
def cst_11_temporal_text_digits(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", temporal.datetime_text(F.col("ts")).alias("t"))


@query("""SELECT p_partkey, list_aggregate(list_filter(string_split(p_type, ' '), lambda x: x <> ''), 'string_agg', '|') AS items, len(list_filter(string_split(p_type, ' '), lambda x: x <> '')) AS n FROM part""")
def cst_07_list_property_tokens(spark, sf_dir):
    t = casts.tokens(F.col("p_type"))
    return _t(spark, sf_dir, "part").select("p_partkey", F.array_join(t, "|").alias("items"), F.size(t).cast("long").alias("n"))


@query("""SELECT url, lower(regexp_extract(url, '^([A-Za-z]+):', 1)) AS scheme FROM pages""")
def cst_05_iri(spark, sf_dir):
    p = _t(spark, sf_dir, "pages")
    return p.select("url", F.regexp_extract(casts.iri(F.col("url")), "^([a-z]+):", 1).alias("scheme"))


@query("""SELECT s_suppkey, 'urn:isbn:' || s_suppkey || '%2F' AS u FROM supplier""")
def cst_06_urn(spark, sf_dir):
    return _t(spark, sf_dir, "supplier").select("s_suppkey", casts.urn(F.concat(F.lit("URN:ISBN:"), "s_suppkey", F.lit("%2f"))).alias("u"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events""")
def fns_19_json_props_get(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return e.select("event_id", text.get(F.col("props"), "k", "long").alias("k"), text.get(F.col("props"), "missing", "string", F.lit("none")).alias("missing"))


# Math and text through templates

_MATH = {"root": "sqrt", "third": "cbrt", "s": "sign", "e": "exp", "l": "ln", "ten": "log10", "two": "log2", "down": "floor", "up": "ceil", "cut": "trunc", "si": "sin", "co": "cos", "ta": "tan", "at": "atan", "ra": "radians", "de": "degrees"}


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(sqrt(d), 9) AS root, round(cbrt(d), 9) AS third, CAST(sign(d) AS DOUBLE) AS s, round(exp(d), 9) AS e, round(ln(d), 9) AS l, round(log10(d), 9) AS ten, round(log2(d), 9) AS two, CAST(floor(d) AS BIGINT) AS down, CAST(ceil(d) AS BIGINT) AS up, CAST(trunc(d) AS BIGINT) AS cut, round(sin(d), 9) AS si, round(cos(d), 9) AS co, round(tan(d), 9) AS ta, round(atan(d), 9) AS at, round(radians(d), 9) AS ra, round(degrees(d), 9) AS de FROM (SELECT *, l_quantity / 7 AS d FROM lineitem)""")
def mth_01_math_suite(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem").withColumn("d", F.col("l_quantity") / 7)
    out = _templates(l, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], {n: f"{{{{ d | {f} }}}}" for n, f in _MATH.items()})
    exact = {"s", "down", "up", "cut"}
    return out.select(*[F.round(c, 9).alias(c) if c in _MATH and c not in exact else F.col(c).cast("long").alias(c) if c in ("down", "up", "cut") else F.col(c) for c in out.columns])


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(asin(l_discount), 9) AS si, round(acos(l_discount), 9) AS co, round(sqrt(l_discount * l_discount + l_tax * l_tax), 9) AS h, round(atan2(l_tax, l_discount), 9) AS angle, l_quantity + 1 AS plus, l_quantity * 2 - 3 AS mix, CASE WHEN l_discount = 0 THEN NULL ELSE round(l_tax / l_discount, 9) END AS ratio, round(abs(l_tax - l_discount), 9) AS gap, round(2 * pi(), 9) AS turn FROM lineitem""")
def mth_14_operators(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem")
    out = _templates(l, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], {"si": "{{ l_discount | asin }}", "co": "{{ l_discount | acos }}", "h": "{{ hypot(x=l_discount, y=l_tax) }}", "angle": "{{ atan2(y=l_tax, x=l_discount) }}", "plus": "{{ l_quantity + 1 }}", "mix": "{{ l_quantity * 2 - 3 }}", "ratio": "{{ l_tax / l_discount }}", "gap": "{{ l_tax - l_discount | abs }}", "turn": "{{ tau() }}"})
    return out.select(*[F.round(c, 9).alias(c) if c in ("si", "co", "h", "angle", "ratio", "gap", "turn") else F.col(c) for c in out.columns])


@query("""SELECT vec_id, round(sqrt(u * u + v * v), 9) AS speed, round(CASE WHEN d >= 360 THEN d - 360 WHEN d < 0 THEN d + 360 ELSE d END, 6) AS direction FROM (SELECT vec_id, u, v, degrees(atan2(u, v)) + 180 AS d FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS u, CAST(embedding[2] AS DOUBLE) AS v FROM embeddings))""")
def mth_26_wind_suite(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("u"), F.col("embedding")[1].cast("double").alias("v"))
    out = _templates(e, ["vec_id"], {"speed": "{{ wind_speed(u=u, v=v) }}", "direction": "{{ wind_direction(u=u, v=v) }}"})
    return out.select("vec_id", F.round("speed", 9).alias("speed"), F.round("direction", 6).alias("direction"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, greatest(10, least(l_quantity, 40)) AS c, round(100 * (l_quantity - 1) / 49, 9) AS r FROM lineitem""")
def mth_22_map_range_clamp(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem")
    out = _templates(l, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], {"c": "{{ clamp(value=l_quantity, min=10.0, max=40.0) }}", "r": "{{ map_range(value=l_quantity, from_min=1, from_max=50, to_min=0, to_max=100) }}"})
    return out.withColumn("r", F.round("r", 9))


@query("""SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, upper(substr(p_name, 1, 1)) || lower(substr(p_name, 2)) AS cap, trim(' ' || p_name || ' ') AS t, replace(p_brand, 'Brand', 'B') AS r, length(p_name) AS n, reverse(p_brand) AS back, len(string_split(p_type, ' ')) AS words, string_split(p_type, ' ')[1] AS head, string_split(p_type, ' ')[-1] AS tail, array_to_string(string_split(p_type, ' '), '/') AS slashed FROM part""")
def fns_01_string_suite(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    return _templates(p, ["p_partkey"], {"u": "{{ p_name | upper }}", "l": "{{ p_brand | lower }}", "cap": "{{ p_name | capitalize }}", "t": "{{ ' ' ~ p_name ~ ' ' | trim }}", "r": "{{ p_brand | replace(from='Brand', to='B') }}", "n": "{{ p_name | length }}", "back": "{{ p_brand | reverse }}", "words": "{{ p_type | split(pat=' ') | length }}", "head": "{{ p_type | split(pat=' ') | first }}", "tail": "{{ p_type | split(pat=' ') | last }}", "slashed": "{{ p_type | split(pat=' ') | join(sep='/') }}"})


@query("""SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS cleaned, replace(replace(replace(replace(replace(lang, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS esc FROM documents""")
def fns_20_clean_ws(spark, sf_dir):
    return _templates(_t(spark, sf_dir, "documents"), ["doc_id"], {"cleaned": "{{ text | clean }}", "esc": "{{ lang | escape }}"})


@query("""SELECT item_id, base64(encode(substr(text, 1, 20))) AS b, trim(regexp_replace(lower(strip_accents(replace(text, 'ß', 'ss'))), '[^a-z0-9]+', '-', 'g'), '-') AS s, CASE WHEN length(text) > 10 THEN substr(text, 1, 10) || '…' ELSE text END AS cut, regexp_replace(text, '[aeiou]', '_', 'g') AS vowels FROM benchmark""")
def fns_30_encode_slug(spark, sf_dir):
    b = _t(spark, sf_dir, "benchmark").withColumn("short", F.substring("text", 1, 20))
    return _templates(b, ["item_id"], {"b": "{{ short | b64_encode }}", "s": "{{ text | slug }}", "cut": "{{ text | truncate(10) }}", "vowels": "{{ text | regex_replace('[aeiou]', '_') }}"})


@query("""SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg, array_to_string(list_sort(list_distinct([c_mktsegment, 'A', 'A'])), ',') AS sorted, '<' || upper(c_mktsegment) || '><' || upper('b') || '>' AS looped FROM customer""")
def fns_36_collections(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").withColumn("seg0", F.expr("nullif(c_mktsegment, 'BUILDING')")).withColumn("tags", F.array("c_mktsegment", F.lit("b")))
    return _templates(c, ["c_custkey"], {"seg": "{{ seg0 | default(value='none') }}", "sorted": "{{ [c_mktsegment, 'A', 'A'] | unique | sort | join(sep=',') }}", "looped": "{% for t in tags %}<{{ t | upper }}>{% endfor %}"})


@query("""SELECT event_id, strftime(ts - INTERVAL 90 SECOND, '%Y-%m-%d %H:%M') AS before, strftime(ts, '%d/%m/%Y') AS day FROM events""")
def fns_26_dates(spark, sf_dir):
    return _templates(_t(spark, sf_dir, "events"), ["event_id"], {"before": "{{ ts | date_subtract_seconds(90, '%Y-%m-%d %H:%M') }}", "day": "{{ ts | date(format='%d/%m/%Y') }}"})


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'CEL' WHEN 1 THEN 'GQ' WHEN 2 THEN 'MTS' WHEN 3 THEN 'P1' WHEN 4 THEN NULL ELSE 'KGM' END AS code FROM part""")
def fns_23_unit_codes(spark, sf_dir):
    notation = F.expr("element_at(array('°C', 'µg/m³', 'm/s', '%', 'furlong', 'KGM'), CAST(p_partkey % 6 AS INT) + 1)")
    return _t(spark, sf_dir, "part").select("p_partkey", units.code(notation).alias("code"))


# Joins


@query("""SELECT o_orderkey, 'urn:ngsi-ld:Order:' || o_orderkey AS id, 'urn:ngsi-ld:Customer:' || o_custkey AS customer FROM orders""")
def joi_03_rel_orders_customer(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", identity.urn("Order", F.col("o_orderkey")).alias("id"), identity.urn("Customer", F.col("o_custkey")).alias("customer"))


@query("""SELECT coalesce(c.k, o.k) AS k, c.name AS name, coalesce(c.balance, o.balance) AS balance, o.orders AS orders FROM (SELECT c_custkey AS k, c_name AS name, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance FROM customer WHERE c_custkey % 3 > 0) c FULL JOIN (SELECT o_custkey AS k, CAST(round(sum(o_totalprice), 0) AS DOUBLE) AS balance, count(*) AS orders FROM orders GROUP BY o_custkey) o ON c.k = o.k""")
def joi_01_multi_mapping_join(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"))
    o = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.round(F.sum("o_totalprice"), 0).alias("balance"), F.count("*").alias("orders"))
    return resolve.join_mappings([c, o], "k")


@query("""SELECT s_suppkey AS k, s_name AS name, 'supplier' AS lane FROM supplier UNION ALL SELECT c_custkey, c_name, 'customer' FROM customer""")
def set_01_union_lanes(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.lit("supplier").alias("lane"))
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.lit("customer").alias("lane"))
    return resolve.union_lanes([s, c])


@query("""SELECT DISTINCT 'urn:ngsi-ld:Supplier:' || l_suppkey AS id FROM lineitem""")
def joi_08_synthetic_supplier(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem")
    own, _ = resolve.synthetic(l, identity.urn("Supplier", F.col("l_suppkey")), "supplier", {}, identity.urn("Order", F.col("l_orderkey")))
    return own


@query("""SELECT e.event_id FROM events e WHERE e.event_id % 7 = 0 AND NOT EXISTS (SELECT 1 FROM events s WHERE s.event_id % 2 = 0 AND s.user_id = e.user_id AND s.ts = e.ts)""")
def joi_14_unseen(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return resolve.unseen(e.where("event_id % 7 = 0"), e.where("event_id % 2 = 0"), ["user_id", "ts"]).select("event_id")


@query("""SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'click' AND event_id % 50 = 0)""")
def joi_15_missing_streams(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return resolve.missing(e, e.where("event_type = 'click' AND event_id % 50 = 0"), "user_id")


@query("""SELECT e.event_id, e.value, c.c_name AS thing, n.n_name AS place FROM events e JOIN customer c ON e.user_id = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey""")
def joi_10_observation_thing(spark, sf_dir):
    e, c, n = (_t(spark, sf_dir, x) for x in ("events", "customer", "nation"))
    j = e.join(c, e.user_id == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.select("event_id", "value", F.col("c_name").alias("thing"), F.col("n_name").alias("place"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, '[{"datasetId":"urn:role:part","object":"urn:ngsi-ld:Part:' || l_partkey || '"},{"datasetId":"urn:role:supplier","object":"urn:ngsi-ld:Supplier:' || l_suppkey || '"}]' AS roles FROM lineitem""")
def joi_05_instances_roles(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem")
    one = lambda role, kind, key: F.struct(F.lit(f"urn:role:{role}").alias("datasetId"), identity.urn(kind, F.col(key)).alias("object"))
    return l.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.to_json(F.array(one("part", "Part", "l_partkey"), one("supplier", "Supplier", "l_suppkey"))).alias("roles"))


# Aggregations and merges


@query("""SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS status, arg_min(o_totalprice, o_orderkey) AS price, arg_min(o_orderpriority, o_orderkey) AS priority FROM orders GROUP BY o_custkey""")
def agg_01_static_merge_first(spark, sf_dir):
    m = resolve.static_merge(_t(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", ["o_orderstatus", "o_totalprice", "o_orderpriority"])
    return m.toDF("o_custkey", "status", "price", "priority")


@query("""SELECT o_custkey, count(*) AS records, CASE WHEN count(DISTINCT o_orderstatus) > 1 THEN 'o_orderstatus' ELSE 'o_orderpriority' END AS field FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1 OR count(DISTINCT o_orderpriority) > 1""")
def agg_02_merge_conflicts(spark, sf_dir):
    return resolve.conflicts(_t(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query("""SELECT kind, count(*) AS entities, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS merged_entities, CAST(sum(n) AS BIGINT) AS records FROM (SELECT o_orderstatus AS kind, o_custkey, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY kind""")
def agg_03_records_merged(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "kind")
    return resolve.records_merged(o, "o_custkey", "kind")


@query("""SELECT user_id, arg_max(value, (ts, event_id)) AS value, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id""")
def agg_04_current_state_events(spark, sf_dir):
    return resolve.current_state(_t(spark, sf_dir, "events"), "user_id", "event_id", {"reading": ("ts", ["value", "event_type"])})


@query("""SELECT user_id, arg_max(value, (ts, event_id)) AS value, arg_max(event_type, (t2, event_id)) AS event_type, max(ts) AS ts, max(t2) AS t2 FROM (SELECT *, ts + to_seconds((event_id % 97) * 1000) AS t2 FROM events) GROUP BY user_id""")
def agg_05_two_slot_ranking(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("t2", F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("event_id") % 97 * 1000 * 1000000))
    return resolve.current_state(e, "user_id", "event_id", {"a": ("ts", ["value"]), "b": ("t2", ["event_type"])})


@query("""SELECT user_id, array_to_string(list(event_id ORDER BY ts, event_id), ',') AS ids, arg_min(event_type, event_id) AS first_type, count(*) AS n FROM events GROUP BY user_id""")
def agg_08_series_fold_events(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("first_type", F.col("event_type"))
    s = resolve.series(e, "user_id", "event_id", "ts", ["event_id"], ["first_type"])
    return s.select("user_id", F.concat_ws(",", F.col("event_id").cast("array<string>")).alias("ids"), "first_type", F.size("event_id").cast("long").alias("n"))


@query("""SELECT r_regionkey, array_to_string(list_sort(list(DISTINCT s)), ' ') AS scopes FROM (SELECT n_regionkey AS r_regionkey, n_name AS s FROM nation WHERE regexp_matches(n_name, '^[A-Za-z]\\w*$') UNION SELECT r_regionkey, r_name FROM region WHERE regexp_matches(r_name, '^[A-Za-z]\\w*$')) GROUP BY r_regionkey""")
def agg_09_scope_union(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("r_regionkey"), identity.scopes(F.col("n_name")).alias("scopes"))
    r = _t(spark, sf_dir, "region").select("r_regionkey", identity.scopes(F.col("r_name")).alias("scopes"))
    out = resolve.scope_union(n.unionByName(r).where("scopes is not null"), "r_regionkey", "scopes")
    return out.select("r_regionkey", F.array_join("scopes", " ").alias("scopes"))


@query("""SELECT o_custkey, arg_max(e, o_orderkey) FILTER (WHERE e IS NOT NULL) AS declared, arg_max(o_orderdate, (o_orderdate, o_orderkey)) FILTER (WHERE o_orderstatus IS NOT NULL) AS kept, max(o_orderdate) AS furthest, CASE WHEN count(*) = count(e) THEN max(e) END AS joined FROM (SELECT *, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderdate END AS e FROM orders) GROUP BY o_custkey""")
def agg_10_expiry(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").withColumn("e", F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate")))
    a = resolve.expiry_static(o.withColumn("declared", F.col("e")), "o_custkey", "o_orderkey", "declared")
    b = resolve.expiry_temporal(o.withColumn("kept", F.col("o_orderdate")), "o_custkey", "o_orderkey", "o_orderdate", "kept")
    c = resolve.expiry_series(o.withColumn("furthest", F.col("o_orderdate")), "o_custkey", "furthest")
    d = resolve.expiry_join(o.withColumn("joined", F.col("e")), "o_custkey", "joined")
    return a.join(b, "o_custkey").join(c, "o_custkey").join(d, "o_custkey")


@query("""SELECT o_custkey, arg_min('urn:ngsi-ld:Order:' || o_orderkey, o_orderkey) AS first_order FROM orders GROUP BY o_custkey""")
def agg_14_single_relationship(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", identity.urn("Order", F.col("o_orderkey")).alias("first_order"))
    return resolve.single_target(o, "o_custkey", "o_orderkey", "first_order")


@query("""SELECT o_custkey, array_to_string(list(p ORDER BY f), ',') AS targets FROM (SELECT o_custkey, o_orderpriority AS p, min(o_orderkey) AS f FROM orders GROUP BY 1, 2) GROUP BY o_custkey""")
def agg_15_list_rel_customer_orders(spark, sf_dir):
    out = resolve.list_targets(_t(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderpriority")
    return out.select("o_custkey", F.array_join("o_orderpriority", ",").alias("targets"))


@query("""SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY 1, 2""")
def agg_16_earliest_edges(spark, sf_dir):
    return resolve.earliest_edges(_t(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id")


@query("""SELECT count(*) AS records, count(DISTINCT user_id) AS entities FROM events""")
def agg_17_entity_counts(spark, sf_dir):
    return _t(spark, sf_dir, "events").agg(F.count("*").alias("records"), F.count_distinct("user_id").alias("entities"))


@query("""SELECT event_type AS code, count(*) AS n, arg_min(props, event_id) AS example FROM events GROUP BY event_type""")
def agg_19_loss_tally(spark, sf_dir):
    return resolve.tally(_t(spark, sf_dir, "events").withColumnRenamed("event_type", "code"), "code", "props", "event_id")


@query("""SELECT user_id, min(event_id) AS first FROM events GROUP BY user_id""")
def srt_01_source_order(spark, sf_dir):
    out = resolve.source_order(_t(spark, sf_dir, "events"), "user_id", "event_id")
    return out.select("user_id", F.col("first.event_id").alias("first"))


@query("""SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events""")
def win_03_reading_keys(spark, sf_dir):
    from pyspark.sql import Window

    e = _t(spark, sf_dir, "events")
    return e.select("user_id", "event_type", "event_id", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id")).cast("long").alias("k"))


@query("""SELECT event_id, user_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def win_01_latest_per_key(spark, sf_dir):
    from pyspark.sql import Window

    e = _t(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return e.withColumn("k", F.row_number().over(w)).where("k = 1").select("event_id", "user_id", "ts")


@query("""SELECT user_id, CASE WHEN count(CASE WHEN value > 990 THEN 1 END) = 0 THEN 'high' ELSE '' END AS missing FROM events GROUP BY user_id""")
def set_06_shared_members(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("high", F.expr("CASE WHEN value > 990 THEN 1 END"))
    out = resolve.shared_members(e, "user_id", ["high", "value"])
    return out.select("user_id", F.array_join("missing", ",").alias("missing"))


@query("""SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, max(CASE WHEN event_type = 'click' THEN value END) AS click, max(CASE WHEN event_type = 'view' THEN value END) AS view FROM events GROUP BY 1, 2""")
def src_20_grid_pivot(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return e.groupBy("user_id", F.date_trunc("day", "ts").alias("day")).pivot("event_type", ["click", "view"]).agg(F.max("value"))


@query("""SELECT conv_id, turn, role, text FROM conversations""")
def src_09_nested_collection(spark, sf_dir):
    from .sources.documents import split_collection

    c = _t(spark, sf_dir, "conversations")
    nested = c.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("turns"))
    return split_collection(nested, "turns").select("conv_id", "turn", "role", "text")


@query("""SELECT o_orderkey, CASE WHEN o_totalprice <= 200000 AND o_orderstatus IN ('F', 'O') THEN 'Conformant' ELSE 'Nonconformant' END AS verdict, o_totalprice <= 200000 AND o_orderstatus IN ('F', 'O') AS written FROM orders""")
def val_02_schema_verdicts(spark, sf_dir):
    schema = {"type": "object", "required": ["status"], "properties": {"price": {"type": "number", "maximum": 200000}, "status": {"enum": ["F", "O"]}}}
    o = _t(spark, sf_dir, "orders").withColumn("entity", F.to_json(F.struct(F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))))
    v = validate.verdict(F.col("found"))
    return o.withColumn("found", validate.check(F.col("entity"), schema)).select("o_orderkey", v.alias("verdict"), validate.written("fail-when-schema", v).alias("written"))


def _geohash_sql(lat: str, lon: str, precision: int = 9) -> str:
    """Cells of both coordinates, their bits interleaved, five to a character."""
    bits = precision * 5
    lon_bits, lat_bits = (bits + 1) // 2, bits // 2
    x, y = (f"CAST(least(floor(({v} + {low}) / {width} * {1 << n}), {(1 << n) - 1}) AS BIGINT)" for v, low, width, n in ((lon, 180, 360.0, lon_bits), (lat, 90, 180.0, lat_bits)))
    bit = lambda k: f"((x >> {lon_bits - 1 - k // 2}) & 1)" if k % 2 == 0 else f"((y >> {lat_bits - 1 - k // 2}) & 1)"
    chars = [f"substr('{geo.BASE32}', CAST(1 + " + " + ".join(f"{bit(5 * c + b)} * {1 << (4 - b)}" for b in range(5)) + " AS BIGINT), 1)" for c in range(precision)]
    return f"SELECT c_custkey, {' || '.join(chars)} AS hash FROM (SELECT c_custkey, {x} AS x, {y} AS y FROM customer)"


@query(_geohash_sql("(c_custkey % 170 - 85.0)", "(c_custkey % 360 - 180.0)"))
def geo_01_geohash_grid(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").withColumns({"lon": F.col("c_custkey") % 360 - 180.0, "lat": F.col("c_custkey") % 170 - 85.0})
    return c.select("c_custkey", geo.geohash(F.col("lat"), F.col("lon")).alias("hash"))


@query("""SELECT c_custkey, x + 0.5 AS cx, y + 1.0 AS cy, x AS w, y AS s, x + 1 AS e, y + 2 AS n FROM (SELECT c_custkey, CAST(c_custkey % 100 AS DOUBLE) AS x, CAST(c_custkey % 50 AS DOUBLE) AS y FROM customer)""")
def geo_16_bbox_center(spark, sf_dir):
    c = geo.spread(_t(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    c = c.select("c_custkey", (F.col("c_custkey") % 100).cast("double").alias("x"), (F.col("c_custkey") % 50).cast("double").alias("y"))
    g = F.format_string('{"type":"Polygon","coordinates":[[[%s,%s],[%s,%s],[%s,%s],[%s,%s],[%s,%s]]]}', "x", "y", F.col("x") + 1, "y", F.col("x") + 1, F.col("y") + 2, "x", F.col("y") + 2, "x", "y")
    c = c.withColumn("g", g)
    mid = F.from_json(geo.convert(F.col("g"), "point", "bbox-center"), "coordinates array<double>")
    box = geo.bbox(F.col("g"))
    return c.select("c_custkey", mid["coordinates"][0].alias("cx"), mid["coordinates"][1].alias("cy"), box[0].alias("w"), box[1].alias("s"), box[2].alias("e"), box[3].alias("n"))


@query("""SELECT event_id, ((value % 720) + 180) % 360 - 180 AS lon FROM events""")
def src_29_longitude_fold(spark, sf_dir):
    from .sources.gridded import fold_longitude

    return _t(spark, sf_dir, "events").select("event_id", fold_longitude(F.col("value") % 720).alias("lon"))


# Further operators


@query("""SELECT user_id, event_id, max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS high FROM events""")
def win_06_high_water_mark(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return _t(spark, sf_dir, "events").select("user_id", "event_id", F.max("ts").over(w).alias("high"))


@query("""SELECT DISTINCT 'urn:ngsi-ld:Segment:' || c_mktsegment AS id, c_mktsegment AS name FROM customer""")
def idn_06_expand_synthetic(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    own, _ = resolve.synthetic(c, identity.urn("Segment", F.col("c_mktsegment")), "segment", {"name": F.col("c_mktsegment")}, identity.urn("Customer", F.col("c_custkey")))
    return own


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'urn:ngsi-ld:C:K-' || (c_custkey % 3) END AS id FROM customer WHERE c_custkey % 3 <> 0""")
def flt_01_absent_identity(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").withColumn("k", F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") % 3))
    out = _templates(c, ["c_custkey"], {"name": "K-{{ k }}"})
    return out.select("c_custkey", identity.urn("C", F.col("name")).alias("id")).where("id is not null")


@query("""SELECT p_partkey, 'urn:ngsi-ld:Tag:' || string_split(p_type, ' ')[1] AS first_tag, len(list_distinct(string_split(p_type, ' '))) AS n FROM part""")
def joi_04_list_minting(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    ids = F.array_distinct(F.transform(casts.tokens(F.col("p_type")), lambda x: identity.urn("Tag", x)))
    return p.select("p_partkey", F.get(ids, F.lit(0)).alias("first_tag"), F.size(ids).cast("long").alias("n"))


@query("""SELECT o_custkey, arg_min(o_orderstatus, (lane, o_orderkey)) AS status FROM (SELECT *, 0 AS lane FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT *, 1 FROM orders WHERE o_orderkey % 2 = 1) GROUP BY o_custkey""")
def joi_02_same_mapping_inputs(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    lanes = resolve.union_lanes([o.where("o_orderkey % 2 = 0").withColumn("lane", F.lit(0)), o.where("o_orderkey % 2 = 1").withColumn("lane", F.lit(1))])
    return resolve.static_merge(lanes, "o_custkey", ["lane", "o_orderkey"], ["o_orderstatus"]).withColumnRenamed("o_orderstatus", "status")


@query("""SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS price, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY o_custkey""")
def agg_05_newest_record(spark, sf_dir):
    out = resolve.newest(_t(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", ["o_orderdate"], ["o_totalprice", "o_orderstatus"])
    return out.toDF("o_custkey", "price", "status")


@query("""SELECT e.event_id, strftime(e.ts, '%Y-%m-%d') AS d, strftime(e.ts, '%H:%M:%S') AS t FROM events e""")
def cst_12_date_and_time(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return e.select("event_id", temporal.date_text(F.col("ts")).alias("d"), F.substring(temporal.time_text(F.col("ts")), 1, 8).alias("t"))


@query("""SELECT event_id, value > 50 AND (event_type = 'view' OR event_type = 'click') AS a, NOT (event_type <> 'view') AS b, event_type IN ('view', 'error') AS c FROM events""")
def flt_04_logic(spark, sf_dir):
    return _templates(_t(spark, sf_dir, "events"), ["event_id"], {"a": "{{ value > 50 and (event_type == 'view' or event_type == 'click') }}", "b": "{{ not event_type != 'view' }}", "c": "{{ event_type in ['view', 'error'] }}"})


@query("""SELECT s_suppkey, s_name AS name, 'Lab' AS site, 'Lab/' || s_name AS path, 's' AS fixed FROM supplier""")
def prj_04_vars_and_literals(spark, sf_dir):
    return _templates(_t(spark, sf_dir, "supplier"), ["s_suppkey"], {"name": "{{ this['s_name'] }}", "site": "{{ vars.site }}", "path": "{{ vars.site ~ '/' ~ s_name }}", "fixed": "s"}, site="Lab")


@query("""SELECT user_id, max(ts) AS high, count(*) AS n FROM events WHERE event_id % 2 = 1 AND NOT (event_id % 10 = 1) GROUP BY user_id""")
def str_06_incremental_positions(spark, sf_dir):
    from .streaming import incremental

    e = _t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    seen = e.where("event_id % 10 = 1").groupBy(F.col("user_id").cast("string").alias("stream")).agg(F.min("ts").alias("high"), F.collect_list(F.col("event_id").cast("string")).alias("seen"), F.lit(False).alias("missing"))
    fresh = incremental.unseen(e.where("event_id % 2 = 1"), seen, "user_id", "event_id", "ts", 10**7)
    return fresh.groupBy("user_id").agg(F.max("ts").alias("high"), F.count("*").alias("n"))


@query("""SELECT 'urn:ngsi-ld:Reading:U-' || user_id AS id, arg_max(value, (ts, event_id)) AS reading, arg_max(event_type, (ts, event_id)) AS kind FROM events GROUP BY user_id""")
def map_01_current_entities(spark, sf_dir):
    from .plans import mapping

    m = {"version": "v4", "dataModel": "Reading", "identity": {"entityName": "U-{{ user_id }}"}, "attributes": {"kind": {"source": "{{ event_type }}"}, "reading": {"source": "{{ value }}", "transformation": "float", "properties": {"observedAt": {"source": "{{ ts }}"}}}}}
    out = mapping.run(_t(spark, sf_dir, "events"), m, "event_id", "simplified")
    return out.select("id", F.get_json_object("entity", "$.reading").cast("double").alias("reading"), F.get_json_object("entity", "$.kind").alias("kind"))


@query("""SELECT 'urn:ngsi-ld:Order:' || o_orderkey AS id, 'Order' AS type FROM orders UNION ALL SELECT DISTINCT 'urn:ngsi-ld:Buyer:' || o_custkey, 'Buyer' FROM orders""")
def map_02_synthetic_entities(spark, sf_dir):
    from .plans import mapping

    m = {"version": "v4", "dataModel": "Order", "identity": {"entityName": "{{ o_orderkey }}"}, "attributes": {"buyer": {"type": "Relationship", "syntheticEntity": {"dataModel": "Buyer", "identity": {"entityName": "{{ o_custkey }}"}, "attributes": {"key": {"source": "{{ o_custkey }}"}}}}}}
    return mapping.run(_t(spark, sf_dir, "orders"), m, "o_orderkey", "concise").select("id", "type")


@query("""SELECT 'urn:ngsi-ld:Part:' || p_partkey AS id, p_name || CASE WHEN p_size > 25 THEN ' ' || p_brand ELSE ' ' END AS joined, CASE WHEN p_size > 25 THEN p_size ELSE p_partkey END AS first, CASE WHEN p_size > 25 THEN '["' || p_brand || '",' || p_size || ']' ELSE CAST(p_size AS VARCHAR) END AS kept, '["' || CASE WHEN p_size > 25 THEN p_brand || '","' ELSE '' END || p_size || '","' || (p_size + 1) || '"]' AS items, '{"type":"Point","coordinates":[' || (p_partkey % 90) || ',' || p_size || ']}' AS place, CASE WHEN p_size > 25 THEN 'No. ' || p_brand END AS absent FROM part""")
def prj_10_merged_parts(spark, sf_dir):
    from .plans import mapping

    attributes = {
        "joined": {"source": ["{{ p_name }}", " ", "{{ some }}"], "transformation": "string"},
        "first": {"source": ["{{ large }}", "{{ p_partkey }}"], "transformation": "integer"},
        "kept": {"source": ["{{ some }}", "{{ p_size }}"]},
        "items": {"source": ["{{ some }}", "{{ list }}"], "transformation": "array"},
        "place": {"type": "GeoProperty", "source": ["{{ east }}", "{{ p_size }}"], "transformation": "point"},
        "absent": {"source": ["No. ", "{{ some }}"], "transformation": "string"},
    }
    m = {"version": "v4", "dataModel": "Part", "identity": {"entityName": "{{ p_partkey }}"}, "attributes": attributes}
    large = F.col("p_size") > 25
    p = _t(spark, sf_dir, "part").withColumns({"some": F.when(large, F.col("p_brand")), "large": F.when(large, F.col("p_size")), "list": F.format_string("[%d,%d]", F.col("p_size"), F.col("p_size") + 1), "east": F.col("p_partkey") % 90})
    out = mapping.run(p, m, "p_partkey", "simplified")
    return out.select("id", *[F.get_json_object("entity", f"$.{n}").cast("int" if n == "first" else "string").alias(n) for n in attributes])


@query("""SELECT 'urn:ngsi-ld:Part:' || p_partkey AS id, CAST(NULL AS VARCHAR) AS label, len(list_distinct(string_split(p_type, ' '))) AS links FROM part UNION ALL SELECT DISTINCT 'urn:ngsi-ld:Word:W-' || w, upper(w), NULL FROM (SELECT unnest(string_split(p_type, ' ')) AS w FROM part)""")
def joi_09_synthetic_per_token(spark, sf_dir):
    from .plans import mapping

    word = {"dataModel": "Word", "identity": {"entityName": "W-{{ this[0] }}"}, "attributes": {"label": {"source": "{{ this[0] | upper }}"}}}
    m = {"version": "v4", "dataModel": "Part", "identity": {"entityName": "{{ p_partkey }}"}, "attributes": {"words": {"type": "ListRelationship", "source": "{{ p_type }}", "syntheticEntity": word}}}
    out = mapping.run(_t(spark, sf_dir, "part"), m, "p_partkey", "normalized")
    return out.select("id", F.get_json_object("entity", "$.label.value").alias("label"), F.json_array_length(F.get_json_object("entity", "$.words.objectList")).cast("long").alias("links"))


# Geometries whose results follow from their corners

_CORNERS = "CAST(c_custkey % 100 AS DOUBLE) AS x, CAST(c_custkey % 50 AS DOUBLE) AS y, CAST(c_custkey % 100 + 1 AS DOUBLE) AS e, CAST(c_custkey % 50 + 2 AS DOUBLE) AS n"
_AT = "'[' || {} || ',' || {} || ']'"
_FOUR = " || ',' || ".join(_AT.format(*p) for p in (("x", "y"), ("e", "y"), ("e", "n"), ("x", "n")))
_CLOSED = _FOUR + " || ',' || " + _AT.format("x", "y")


def _shape(kind: str, coordinates: str) -> str:
    return f"""'{{"type":"{kind}","coordinates":' || {coordinates} || '}}'"""


def _rectangles(spark, sf_dir):
    c = geo.spread(_t(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").selectExpr("c_custkey", *[x for x in _CORNERS.split(", ")])
    at = lambda a, b: F.concat(F.lit("["), F.col(a), F.lit(","), F.col(b), F.lit("]"))
    four = F.concat_ws(",", at("x", "y"), at("e", "y"), at("e", "n"), at("x", "n"))
    return c.withColumns({"four": four, "closed": F.concat_ws(",", four, at("x", "y")), "far": F.concat_ws(",", *[F.concat(F.lit("["), F.col(a) + 3 * i, F.lit(","), F.col(b) + 3 * j, F.lit("]")) for a, b, i, j in (("e", "y", 1, 0), ("e", "y", 2, 0), ("e", "y", 2, 1), ("e", "y", 1, 1), ("e", "y", 1, 0))])})


def _json(kind: str, opened: str, inner: str, closed: str):
    return F.concat(F.lit(f'{{"type":"{kind}","coordinates":{opened}'), F.col(inner), F.lit(f"{closed}}}"))


@query(f"""SELECT c_custkey, {_shape("Point", _AT.format("x + 0.5", "y + 1.0"))} AS centroid, {_shape("Point", _AT.format("x + 0.5", "y + 1.0"))} AS inside, {_shape("Point", _AT.format("x", "y"))} AS first_vertex, {_shape("LineString", f"'[' || {_CLOSED} || ']'")} AS exterior, {_shape("LineString", f"'[' || {_CLOSED} || ']'")} AS boundary, {_shape("Polygon", f"'[[' || {_CLOSED} || ']]'")} AS hull, {_shape("Polygon", f"'[[' || {_CLOSED} || ']]'")} AS envelope, {_shape("MultiPoint", f"'[' || {_FOUR} || ']'")} AS vertices FROM (SELECT c_custkey, {_CORNERS} FROM customer)""")
def geo_13_area_strategies(spark, sf_dir):
    c = _rectangles(spark, sf_dir)
    g = _json("Polygon", "[[", "closed", "]]")
    ways = {"centroid": ("Point", "centroid"), "inside": ("Point", "point-on-surface"), "first_vertex": ("Point", "first-vertex"), "exterior": ("LineString", "exterior-ring"), "boundary": ("LineString", "boundary"), "hull": ("Polygon", "convex-hull"), "envelope": ("Polygon", "envelope"), "vertices": ("MultiPoint", "vertices")}
    return c.select("c_custkey", geo.conversions(g, ways).alias("made")).select("c_custkey", "made.*")


@query(f"""SELECT c_custkey, {_shape("LineString", f"'[' || {_FOUR} || ']'")} AS line, {_shape("Polygon", f"'[[' || {_CLOSED} || ']]'")} AS ring, {_shape("Polygon", f"'[[' || {_CLOSED} || ']]'")} AS first, {_shape("Polygon", "'[[' || " + " || ',' || ".join(_AT.format(f"e + {3 * i}", f"y + {3 * j}") for i, j in ((1, 0), (2, 0), (2, 1), (1, 1), (1, 0))) + " || ']]'")} AS largest, {_shape("MultiPolygon", f"'[[[' || {_CLOSED} || ']]]'")} AS promoted FROM (SELECT c_custkey, {_CORNERS} FROM customer)""")
def geo_19_points_and_parts(spark, sf_dir):
    c = _rectangles(spark, sf_dir).withColumn("two", F.concat(F.lit("[["), F.col("closed"), F.lit("]],[["), F.col("far"), F.lit("]]")))
    points, areas = _json("MultiPoint", "[", "four", "]"), _json("MultiPolygon", "[", "two", "]")
    lines, parts = geo.conversions(points, {"line": ("LineString", "connect"), "ring": ("Polygon", "ring")}), geo.conversions(areas, {"first": ("Polygon", "first"), "largest": ("Polygon", "largest")})
    made = c.select("c_custkey", lines.alias("lines"), parts.alias("parts"), geo.convert(_json("Polygon", "[[", "closed", "]]"), "MultiPolygon").alias("promoted"))
    return made.select("c_custkey", "lines.*", "parts.*", "promoted")


@query("""SELECT c_custkey, '{"type":"Point","coordinates":[' || CAST(-(c_custkey % 170 + 0.25) AS DOUBLE) || ',' || CAST(c_custkey % 80 + 0.5 AS DOUBLE) || ']}' AS point, c_custkey % 400 - 200 BETWEEN -180 AND 180 AND c_custkey % 200 - 100 BETWEEN -90 AND 90 AS fits FROM customer""")
def geo_02_dms_point(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select("c_custkey", geo.dms_point(F.format_string("%d°30'0\"N %d°15'0\"W", k % 80, k % 170)).alias("point"), geo.in_range((k % 400 - 200).cast("double"), (k % 200 - 100).cast("double")).alias("fits"))


# Text and instants


@query("""SELECT p_partkey, CAST(len(regexp_extract_all(p_name || ' / ' || p_type, '[^ ]+')) AS BIGINT) AS words, url_encode(p_name || '/' || p_type) AS strict, replace(url_encode(p_name || '/' || p_type), '%2F', '/') AS loose, '["' || p_name || '","' || p_brand || '"]' AS json FROM part""")
def fns_31_wordcount_urlencode_json(spark, sf_dir):
    p, both = _t(spark, sf_dir, "part"), F.concat("p_name", F.lit("/"), "p_type")
    return p.select("p_partkey", text.wordcount(F.concat("p_name", F.lit(" / "), "p_type")).alias("words"), text.urlencode(both).alias("strict"), text.urlencode(both, strict=False).alias("loose"), text.json_encode(F.array("p_name", "p_brand")).alias("json"))


@query("""SELECT doc_id, replace(text, chr(10), '<br>') AS broken, replace(text, chr(10), chr(10) || '  ') AS indented, CASE WHEN doc_id % 3 = 1 THEN 'y' ELSE 'ies' END AS plural, list_aggregate(range(doc_id % 5), 'string_agg', ',') AS counted FROM documents WHERE NOT contains(text, chr(13))""")
def fns_07_breaks_indent_plural_range(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").where(~F.col("text").contains("\r"))
    numbers = text.range_((F.col("doc_id") % 5).cast("int"))
    return d.select("doc_id", text.newlines_to_br(F.col("text")).alias("broken"), text.indent(F.col("text"), 2).alias("indented"), text.pluralize(F.col("doc_id") % 3, "y", "ies").alias("plural"), F.when(F.size(numbers) > 0, text.join(numbers, ",")).alias("counted"))


_STAMPS = {"spaced": "date_trunc('minute', ts)", "dotted": "date_trunc('minute', ts)", "day_first": "date_trunc('second', ts)", "no_zone": "NULL", "year_only": "NULL", "offset": "date_trunc('second', ts) - INTERVAL 2 HOUR", "named_zone": "CASE WHEN event_id % 2 = 0 THEN date_trunc('second', ts) END"}


@query(" UNION ALL ".join(f"SELECT event_id, '{n}' AS notation, CAST({t} AS TIMESTAMP) AS t FROM events" for n, t in _STAMPS.items()))
def cst_14_stamps(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    at = lambda pattern: F.date_format("ts", pattern)
    rfc = "yyyy-MM-dd'T'HH:mm:ss"
    stamps = {"spaced": at("yyyy-MM-dd HH:mm"), "dotted": at("yyyy-MM-dd HH.mm"), "day_first": at("dd/MM/yyyy HH:mm:ss"), "no_zone": at(rfc), "year_only": at("yyyy"), "offset": F.concat(at(rfc), F.lit("+02:00")), "named_zone": F.concat(at(rfc), F.lit("Z"), F.when(F.col("event_id") % 2 == 0, "[Africa/Abidjan]").otherwise("[Asia/Tokyo]"))}
    each = e.select("event_id", F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in stamps]), F.array(*stamps.values()))).alias("notation", "stamp"))
    return each.select("event_id", "notation", temporal.datetime(F.col("stamp")).cast("timestamp_ntz").alias("t"))


@query("""SELECT p_partkey, p_name || '|x|' || p_brand AS items FROM part""")
def cst_07_array_parts(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    return p.select("p_partkey", F.array_join(casts.array(F.col("p_name"), F.lit('["x",""," "]'), F.lit(None).cast("string"), F.col("p_brand")), "|").alias("items"))


# Attribute kinds, sensor snapshots, grids


@query("""SELECT 'urn:ngsi-ld:Part:' || p_partkey AS id, '{"id":"urn:ngsi-ld:Part:' || p_partkey || '","type":"Part","size":{"type":"Property","value":' || p_size || ',"unitCode":"CMT"},"maker":{"type":"Relationship","object":"urn:ngsi-ld:Brand:' || replace(p_brand, '#', '') || '"},"words":{"type":"ListProperty","valueList":["' || replace(p_name, ' ', '","') || '"]},"near":{"type":"ListRelationship","objectList":["urn:ngsi-ld:Part:' || p_size || '"' || CASE WHEN p_size <> p_partkey THEN ',"urn:ngsi-ld:Part:' || p_partkey || '"' ELSE '' END || ']},"label":{"type":"LanguageProperty","languageMap":{"en":"' || p_name || '","la":"' || upper(p_name) || '"}},"sort":{"type":"VocabProperty","vocab":"https://x.example/' || p_type || '"},"raw":{"type":"JsonProperty","json":{"k":' || p_size || '}},"place":{"type":"GeoProperty","value":{"type":"Point","coordinates":[' || (p_partkey % 90) || ',' || (p_size % 45) || ']}},"box":{"type":"Property","value":{"brand":"' || p_brand || '","deep":{"size":' || p_size || '}}}}' AS entity FROM part""")
def idn_07_attribute_kinds(spark, sf_dir):
    from .plans import mapping

    attributes = {
        "size": {"source": "{{ p_size }}", "transformation": "integer", "properties": {"unitCode": {"source": "cm"}}},
        "maker": {"type": "Relationship", "source": "{{ p_brand }}", "target": {"entity": "Brand"}},
        "words": {"type": "ListProperty", "source": "{{ p_name }}"},
        "near": {"type": "ListRelationship", "source": "{{ p_size }} {{ p_partkey }}", "target": {"entity": "Part"}},
        "label": {"type": "LanguageProperty", "languageMap": {"en": {"source": "{{ p_name }}"}, "la": {"source": "{{ p_name | upper }}"}}},
        "sort": {"type": "VocabProperty", "source": "https://x.example/{{ p_type }}"},
        "raw": {"type": "JsonProperty", "source": "{{ json }}"},
        "place": {"type": "GeoProperty", "source": "{{ point }}"},
        "box": {"mappings": {"brand": {"source": "{{ p_brand }}"}, "deep": {"mappings": {"size": {"source": "{{ p_size }}", "transformation": "integer"}}}}},
    }
    m = {"version": "v4", "dataModel": "Part", "identity": {"entityName": "{{ p_partkey }}"}, "attributes": attributes}
    point = F.format_string('{"type":"Point","coordinates":[%d,%d]}', F.col("p_partkey") % 90, F.col("p_size") % 45)
    p = _t(spark, sf_dir, "part").withColumns({"json": F.format_string('{"k":%d}', "p_size"), "point": point})
    return mapping.run(p, m, "p_partkey", "normalized").select("id", "entity")


@query("""SELECT event_id, value, 'user' || user_id AS thing, event_type AS key, date_trunc('second', ts) AS t FROM events""")
def src_33_sensor_observations(spark, sf_dir):
    from .sources import sensorthings

    e = _t(spark, sf_dir, "events")
    stream = F.concat(F.col("user_id").cast("string"), F.lit("-"), "event_type")
    observed = F.format_string('{"datastream":"%s","observation":{"@iot.id":"%d","phenomenonTime":"%s","result":%s}}', stream, "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.col("value").cast("string"))
    held = F.format_string('{"datastream":{"@iot.id":"%s","name":"s","ObservedProperty":{"name":"%s"},"Thing":{"@iot.id":"%d","name":"user%d"}}}', stream, "event_type", "user_id", "user_id")
    streams = e.select(F.lit("datastream").alias("kind"), held.alias("line")).distinct()
    lines = streams.unionByName(e.select(F.lit("observation").alias("kind"), observed.alias("line"))).select("kind", F.parse_json("line").alias("v"))
    o = sensorthings.observations(lines)
    return o.select(F.col("observation").cast("long").alias("event_id"), F.try_variant_get("value", "$", "double").alias("value"), F.col("thing_name").alias("thing"), "key", F.col("at").cast("timestamp_ntz").alias("t"))


@query("""SELECT user_id AS thing, event_type AS property, m AS stream, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY m) = 1 THEN event_type ELSE event_type || '@' || m END AS key FROM (SELECT DISTINCT user_id, event_type, event_id % 12 AS m FROM events)""")
def src_36_reading_keys(spark, sf_dir):
    from .sources import sensorthings

    e = _t(spark, sf_dir, "events")
    catalog = e.select(F.lit("datastream").alias("kind"), F.col("user_id").alias("thing"), F.col("event_type").alias("property"), (F.col("event_id") % 12).cast("string").alias("stream"), F.lit(0).alias("position")).distinct()
    return sensorthings.reading_keys(catalog).select("thing", "property", F.col("stream").cast("long").alias("stream"), "key")


@query("""SELECT l_orderkey, max(CASE WHEN l_linenumber = 2 THEN l_quantity END) AS two, max(CASE WHEN l_linenumber = 3 THEN l_quantity END) AS three FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL) GROUP BY l_orderkey HAVING max(CASE WHEN l_linenumber IN (2, 3) THEN l_quantity END) IS NOT NULL""")
def src_20_field_records(spark, sf_dir):
    from .sources import gridded

    fields = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").cast("string").alias("line")).agg(F.max("l_quantity").alias("l_quantity"))
    return gridded.pivot_fields(fields, ["l_orderkey"], "line", "l_quantity", ["2", "3"]).toDF("l_orderkey", "two", "three")


@query("""SELECT p_partkey, CASE WHEN p_size <> 7 AND p_size BETWEEN 3 AND 40 THEN p_size * 0.5 + 10 END AS unpacked, CASE p_partkey % 4 WHEN 0 THEN p_size * 10.0 WHEN 2 THEN p_size * 1000.0 ELSE p_size * 1.0 END AS height, CASE p_partkey % 4 WHEN 0 THEN 'hPa' WHEN 1 THEN 'hPa' WHEN 2 THEN 'm' ELSE 'sigma' END AS unit, CASE WHEN p_size % 2 = 0 THEN CAST(p_size // 2 AS VARCHAR) ELSE CAST(p_size // 2 AS VARCHAR) || '.5' END AS location, p_size / 10.0 AS short FROM part""")
def src_26_packed_values(spark, sf_dir):
    from .sources import gridded

    p, size = _t(spark, sf_dir, "part"), F.col("p_size")
    height, unit = gridded.level(size, F.element_at(F.array(*map(F.lit, ("kPa", "hPa", "km", "sigma"))), (F.col("p_partkey") % 4 + 1).cast("int")))
    return p.select("p_partkey", gridded.unpack(size, 0.5, 10.0, 7, 3, 40).alias("unpacked"), height.alias("height"), unit.alias("unit"), gridded.location_number(size / 2).alias("location"), gridded.single_precision((size / 10).cast("float")).alias("short"))


@query("""SELECT c_custkey, round(6378137.0 * radians(CAST(c_custkey % 100 + 1 AS DOUBLE)), 2) AS metres, '{"type":"Point","coordinates":[' || CAST(c_custkey % 100 AS DOUBLE) || ',' || CAST(c_custkey % 50 AS DOUBLE) || ']}' AS single FROM customer""")
def geo_07_length_of_equator(spark, sf_dir):
    c, k = geo.spread(_t(spark, sf_dir, "customer").select("c_custkey"), "c_custkey"), F.col("c_custkey")
    line = F.format_string('{"type":"LineString","coordinates":[[%d,0],[%d,0],[%d,0]]}', k % 7, k % 7 + (k % 100 / 2).cast("int"), k % 7 + k % 100 + 1)
    folded = F.format_string('{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[%s,%s]}]}', (k % 100).cast("double").cast("string"), (k % 50).cast("double").cast("string"))
    return c.select("c_custkey", F.round(geo.length(line), 2).alias("metres"), geo.convert(folded, "Point", "first").alias("single"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 7 AS modulo, round(l_extendedprice / 100) AS whole, l_quantity * 2 - 1 AS twice, abs(l_discount - 1) AS rest FROM lineitem""")
def mth_19_round_modulo(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem")
    return _templates(l, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], {"modulo": "{{ l_partkey % 7 }}", "whole": "{{ (l_extendedprice / 100) | round }}", "twice": "{{ l_quantity * 2 - 1 }}", "rest": "{{ (l_discount - 1) | abs }}"})


@query("""SELECT o_custkey, list_aggregate(list_sort(list(DISTINCT o_orderstatus)), 'string_agg', ',') AS statuses, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS finished FROM orders GROUP BY o_custkey""")
def fns_17_grouped_keys(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_orderstatus")).alias("orders"))
    found = _templates(o, ["o_custkey"], {"statuses": "{{ orders | group_by(attribute='o_orderstatus') | keys | sort | join(sep=',') }}", "n": "{{ orders | length }}", "finished": "{{ orders | group_by(attribute='o_orderstatus') | get(key='F', default=[]) | length }}"})
    return found.withColumns({"n": F.col("n").cast("long"), "finished": F.col("finished").cast("long")})


# Readers, over files written from the tables


def _files(df: DataFrame, tag: str, by: str) -> str:
    """A text file per row of df(by, value)."""
    path = shared.folder(df.sparkSession, tag)
    df.write.partitionBy(by).text(path)
    return path


@query("""SELECT c_custkey AS code, c_name AS name, c_acctbal AS balance, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS segment FROM customer""")
def src_01_csv_scan(spark, sf_dir):
    from .sources import delimited

    path = shared.folder(spark, "csv")
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_mktsegment")).alias("segment"))
    c.repartition(3, "code").write.csv(path, header=True, nullValue="")
    read = lambda n, kind: F.try_variant_get(n, "$", kind).alias(n)
    return delimited.read_delimited(spark, path).where("_ok").select(read("code", "long"), read("name", "string"), read("balance", "double"), read("segment", "string"))


@query("""SELECT c_custkey AS code, c_name AS name, c_nationkey AS nation, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS position FROM customer""")
def src_08_json_records(spark, sf_dir):
    from .sources import documents

    c = _t(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name", "c_nationkey"))).alias("rows"))
    path = _files(c.select("c_nationkey", F.to_json(F.struct(F.lit("x").alias("source"), "rows")).alias("value")), "json", "c_nationkey")
    r = documents.read_json(spark, path).withColumn("r", F.from_json("record", "c_custkey long, c_name string, c_nationkey int"))
    return r.select(F.col("r.c_custkey").alias("code"), F.col("r.c_name").alias("name"), F.col("r.c_nationkey").alias("nation"), "position")


@query("""SELECT s_suppkey AS code, s_name AS name, CAST(s_suppkey % 180 AS DOUBLE) AS x, CAST(s_nationkey AS DOUBLE) AS y, 'survey' AS title FROM supplier""")
def src_10_geojson_features(spark, sf_dir):
    from .sources import documents

    f = F.format_string('{"type":"Feature","id":%d,"properties":{"name":"%s","none":null},"geometry":{"type":"Point","coordinates":[%d,%d]}}', "s_suppkey", "s_name", F.col("s_suppkey") % 180, "s_nationkey")
    s = _t(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.concat_ws(",", F.collect_list(f)).alias("features"))
    path = _files(s.select("s_nationkey", F.concat(F.lit('{"type":"FeatureCollection","title":"survey","features":['), "features", F.lit("]}")).alias("value")), "geojson", "s_nationkey")
    record = documents.read_geojson(spark, path).select(documents.drop_nulls(F.col("record")).alias("r")).where("get_json_object(r, '$.properties.none') IS NULL")
    at = lambda p: F.get_json_object("r", p)
    return record.select(at("$.id").cast("long").alias("code"), at("$.properties.name").alias("name"), at("$.geometry.coordinates[0]").cast("double").alias("x"), at("$.geometry.coordinates[1]").cast("double").alias("y"), at("$.featureCollection.title").alias("title"))


@query("""SELECT n_nationkey AS code, n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey""")
def src_15_xml_records(spark, sf_dir):
    from .sources import documents

    item = F.format_string('<nation code="%d"><n:name>%s</n:name><empty/><note>a</note><note>b</note></nation>', "n_nationkey", "n_name")
    n = _t(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.concat_ws("", F.collect_list(item)).alias("items"))
    n = n.join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    path = _files(n.select("r_name", F.concat(F.lit('<list xmlns:n="urn:n"><title>t</title>'), "items", F.lit("</list>")).alias("value")), "xml", "r_name")
    r = documents.read_xml(spark, path).where("get_json_object(record, '$.note[1]') = 'b' AND get_json_object(record, '$.empty') IS NULL")
    region = F.regexp_extract(F.url_decode("path"), "r_name=([^/]*)/", 1)
    return r.select(F.get_json_object("record", "$['@code']").cast("int").alias("code"), F.get_json_object("record", "$.name").alias("name"), F.url_decode(region).alias("region"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN '[' || p_size || ',' || (p_size + 1) || ']' END AS counts, '["' || p_brand || '"]' AS one, CASE WHEN p_size > 25 THEN '[true,false]' ELSE '[false,true]' END AS flags FROM part""")
def cst_20_list_items(spark, sf_dir):
    from .plans import mapping

    c = Compiler(_t(spark, sf_dir, "part"), {})
    listed = lambda source, how=None: mapping.value(c, {"type": "ListProperty", "source": source} | ({"transformation": how} if how else {}))
    return c.df.select("p_partkey", listed("{{ p_size }} {% if p_partkey % 3 > 0 %}{{ p_size + 1 }}{% else %}n/a{% endif %}", "integer").alias("counts"), listed("{{ p_brand }}").alias("one"), listed("{% if p_size > 25 %}yes 0{% else %}no 1{% endif %}", "boolean").alias("flags"))


@query("""SELECT p_partkey, CAST(p_size AS VARCHAR) || 'x' AS str, p_size * 2 AS int, p_retailprice / 2 AS float FROM part""")
def fns_18_template_casts(spark, sf_dir):
    out = _templates(_t(spark, sf_dir, "part"), ["p_partkey"], {"str": "{{ (p_size | str) ~ 'x' }}", "int": "{{ (p_size | str | int) * 2 }}", "float": "{{ (p_retailprice | str | float) / 2 }}"})
    return out.select("p_partkey", "str", F.col("int").cast("long").alias("int"), F.col("float").cast("double").alias("float"))
