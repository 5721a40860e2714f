"""The registry: every query runs an operator of the engine over whole tables, beside its SQL.

The star-schema and corpus tables hold no configurations, so each operator meets the analogous shape:
documents for files, their lines for configuration lines, conversations for blocks, orders for devices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import scalars
from plumbline.operators import identity, learning, relational
from plumbline.plans import rules
from plumbline.plans.assertions import compile_assertion
from plumbline.registry import ORACLES, QUERIES, query, table
from plumbline.sources import bundle

__all__ = ["ORACLES", "QUERIES", "flagship"]

def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.col("doc_id").alias("device_id"), F.lit("text").alias("file"), F.lit("config").alias("role"), "text")
    return bundle.lines(files)


_LINES = """(SELECT doc_id, source, unnest(range(1, len(p) + 1)) AS line_no, len(p) AS n, unnest(p) AS raw
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL))"""
_REAL = f"(SELECT * FROM {_LINES} WHERE NOT (line_no = n AND raw = ''))"


# -- lines and coverage ---------------------------------------------------------------------------


@query(f"SELECT doc_id, line_no, raw AS text FROM {_REAL}")
def lines_explode(spark, sf_dir):
    return _lines(spark, sf_dir).select(F.col("device_id").alias("doc_id"), F.col("line_no").cast("long").alias("line_no"), F.col("raw").alias("text"))


@query(f"""SELECT doc_id, count(*) AS n_lines, CAST(sum(length(raw) - length(ltrim(raw, ' '))) AS BIGINT) AS indent, CAST(sum(length(trim(raw, ' '))) AS BIGINT) AS trimmed
FROM {_REAL} GROUP BY doc_id""")
def line_indent_trim(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    return rows.groupBy(F.col("device_id").alias("doc_id")).agg(F.count("*").alias("n_lines"), F.sum("indent").cast("long").alias("indent"), F.sum(F.length(F.trim("raw"))).cast("long").alias("trimmed"))


@query(f"""SELECT source, count(*) AS total_lines, count(*) FILTER (WHERE trim(raw, ' ') <> '') AS parsed_lines,
  round_even(100.0 * count(*) FILTER (WHERE trim(raw, ' ') <> '') / count(*), 1)::DOUBLE AS percent FROM {_REAL} GROUP BY source""")
def coverage_by_source(spark, sf_dir):
    rows = _lines(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("device_id"), "source"), "device_id")
    parsed = F.count_if(F.trim("raw") != "")
    return rows.groupBy("source").agg(F.count("*").alias("total_lines"), parsed.alias("parsed_lines"), F.bround(relational.shares(parsed, F.count("*")), 1).alias("percent"))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def residue_anti_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


# -- identity -------------------------------------------------------------------------------------

_SIGNS = [
    ("page", "tracked", [(r"track\(", 6), (r'class="ad"', 5), (r"utm_source", 3)]),
    ("page", "article", [(r"<article>", 5), (r"<h1>", 3), (r"<p>", 2)]),
    ("page", "secure", [(r"https://", 4), (r"<form", 2)]),
]
_SCORES = "SELECT page_id, unnest([" + ", ".join(
    "{'place': %d, 'label': '%s', 'score': %s}" % (k, name, " + ".join(f"CASE WHEN regexp_matches(html, '(?m){p}') THEN {w} ELSE 0 END" for p, w in patterns)) for k, (_, name, patterns) in enumerate(_SIGNS)
) + "]) AS s FROM pages"


def _ranked(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", identity.signature_scores(F.col("html"), _SIGNS).alias("ranked"))


@query(f"SELECT page_id, s.label AS label, CAST(s.score AS BIGINT) AS score FROM ({_SCORES}) WHERE s.score > 0")
def signature_score(spark, sf_dir):
    return _ranked(spark, sf_dir).select("page_id", F.explode("ranked").alias("s")).select("page_id", F.col("s.os").alias("label"), F.col("s.score").cast("long").alias("score"))


@query(f"""WITH r AS (SELECT page_id, s.label AS label, s.score AS score, row_number() OVER (PARTITION BY page_id ORDER BY s.score DESC, s.place) AS k FROM ({_SCORES}) WHERE s.score > 0),
w AS (SELECT page_id, max(label) FILTER (WHERE k = 1) AS label, max(score) FILTER (WHERE k = 1) AS best, coalesce(max(score) FILTER (WHERE k = 2), 0) AS second FROM r GROUP BY page_id)
SELECT page_id, label, round_even(least(0.15::DOUBLE + 0.85::DOUBLE * least(best / 20.0::DOUBLE, 1.0::DOUBLE), 1.0::DOUBLE) * (0.5::DOUBLE + 0.5::DOUBLE * (best - second) / best), 3)::DOUBLE AS confidence FROM w""")
def winner_margin_confidence(spark, sf_dir):
    rows = _ranked(spark, sf_dir).where(F.size("ranked") > 0)
    return rows.select("page_id", F.get("ranked", F.lit(0))["os"].alias("label"), identity.confidence(F.col("ranked")).alias("confidence"))


@query("""SELECT page_id, CASE WHEN regexp_extract(html, '<h1>([^<]+)</h1>', 1) <> '' THEN 0 WHEN regexp_extract(html, '<title>([^<]+)</title>', 1) <> '' THEN 1 ELSE 2 END AS rank,
CASE WHEN regexp_extract(html, '<h1>([^<]+)</h1>', 1) <> '' THEN regexp_extract(html, '<h1>([^<]+)</h1>', 1) ELSE nullif(regexp_extract(html, '<title>([^<]+)</title>', 1), '') END AS value FROM pages""")
def priority_extract(spark, sf_dir):
    found = [F.nullif(F.regexp_extract("html", p, 1), F.lit("")) for p in ("<h1>([^<]+)</h1>", "<title>([^<]+)</title>")]
    rank = F.when(found[0].isNotNull(), 0).when(found[1].isNotNull(), 1).otherwise(2)
    return table(spark, sf_dir, "pages").select("page_id", rank.alias("rank"), F.coalesce(*found).alias("value"))


@query("""SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS n_chars FROM conversations WHERE text IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn, role, text) = 1""")
def pick_largest_file(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("text is not null")
    return relational.first_per(rows, ["conv_id"], F.length("text").desc(), F.col("turn"), F.col("role"), F.col("text")).select("conv_id", "turn", F.length("text").cast("long").alias("n_chars"))


@query("""SELECT event_id, TRY_CAST(nullif(regexp_extract(props, '"k": *(-?[0-9]+)', 1), '') AS BIGINT) AS k FROM events""")
def kv_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.nullif(F.regexp_extract("props", r'"k": *(-?[0-9]+)', 1), F.lit("")).try_cast("bigint").alias("k"))


@query("""SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING) AS asked_at
FROM (SELECT DISTINCT conv_id, turn, role FROM conversations)""")
def block_context_last(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").distinct()
    return rows.withColumn("asked_at", F.last(F.when(F.col("role") == "user", F.col("turn")), True).over(W.partitionBy("conv_id").orderBy("turn", "role").rowsBetween(W.unboundedPreceding, 0)))


@query("""SELECT CASE WHEN lower(url) LIKE '%.html' THEN 'file' WHEN contains(url, '?') THEN 'query' WHEN contains(url, '#') THEN 'fragment' WHEN url LIKE '%/' THEN 'folder' ELSE 'plain' END AS role, count(*) AS n
FROM pages GROUP BY 1""")
def role_classify(spark, sf_dir):
    u = F.col("url")
    role = F.when(F.lower(u).endswith(".html"), "file").when(F.contains(u, F.lit("?")), "query").when(F.contains(u, F.lit("#")), "fragment").when(u.endswith("/"), "folder").otherwise("plain")
    return table(spark, sf_dir, "pages").groupBy(role.alias("role")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, TRY_CAST(k AS INTEGER) AS k_int, CAST(ceil(TRY_CAST(k AS INTEGER) / 60.0) AS INTEGER) AS minutes,
CASE WHEN k IN ('1') THEN true WHEN k IN ('0') THEN false END AS flag, event_type AS word
FROM (SELECT event_id, event_type, regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS k FROM events)""")
def transform_lib_casts(spark, sf_dir):
    k = F.regexp_extract("props", r'"k": *(-?[0-9]+)', 1)
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", k.alias("k"))
    t = scalars.transform
    return rows.select("event_id", t("to_int", F.col("k")).cast("int").alias("k_int"), t("minutes_from_seconds", F.col("k")).cast("int").alias("minutes"), t("to_bool", F.col("k")).cast("boolean").alias("flag"), t("identity", F.col("event_type")).alias("word"))


# -- the assertion language -----------------------------------------------------------------------


@query("""SELECT a, b, a AND b AS both, a OR b AS either, NOT a AS no, count(*) AS n FROM (SELECT CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS a, CASE user_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS b FROM events) GROUP BY ALL""")
def kleene_truth_table(spark, sf_dir):
    """The connectives over every event, by what they give."""
    truth = lambda c: f"CASE {c} % 3 WHEN 0 THEN true WHEN 1 THEN false END"
    rows = table(spark, sf_dir, "events").selectExpr(f"named_struct('a', {truth('event_id')}, 'b', {truth('user_id')}) AS d")
    c = lambda s: compile_assertion(s, rows.schema).value
    made = rows.select("d.a", "d.b", c("d.a and d.b").alias("both"), c("d.a or d.b").alias("either"), c("not d.a").alias("no"))
    return made.groupBy("a", "b", "both", "either", "no").agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN quality IS NULL THEN 'unknown' WHEN quality <= 0 THEN 'pass' ELSE 'fail' END AS verdict, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def compare_unknown(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").select(F.struct("quality").alias("label"))
    return rows.groupBy(compile_assertion("label.quality <= 0", rows.schema).verdict().alias("verdict")).agg(F.count("*").alias("n"))


def _orders(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.col("l_quantity").cast("int")).alias("quantities"), F.array_sort(F.collect_set("l_returnflag")).alias("flags"))
    orders = table(spark, sf_dir, "orders")
    return orders.join(items, "o_orderkey", "left").select(
        F.col("o_orderkey").alias("device_id"), "o_custkey",
        F.struct(F.col("o_orderstatus").alias("status"), F.floor("o_totalprice").cast("long").alias("price"), F.col("o_orderpriority").alias("priority")).alias("mgmt"),
        F.when(F.col("quantities").isNotNull(), F.struct("quantities", "flags")).alias("aaa"),
    )


_ORDERS = """(SELECT o_orderkey, o_custkey, o_orderstatus AS status, CAST(floor(o_totalprice) AS BIGINT) AS price, o_orderpriority AS priority, q, f
FROM orders LEFT JOIN (SELECT l_orderkey, list(CAST(trunc(l_quantity) AS INTEGER)) AS q, list_sort(list(DISTINCT l_returnflag)) AS f FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey)"""


@query(f"SELECT o_orderkey, CASE WHEN q IS NULL THEN NULL ELSE len(list_filter(q, lambda x: x > 45)) = 0 END AS holds FROM {_ORDERS}")
def quantifier_all(spark, sf_dir):
    rows = _orders(spark, sf_dir)
    return rows.select(F.col("device_id").alias("o_orderkey"), compile_assertion("all(aaa.quantities, q <= 45)", rows.schema).value.alias("holds"))


@query(f"SELECT o_orderkey, CASE WHEN q IS NULL THEN NULL ELSE len(list_filter(q, lambda x: x IN (1, 2, 50))) > 0 END AS holds FROM {_ORDERS}")
def quantifier_any(spark, sf_dir):
    rows = _orders(spark, sf_dir)
    return rows.select(F.col("device_id").alias("o_orderkey"), compile_assertion("any(aaa.quantities, q in [1, 2, 50])", rows.schema).value.alias("holds"))


@query(f"SELECT o_orderkey, CASE WHEN f IS NULL THEN NULL ELSE list_has_all(['N', 'A'], f) END AS within, priority IN ('1-URGENT', '2-HIGH') AS pressing FROM {_ORDERS}")
def subset_in(spark, sf_dir):
    rows = _orders(spark, sf_dir)
    c = lambda s: compile_assertion(s, rows.schema).value
    return rows.select(F.col("device_id").alias("o_orderkey"), c("subset(aaa.flags, [N, A])").alias("within"), c("mgmt.priority in ['1-URGENT', '2-HIGH']").alias("pressing"))


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN NULL ELSE l.toxic IS NOT NULL END AS there, CASE WHEN l.doc_id IS NULL THEN 'labels' END AS missing FROM documents d LEFT JOIN labels l USING (doc_id)""")
def defined_section(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.struct("quality", "toxic").alias("labels"))
    rows = table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left")
    c = compile_assertion("defined(labels.toxic)", rows.schema)
    return rows.select("doc_id", c.value.alias("there"), F.get(c.missing, F.lit(0)).alias("missing"))


_RULES = [
    rules.Rule("R1", "critical", "mgmt.status == \"F\"", "Filled"),
    rules.Rule("R2", "high", "mgmt.price <= 150000 and not mgmt.priority in ['5-LOW']", "Priced"),
    rules.Rule("R3", "medium", "all(aaa.quantities, q <= 45)", "Bounded"),
    rules.Rule("R4", "low", "not any(aaa.flags, f in [R]) or mgmt.status == \"O\"", "Not returned"),
]
_FIELDS = ("rule_id", "severity", "verdict")
_VERDICTS = f"""(SELECT o_orderkey, o_custkey, v.rule_id AS rule_id, v.severity AS severity, CASE WHEN v.holds IS NULL THEN 'unknown' WHEN v.holds THEN 'pass' ELSE 'fail' END AS verdict FROM (
SELECT o_orderkey, o_custkey, unnest([
 {{'rule_id': 'R1', 'severity': 'critical', 'holds': status = 'F'}},
 {{'rule_id': 'R2', 'severity': 'high', 'holds': price <= 150000 AND priority <> '5-LOW'}},
 {{'rule_id': 'R3', 'severity': 'medium', 'holds': CASE WHEN q IS NOT NULL THEN len(list_filter(q, lambda x: x > 45)) = 0 END}},
 {{'rule_id': 'R4', 'severity': 'low', 'holds': (CASE WHEN f IS NOT NULL THEN NOT list_contains(f, 'R') END) OR status = 'O'}}]) AS v FROM {_ORDERS}))"""


@query(f"SELECT o_orderkey, rule_id, verdict FROM {_VERDICTS}")
def verdict_unpivot(spark, sf_dir):
    found = rules.findings(_orders(spark, sf_dir), _RULES, vendor="", fields=_FIELDS)
    return found.select(F.col("device_id").alias("o_orderkey"), "rule_id", "verdict")


@query(f"SELECT rule_id, count(*) FILTER (WHERE verdict = 'pass') AS n_pass, count(*) FILTER (WHERE verdict = 'fail') AS n_fail, count(*) FILTER (WHERE verdict = 'unknown') AS n_unknown FROM {_VERDICTS} GROUP BY rule_id")
def verdict_counts(spark, sf_dir):
    found = rules.findings(_orders(spark, sf_dir), _RULES, vendor="", fields=_FIELDS)
    return found.groupBy("rule_id").agg(*(F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("pass", "fail", "unknown")))


@query(f"SELECT severity, count(*) AS n FROM {_VERDICTS} WHERE verdict = 'fail' GROUP BY severity")
def severity_counts(spark, sf_dir):
    return rules.findings(_orders(spark, sf_dir), _RULES, vendor="", fields=_FIELDS).where("verdict = 'fail'").groupBy("severity").agg(F.count("*").alias("n"))


@query(f"SELECT o_custkey, CAST(round_even(100.0::DOUBLE * count(*) FILTER (WHERE verdict = 'pass') / count(*), 0) AS INTEGER) AS score FROM {_VERDICTS} GROUP BY o_custkey")
def score_half_even(spark, sf_dir):
    orders = _orders(spark, sf_dir)
    found = rules.findings(orders.withColumnRenamed("device_id", "o").withColumnRenamed("o_custkey", "device_id"), _RULES, vendor="", fields=_FIELDS)
    return rules.summary(found).select(F.col("device_id").alias("o_custkey"), "score")


@query("""SELECT n_nationkey, coalesce(CASE n_name WHEN 'NATION_1' THEN 'own' WHEN 'FRANCE' THEN 'own' END, CASE WHEN n_regionkey IN (0, 2) THEN 'region' END) AS target FROM nation""")
def remediation_lookup(spark, sf_dir):
    known = {"own": ["NATION_1", "FRANCE"], "region": [0, 2]}
    first = F.when(F.col("n_name").isin(*known["own"]), "own")
    return table(spark, sf_dir, "nation").select("n_nationkey", F.coalesce(first, F.when(F.col("n_regionkey").isin(*known["region"]), "region")).alias("target"))


@query("""WITH e AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events),
h AS (SELECT user_id, place AS hit FROM e WHERE event_type = (SELECT min(event_type) FROM events))
SELECT h.user_id, h.hit, e.place, e.event_id FROM h JOIN e ON e.user_id = h.user_id AND e.place BETWEEN h.hit - 3 AND h.hit + 3""")
def evidence_window(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    placed = events.withColumn("place", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))).select("event_id", "user_id", "event_type", F.col("place").cast("long").alias("place"))
    least = events.agg(F.min("event_type").alias("event_type"))
    hits = placed.join(F.broadcast(least), "event_type").select("user_id", "place")
    return relational.window_of(placed, hits, ["user_id"], "place", 3).select("user_id", "hit", "place", "event_id")


@query("SELECT p_partkey, p_brand FROM part WHERE lower(p_brand) LIKE 'brand#1%' OR lower(p_type) LIKE 'promo%'")
def framework_prefix_filter(spark, sf_dir):
    hit = F.exists(F.array(F.col("p_brand"), F.col("p_type")), lambda f: F.lower(f).startswith("brand#1") | F.lower(f).startswith("promo"))
    return table(spark, sf_dir, "part").where(hit).select("p_partkey", "p_brand")


@query("""SELECT p_partkey, s.l_suppkey AS s_suppkey FROM part LEFT JOIN (SELECT l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) = 1) s ON l_partkey = p_partkey""")
def first_binding_join(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    first = items.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min(F.struct("l_orderkey", "l_linenumber", "l_suppkey")).alias("f"))
    return table(spark, sf_dir, "part").select("p_partkey").join(first, "p_partkey", "left").select("p_partkey", F.col("f.l_suppkey").alias("s_suppkey"))


_BANDS = [(1, 0.0, 50000.0, "low"), (2, 40000.0, 120000.0, "mid"), (3, 100000.0, 200000.0, "high"), (4, 0.0, 1000000.0, "any")]


@query("SELECT o_orderkey, band FROM orders LEFT JOIN (VALUES " + ", ".join(map(str, _BANDS)) + ") b(ord, lo, hi, band) ON o_totalprice BETWEEN lo AND hi QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY ord) = 1")
def range_join_first(spark, sf_dir):
    bands = spark.createDataFrame(_BANDS, "ord int, lo double, hi double, band string")
    return relational.first_band(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), bands, "o_totalprice").select("o_orderkey", "band")


# -- fleet ----------------------------------------------------------------------------------------


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b, a.s_nationkey AS s_nationkey FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def adjacency_self_join(spark, sf_dir):
    return relational.pairs_within(table(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey", 10_000).select("a", "b", "s_nationkey")


@query("""SELECT sha256(c_nationkey || ':' || c_mktsegment) AS fingerprint, count(*) AS holders, min(c_custkey) AS first, max(c_custkey) AS last FROM customer GROUP BY 1 HAVING count(*) >= 2""")
def shared_credential(spark, sf_dir):
    mark = F.sha2(F.concat_ws(":", F.col("c_nationkey").cast("string"), "c_mktsegment").cast("binary"), 256)
    found = table(spark, sf_dir, "customer").groupBy(mark.alias("fingerprint")).agg(F.count("*").alias("holders"), F.min("c_custkey").alias("first"), F.max("c_custkey").alias("last"))
    return found.where("holders >= 2")


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey * 7 + 3) % 25 AS dst FROM nation UNION SELECT n_nationkey, (n_nationkey + 11) % 25 FROM nation WHERE n_regionkey = 1),
r(start, node, depth) AS (SELECT n_nationkey, n_nationkey, 0 FROM nation UNION SELECT start, dst, depth + 1 FROM r JOIN e ON src = node WHERE depth < 6)
SELECT start, node, min(depth) AS depth FROM r GROUP BY start, node""")
def bfs_reachability(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    n = F.col("n_nationkey")
    edges = nation.select(n.alias("src"), ((n * 7 + 3) % 25).alias("dst")).union(nation.where("n_regionkey = 1").select(n, (n + 11) % 25)).distinct()
    return relational.reach(edges, nation.select(n.alias("start")), 6)


_SNAP = """(SELECT l_orderkey, CASE WHEN min(l_linestatus) = 'F' THEN 'pass' ELSE 'fail' END AS v FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-06-01' GROUP BY 1) a
FULL JOIN (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'pass' WHEN 'O' THEN 'fail' ELSE 'not_applicable' END AS v FROM orders) b ON l_orderkey = o_orderkey"""


@query(f"""SELECT coalesce(l_orderkey, o_orderkey) AS key, coalesce(a.v, 'absent') AS before, coalesce(b.v, 'absent') AS after,
CASE WHEN b.v = 'fail' AND coalesce(a.v, 'absent') <> 'fail' THEN 'regression' WHEN a.v = 'fail' AND b.v IN ('pass', 'not_applicable') THEN 'improvement' ELSE 'other' END AS change
FROM {_SNAP} WHERE coalesce(a.v, 'absent') <> coalesce(b.v, 'absent')""")
def drift_global(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").where("l_shipdate < timestamp'1996-06-01'")
    before = items.groupBy(F.col("l_orderkey").alias("key")).agg(F.when(F.min("l_linestatus") == "F", "pass").otherwise("fail").alias("v"))
    s = F.col("o_orderstatus")
    after = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.when(s == "F", "pass").when(s == "O", "fail").otherwise("not_applicable").alias("v"))
    return relational.drift(before, after, "key", "v")


@query("""WITH i AS (SELECT l_orderkey, l_linenumber, min(l_quantity) AS lo, max(l_quantity + 20 * l_discount) AS hi, min(l_returnflag) AS act FROM lineitem GROUP BY 1, 2)
SELECT b.l_orderkey, b.l_linenumber AS later, a.l_linenumber AS earlier, CASE WHEN a.act = b.act THEN 'medium' ELSE 'high' END AS severity
FROM i b JOIN i a ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.lo <= b.lo AND b.hi <= a.hi
QUALIFY row_number() OVER (PARTITION BY b.l_orderkey, b.l_linenumber ORDER BY a.l_linenumber) = 1""")
def acl_shadow(spark, sf_dir):
    """For each later entry the first earlier one that covers it, within the array of an order's entries:
    no self join and no pair rows."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("lo"), F.max(F.col("l_quantity") + 20 * F.col("l_discount")).alias("hi"), F.min("l_returnflag").alias("act"))
    entries = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), "lo", "hi", "act"))).alias("e"))
    rows = entries.select("l_orderkey", "e", F.explode("e").alias("b"))
    first = F.get(F.filter("e", lambda a: (a["n"] < F.col("b.n")) & (a["lo"] <= F.col("b.lo")) & (F.col("b.hi") <= a["hi"])), F.lit(0))
    hit = rows.withColumn("a", first).where("a is not null")
    return hit.select("l_orderkey", F.col("b.n").alias("later"), F.col("a.n").alias("earlier"), F.when(F.col("a.act") == F.col("b.act"), "medium").otherwise("high").alias("severity"))


@query("""SELECT p_brand AS id, 10 * count(*) FILTER (WHERE l_returnflag = 'R') + CASE WHEN max(p_size) > 45 THEN 8 WHEN max(p_size) > 40 THEN 5 ELSE 2 END AS score,
row_number() OVER (ORDER BY 10 * count(*) FILTER (WHERE l_returnflag = 'R') + CASE WHEN max(p_size) > 45 THEN 8 WHEN max(p_size) > 40 THEN 5 ELSE 2 END DESC, p_brand) AS rank
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand""")
def rank_fixes(spark, sf_dir):
    """Actions by ten times the paths that they cut plus the weight of their severity."""
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count_if(F.col("l_returnflag") == "R").alias("cut"))
    by = table(spark, sf_dir, "part").join(counts, "p_partkey").groupBy(F.col("p_brand").alias("id")).agg(F.sum("cut").alias("cut"), F.max("p_size").alias("size"))
    weight = F.when(F.col("size") > 45, 8).when(F.col("size") > 40, 5).otherwise(2)
    scored = by.select("id", (10 * F.col("cut") + weight).cast("long").alias("score"))
    return scored.withColumn("rank", F.row_number().over(W.orderBy(F.col("score").desc(), "id")).cast("long"))


@query("""SELECT p_partkey, CASE WHEN contains(lower(p_type), 'brass') OR contains(lower(p_type), 'tin') THEN 3 WHEN contains(lower(p_type), 'polished') THEN 2 WHEN contains(lower(p_type), 'promo') THEN 0 ELSE 1 END AS phase FROM part""")
def phase_classify(spark, sf_dir):
    from plumbline.operators.report import phase

    return table(spark, sf_dir, "part").select("p_partkey", phase(F.col("p_type"), [(3, ["brass", "tin"]), (2, ["polished"]), (0, ["promo"])]).alias("phase"))


@query("""SELECT d.doc_id AS doc_id, l.quality AS before, l.toxic AS after FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS DISTINCT FROM l.toxic""")
def fact_diff_null_safe(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.where(~F.col("quality").eqNullSafe(F.col("toxic"))).select("doc_id", F.col("quality").alias("before"), F.col("toxic").alias("after"))


# -- hashing --------------------------------------------------------------------------------------


_UP = "list_transform(range(0, (len(l) + 1) // 2), lambda i: CASE WHEN 2 * i + 2 <= len(l) THEN sha256('\\x01'::BLOB || unhex(l[2 * i + 1]) || unhex(l[2 * i + 2])) ELSE l[2 * i + 1] END)"
_MERKLE = (
    "WITH l0 AS (SELECT l_orderkey, count(*) AS n, list(sha256('\\x00'::BLOB || encode(l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey)) ORDER BY l_linenumber, sha256('\\x00'::BLOB || encode(l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey))) AS l FROM lineitem GROUP BY l_orderkey)"
    + "".join(f", l{k + 1} AS (SELECT l_orderkey, n, CASE WHEN len(l) > 1 THEN {_UP} ELSE l END AS l FROM l{k})" for k in range(6))
    + " SELECT l_orderkey, CAST(n AS INTEGER) AS n, l[1] AS root FROM l6"
)
_KEY = b"fleet".ljust(64, b"\0")
_PADS = ["".join(f"\\x{b ^ x:02X}" for b in _KEY) for x in (0x36, 0x5C)]


@query("""SELECT o_orderkey, sha256('\\x00'::BLOB || encode('{"id":' || o_orderkey || ',"status":"' || o_orderstatus || '"}')) AS leaf FROM orders""")
def leaf_hash(spark, sf_dir):
    text = F.concat(F.lit('{"id":'), F.col("o_orderkey").cast("string"), F.lit(',"status":"'), F.col("o_orderstatus"), F.lit('"}'))
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.leaf_hash(text).alias("leaf"))


@query(_MERKLE)
def merkle_root(spark, sf_dir):
    leaf = scalars.leaf_hash(F.concat_ws(":", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))))
    leaves = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", leaf.alias("h")))), lambda x: x["h"]).alias("leaves"))
    return leaves.select("l_orderkey", F.size("leaves").alias("n"), relational.merkle_root(F.col("leaves")).alias("root"))


@query("""WITH c AS (SELECT user_id, event_id, row_number() OVER w AS seq, sha256(event_id || ':' || event_type) AS entry, lag(sha256(event_id || ':' || event_type)) OVER w AS prev FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, count(*) AS entries, count(*) FILTER (WHERE seq = 1 OR prev IS NOT NULL) AS linked, max(entry) FILTER (WHERE seq = 1) AS genesis FROM c GROUP BY user_id""")
def chain_lag_verify(spark, sf_dir):
    from plumbline.operators.ledger import linked

    entry = F.sha2(F.concat_ws(":", F.col("event_id").cast("string"), "event_type"), 256)
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", entry.alias("entry_hash"))
    chained = linked(rows, ["user_id"], "event_id")
    return chained.groupBy("user_id").agg(F.count("*").alias("entries"), F.count_if((F.col("place") == 1) | F.col("previous").isNotNull()).alias("linked"), F.max(F.when(F.col("place") == 1, F.col("entry_hash"))).alias("genesis"))


@query(f"SELECT c_custkey, left(sha256('{_PADS[1]}'::BLOB || unhex(sha256('{_PADS[0]}'::BLOB || encode(c_name)))), 32) AS fingerprint FROM customer")
def hmac_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.credential_fingerprint(b"fleet", F.col("c_name")).alias("fingerprint"))


# -- text and learning ----------------------------------------------------------------------------

_MAIL, _ADDRESS = r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"


@query(f"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '{_MAIL}', '<redacted>', 'g'), '{_ADDRESS}', '<redacted>', 'g')) AS masked, regexp_matches(text, '{_MAIL}') AS has_mail FROM documents")
def redact_email_ip(spark, sf_dir):
    # texts without the sign that every match holds need no pattern
    at = F.contains("text", F.lit("@"))
    masked = F.regexp_replace(F.when(at, F.regexp_replace("text", _MAIL, scalars.MARK)).otherwise(F.col("text")), _ADDRESS, scalars.MARK)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(masked.cast("binary")).alias("masked"), (at & F.col("text").rlike(_MAIL)).alias("has_mail"))


@query(f"SELECT md5(shape) AS family, count(*) AS n, min(doc_id) AS first FROM (SELECT doc_id, regexp_replace(lower(raw), '[0-9]+', '*', 'g') AS shape FROM {_REAL} WHERE regexp_matches(raw, '[0-9]')) GROUP BY 1")
def line_shape_family(spark, sf_dir):
    rows = _lines(spark, sf_dir).where(F.col("raw").rlike("[0-9]")).select(F.col("device_id").alias("doc_id"), F.regexp_replace(F.lower("raw"), "[0-9]+", "*").alias("shape"))
    return rows.groupBy(F.md5(F.col("shape").cast("binary")).alias("family")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


_WORD = "unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9+-]*'))"


@query(f"""WITH bw AS (SELECT item_id, w, count(*)::DOUBLE AS tf FROM (SELECT item_id, {_WORD} AS w FROM benchmark) GROUP BY ALL),
idf AS (SELECT w, ln(((SELECT count(*) FROM benchmark) + 1) / (count(*) + 1)) + 1 AS idf FROM bw GROUP BY w),
bv AS (SELECT item_id, w, tf * idf / sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY item_id)) AS v FROM bw JOIN idf USING (w)),
dw AS (SELECT doc_id, w, count(*)::DOUBLE AS tf FROM (SELECT doc_id, {_WORD} AS w FROM documents) GROUP BY ALL),
dv AS (SELECT doc_id, w, tf * idf / sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY doc_id)) AS v FROM dw JOIN idf USING (w)),
s AS (SELECT doc_id, item_id, round(sum(dv.v * bv.v), 6) AS score FROM dv JOIN bv USING (w) GROUP BY ALL)
SELECT doc_id, item_id, score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) = 1""")
def tfidf_rank(spark, sf_dir):
    words = lambda df, i: df.select(i, F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z][a-z0-9+-]*)"), F.lit(1))).alias("feature"), F.lit(1.0).alias("value"))
    vocabulary = learning.vectors(words(table(spark, sf_dir, "benchmark"), "item_id"), "item_id")
    ranked = learning.rank(words(table(spark, sf_dir, "documents"), "doc_id"), vocabulary, "doc_id", "item_id", 1)
    return ranked.select("doc_id", "item_id", "score")


@query("""WITH w AS (SELECT DISTINCT '#' || u.w || '#' AS p FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9+-]*')) AS w FROM benchmark) u)
SELECT substr(p, i, 3) AS trigram, count(*) AS n FROM (SELECT p, unnest(range(1, length(p) - 1)) AS i FROM w) GROUP BY 1""")
def trigram_features(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z][a-z0-9+-]*)"), F.lit(1))).alias("w")).distinct()
    return words.select(F.explode(learning.trigrams(F.col("w"))).alias("trigram")).groupBy("trigram").agg(F.count("*").alias("n"))


_SAID = "(SELECT quality = 0 AS truth, CASE WHEN n_chars < 60 THEN NULL ELSE n_chars < 400 END AS said FROM labels JOIN documents USING (doc_id))"


@query(f"""SELECT tp, fp, fn, cautious, tn, round_even(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6)::DOUBLE AS precision, round_even(coalesce(tp / nullif(tp + fn + cautious, 0)::DOUBLE, 0), 6)::DOUBLE AS recall,
round_even((tp + tn) / n::DOUBLE, 6)::DOUBLE AS agreement, round_even(u / n::DOUBLE, 6)::DOUBLE AS unknown_rate FROM (
SELECT count(*) FILTER (WHERE truth AND said) AS tp, count(*) FILTER (WHERE NOT truth AND said) AS fp, count(*) FILTER (WHERE truth AND NOT said) AS fn, count(*) FILTER (WHERE truth AND said IS NULL) AS cautious,
count(*) FILTER (WHERE NOT truth AND NOT said) AS tn, count(*) AS n, count(*) FILTER (WHERE said IS NULL) AS u FROM {_SAID})""")
def confusion_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return relational.confusion(rows, F.col("quality") == 0, F.when(F.col("n_chars") >= 60, F.col("n_chars") < 400))


@query("""SELECT lang, count(*) AS n, count(l.doc_id) AS proposed, count(*) FILTER (WHERE l.quality = 1) AS right, round_even(count(*) FILTER (WHERE l.quality = 1) / count(*)::DOUBLE, 6)::DOUBLE AS accuracy FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY lang""")
def heldout_eval(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").withColumn("there", F.lit(1)), "doc_id", "left")
    right = F.count_if(F.col("quality") == 1)
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count("there").alias("proposed"), right.alias("right"), F.bround(right / F.count("*"), 6).alias("accuracy"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all orders, their score and worst failures."""
    found = rules.findings(_orders(spark, sf_dir), _RULES, vendor="", fields=_FIELDS)
    return rules.summary(found)


# the queries over rendered configurations register themselves
from plumbline import catalog_devices, catalog_graph, catalog_streams, catalog_text  # noqa: E402, F401
