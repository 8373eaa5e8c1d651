"""Registered queries over runs, replies and regressions whose answers SQL can state in closed form."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from .functions import payload as P
from .operators import absorb as B
from .operators import designs as Z
from .operators import features as X
from .operators import generate as G
from .operators import regression as R
from .operators import metrics as M
from .operators import runs as N
from .operators.validate import Field
from .queries import DEALT, EVENTS, INTENT, RATING, SELECTIONS, bits, catalog, coefficients, deterministic_outcomes, design, fields, iid_weighted_assign, llm_mock_outcomes, panelists, query, r6, rounded, uniform_assign
from .queries_files import planned
from .plans.storage import scratch
from .sources import adapters as A
from .sources import jsonl as J
from .sources import raw_files as W

# exposure and runs


def spread(assigned, goods):
    per = assigned.join(goods.withColumn("known", F.lit(1)), "product_id", "left").groupBy("panelist_id", "t").agg(F.count("*").alias("n"), F.count_distinct("product_id").alias("d"), F.count("known").alias("k"))
    return per.agg(F.count("*").alias("n_periods"), F.sum("n").alias("n"), F.min("d").alias("least_distinct"), F.sum("k").alias("n_known"))


SPREAD = "SELECT count(*) AS n_periods, CAST({0} * count(*) AS BIGINT) AS n, CAST({0} AS BIGINT) AS least_distinct, CAST({0} * count(*) AS BIGINT) AS n_known FROM customer"


@query(SPREAD.format(3))
def uniform_assign_counts(spark, sf):
    return spread(uniform_assign(spark, sf), catalog(spark, sf))


@query(SPREAD.format(2))
def weighted_assign_counts(spark, sf):
    return spread(iid_weighted_assign(spark, sf), catalog(spark, sf).where("weight > 0"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS panelist_id, 'p1,p2,p3' AS products FROM customer")
def balanced_shows_all(spark, sf):
    goods = spark.createDataFrame([("p1",), ("p2",), ("p3",)], "product_id string")
    rows = N.decide(N.Policy("random", per_period=3), panelists(spark, sf), goods)
    return rows.groupBy("panelist_id").agg(F.array_join(F.array_sort(F.collect_list("product_id")), ",").alias("products"))


@query("SELECT count(*) * 4 AS n, count(*) * 4 AS n_ratings, count(*) * 4 AS n_intents, CAST(5 AS BIGINT) AS distinct_ratings, CAST(3 AS BIGINT) AS distinct_intents FROM customer")
def deterministic_outcome_ranges(spark, sf):
    rows = deterministic_outcomes(spark, sf)
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("rating").between(1, 5)).alias("n_ratings"), F.count_if(F.col("intent").isin("no", "maybe", "yes")).alias("n_intents"), F.count_distinct("rating").alias("distinct_ratings"), F.count_distinct("intent").alias("distinct_intents"))


FIELDS = {"outcomes": [{"name": "rating", "type": "int", "min": 1, "max": 5}, {"name": "intent", "type": "categorical", "choices": ["no", "maybe", "yes"]}]}
RUN = """WITH c AS (SELECT count(*) AS n FROM customer), s AS (SELECT count(*) AS n FROM orders WHERE o_orderkey % 5 = 0)
 SELECT 'random' AS policy, 'evaluation' AS event_type, 2 * n AS n, 2 * n AS n_ids, 2 * n AS n_outcomes FROM c UNION ALL SELECT 'manual', 'evaluation', n, n, n FROM s
 UNION ALL SELECT 'self_selection', 'selection', 2 * n, 2 * n, 0 FROM c UNION ALL SELECT 'self_selection', 'evaluation', 4 * n, 4 * n, 4 * n FROM c"""


@query(RUN)
def run_event_counts(spark, sf):
    """A run of each policy: events, distinct ids and outcomes by type."""
    policies = [{"name": "random", "periods": 2}, {"name": "manual", "periods": 2}, {"name": "self_selection", "periods": 2, "menu_size": 5, "cap": 2, "allow_empty": False}]
    people, goods, plan = panelists(spark, sf), catalog(spark, sf), J.schedule(planned(spark, sf).withColumn("_ord", F.monotonically_increasing_id()))
    out = None
    for p in policies:
        ev = N.build({"policy": p, "questionnaire": FIELDS, "select": 3}, people, goods, plan)
        n = ev.groupBy("policy", "event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("n_ids"), F.count_if(F.col("outcomes").isNotNull()).alias("n_outcomes"))
        out = n if out is None else out.unionByName(n)
    return out


@query(f"WITH {SELECTIONS} SELECT panelist_id, t, 'selection' AS event_type, 'self_selection' AS policy, array_to_string(choice_set, ',') AS choice_set, array_to_string(requested, ',') AS requested, array_to_string(executed, ',') AS executed, array_to_string(dropped, ',') AS dropped FROM sel")
def selection_event_rows(spark, sf):
    rows = A.selections(spark, sf).select("panelist_id", "t", "choice_set", "selected_product_ids")
    ev = N.selection_events(rows, N.Policy("self_selection", cap=2))
    lists = {n: P.strings(F.col("traces"), n) for n in ("executed", "dropped")}
    return ev.select("panelist_id", "t", "event_type", "policy", F.array_join("choice_set", ",").alias("choice_set"), F.array_join("selected_product_ids", ",").alias("requested"), *[F.array_join(v, ",").alias(n) for n, v in lists.items()])


# replies and texts


@query("SELECT count(*) AS n, count(*) AS n_valid FROM part")
def llm_mock_valid(spark, sf):
    rows = llm_mock_outcomes(spark, sf)
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("rating").between(1, 5) & F.col("intent").isin("no", "maybe", "yes") & (F.col("n_problems") == 0)).alias("n_valid"))


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN CAST(1 + p_partkey % 5 AS DOUBLE) END AS rating, CASE p_partkey % 4 WHEN 1 THEN 'parse_error' WHEN 2 THEN 'rating: out of range' WHEN 3 THEN 'intent: required' WHEN 0 THEN '[warn] extra key x' END AS problem FROM part")
def reply_payloads(spark, sf):
    k = F.col("p_partkey")
    good = F.concat(F.lit('Sure: {"rating": '), (1 + k % 5).cast("string"), F.lit(', "intent": "no", "x": 1} - done'))
    reply = F.when(k % 4 == 0, good).when(k % 4 == 1, "I cannot say").when(k % 4 == 2, '{"rating": 9, "intent": "no"}').otherwise('{"rating": 2}')
    done = G.read_reply(A.table(spark, sf, "part").select(k.alias("id"), reply.alias("reply")), [RATING, INTENT])
    return done.select("id", P.number(F.col("outcomes"), "rating").alias("rating"), F.array_join("problem", ";").alias("problem"))


@query(f"WITH {SELECTIONS} SELECT event_id, array_to_string(requested, ',') AS requested, array_to_string(executed, ',') AS executed, array_to_string(dropped, ',') AS dropped FROM sel")
def reply_selections(spark, sf):
    rows = A.selections(spark, sf).select("event_id", "choice_set", F.concat(F.lit("I take "), F.to_json(F.struct("selected_product_ids")), F.lit(".")).alias("reply"))
    return G.read_selection(rows, cap=2, fallback_first=False).select("event_id", *[F.array_join(c, ",").alias(c) for c in ("requested", "executed", "dropped")])


@query(f"WITH {SELECTIONS} SELECT event_id, array_to_string(list_distinct_in_order, ',') AS picks FROM (SELECT event_id, list_filter([choice_set[1], choice_set[3], CASE WHEN list_contains(choice_set, '7') AND choice_set[1] <> '7' AND coalesce(choice_set[3], '') <> '7' THEN '7' END], lambda x: x IS NOT NULL) AS list_distinct_in_order FROM sel)")
def few_shot_choices(spark, sf):
    tokens = ["__FIRST_SHOWN__", "__THIRD_SHOWN_IF_AVAILABLE__", "7"]
    return A.selections(spark, sf).select("event_id", F.array_join(G.example_choices(tokens, F.col("choice_set")), ",").alias("picks"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS persona_id, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'about {\"segment\":\"' || c_mktsegment || '\"}' END AS text FROM customer")
def enriched_texts(spark, sf):
    k = F.col("c_custkey")
    rows = A.table(spark, sf, "customer").select(k.cast("string").alias("persona_id"), F.when(k % 3 == 0, F.col("c_name")).when(k % 3 == 1, " ").alias("text"), F.to_variant_object(F.struct(F.col("c_mktsegment").alias("segment"))).alias("attributes"))
    return G.enrich_text(rows, "persona_id", "about {attributes}", {"name": "mock", "reply": lambda prompt, u: f" {prompt} "}).select("persona_id", "text")


def some_records(prompt: str, u: int) -> str:
    n, batch = map(int, re.findall(r"\d+", prompt))
    return "Here: " + json.dumps({"records": [{"batch": batch, "place": i} for i in range(n)]})


@query("SELECT 'p' || lpad(CAST(i AS VARCHAR), 4, '0') AS record_id, CAST((i - 1) // 10 AS DOUBLE) AS batch, CAST((i - 1) % 10 AS DOUBLE) AS place FROM range(1, 26) r(i)")
def made_records(spark, sf):
    rows = G.make_records(spark, 25, "p", "{n} records of batch {batch}", {"name": "mock", "reply": some_records})
    return rows.select("record_id", *[P.number(F.col("attributes"), n).alias(n) for n in ("batch", "place")])


# regressions in closed form


def frame(spark, sf):
    return A.table(spark, sf, "lineitem").join(A.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("l_returnflag") == "R").cast("double").alias("y"), F.least(F.floor(F.col("l_quantity") / 17), F.lit(2)).cast("double").alias("c"), (F.col("l_discount") > 0.05).cast("double").alias("x"),
        (F.col("l_extendedprice") / 1000).alias("price"), F.col("l_quantity").alias("panelist.quantity"), F.when(F.col("l_tax") > 0.04, "high").otherwise("low").alias("product.tax"),
        (F.col("o_custkey") % 4).cast("string").alias("panelist_id"), (F.col("l_suppkey") % 5).cast("string").alias("product_id"),
    )


CELLS = "WITH l AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, least(floor(l_quantity / 17), 2) AS c, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS x FROM lineitem), n AS (SELECT CAST(count(*) FILTER (x = 0 AND y = 0) AS DOUBLE) AS a, CAST(count(*) FILTER (x = 0 AND y = 1) AS DOUBLE) AS b, CAST(count(*) FILTER (x = 1 AND y = 0) AS DOUBLE) AS c, CAST(count(*) FILTER (x = 1 AND y = 1) AS DOUBLE) AS d FROM l)"


@query(f"{CELLS} SELECT 'const' AS term, round(ln(b / a), 6) + 0.0 AS estimate, round(sqrt(1 / a + 1 / b), 6) + 0.0 AS std_error FROM n UNION ALL SELECT 'x', round(ln(d / c) - ln(b / a), 6) + 0.0, round(sqrt(1 / a + 1 / b + 1 / c + 1 / d), 6) + 0.0 FROM n")
def logit_saturated(spark, sf):
    return coefficients(R.fit(R.Design(frame(spark, sf), "y", ("x",)), "logit"), spark).select("term", "estimate", "std_error")


@query(f"{CELLS} SELECT '0/1' AS term, round(-ln(b / a), 6) + 0.0 AS estimate, round(sqrt(1 / a + 1 / b), 6) + 0.0 AS std_error FROM n UNION ALL SELECT 'x', round(ln(d / c) - ln(b / a), 6) + 0.0, round(sqrt(1 / a + 1 / b + 1 / c + 1 / d), 6) + 0.0 FROM n")
def ordered_logit_two_classes(spark, sf):
    return coefficients(R.fit(R.Design(frame(spark, sf), "y", ("x",)), "ordered_logit", classes=2), spark).select("term", "estimate", "std_error")


def shares(spark, at_0: float, at_1: float):
    return spark.createDataFrame([(0, float(R.normal_cdf(at_0))), (1, float(R.normal_cdf(at_1)))], "x int, share double").select("x", r6("share").alias("share"))


SHARES = f"{CELLS} SELECT x, round(avg(y), 6) + 0.0 AS share FROM l GROUP BY 1"


@query(SHARES)
def probit_saturated(spark, sf):
    """A probit with one flag fits the share of each of its two groups."""
    b = R.fit(R.Design(frame(spark, sf), "y", ("x",)), "probit").estimate
    return shares(spark, b[0], b[0] + b[1])


@query(SHARES)
def ordered_probit_two_classes(spark, sf):
    b = R.fit(R.Design(frame(spark, sf), "y", ("x",)), "ordered_probit", classes=2).estimate
    return shares(spark, -b[1], b[0] - b[1])


@query(f"{CELLS}, m AS (SELECT x, c, CAST(count(*) AS DOUBLE) AS n FROM l GROUP BY 1, 2), q AS (SELECT m.x, m.c, m.n, b.n AS n0 FROM m JOIN m b ON b.x = m.x AND b.c = 0 WHERE m.c > 0) SELECT CAST(CAST(u.c AS BIGINT) AS VARCHAR) || ':const' AS term, round(ln(u.n / u.n0), 6) + 0.0 AS estimate, round(sqrt(1 / u.n + 1 / u.n0), 6) + 0.0 AS std_error FROM q u WHERE u.x = 0 UNION ALL SELECT CAST(CAST(u.c AS BIGINT) AS VARCHAR) || ':x', round(ln(v.n / v.n0) - ln(u.n / u.n0), 6) + 0.0, round(sqrt(1 / u.n + 1 / u.n0 + 1 / v.n + 1 / v.n0), 6) + 0.0 FROM q u JOIN q v ON v.c = u.c AND v.x = 1 WHERE u.x = 0")
def mnlogit_saturated(spark, sf):
    return coefficients(R.fit(R.Design(frame(spark, sf), "c", ("x",)), "multinomial_logit", classes=3), spark).select("term", "estimate", "std_error")


SLOPE = "WITH l AS (SELECT l_extendedprice / 1000 AS y, l_quantity AS x, o_custkey AS p, l_partkey AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey), m AS (SELECT count(*) AS n, avg(x) AS mx, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx FROM l), s AS (SELECT p, q, (x - mx) * (y - a - b * x) AS s FROM l, m)"
MEAT = "(SELECT sum(s * s) * count(*) / (count(*) - 1) FROM (SELECT sum(s) AS s FROM s GROUP BY {}))"


@query(f"{SLOPE} SELECT 'x1' AS term, round(b, 6) + 0.0 AS estimate, round(sqrt({MEAT.format('p')} * (n - 1) / (n - 2)) / sxx, 6) + 0.0 AS std_error FROM m")
def ols_cluster_slope(spark, sf):
    return coefficients(R.fit(design(spark, sf, "y", "x1"), covariance="cluster_panelist"), spark).where("term = 'x1'").select("term", "estimate", "std_error")


@query(f"{SLOPE} SELECT 'x1' AS term, round(b, 6) + 0.0 AS estimate, round(sqrt(({MEAT.format('p')} + {MEAT.format('q')} - {MEAT.format('p, q')}) * (n - 1) / (n - 2)) / sxx, 6) + 0.0 AS std_error FROM m")
def ols_two_way_slope(spark, sf):
    return coefficients(R.fit(design(spark, sf, "y", "x1"), covariance="cluster_two_way"), spark).where("term = 'x1'").select("term", "estimate", "std_error")


TWO = """WITH l AS (SELECT l_extendedprice / 1000 AS y, l_quantity AS x1, l_discount AS x2 FROM lineitem), m AS (SELECT avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, stddev_samp(x1) AS d1, stddev_samp(x2) AS d2, covar_pop(y, x1) AS s1y, covar_pop(y, x2) AS s2y, var_pop(x1) AS s11, var_pop(x2) AS s22, covar_pop(x1, x2) AS s12 FROM l),
 b AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM m)"""


@query(f"{TWO} SELECT 'const' AS term, round(my, 6) + 0.0 AS estimate FROM b UNION ALL SELECT 'x1', round(b1 * d1, 6) + 0.0 FROM b UNION ALL SELECT 'x2', round(b2 * d2, 6) + 0.0 FROM b")
def ols_standardized(spark, sf):
    return coefficients(R.fit(design(spark, sf, "y", "x1", "x2"), standardize=True), spark).select("term", "estimate")


@query(f"{TWO} SELECT 'const' AS term, 'kept' AS what, round(my - b1 * m1 - b2 * m2, 6) + 0.0 AS estimate FROM b UNION ALL SELECT 'x1', 'kept', round(b1, 6) + 0.0 FROM b UNION ALL SELECT 'x2', 'kept', round(b2, 6) + 0.0 FROM b UNION ALL SELECT 'seven', 'constant', NULL UNION ALL SELECT 'again', 'duplicate', NULL UNION ALL SELECT 'both', 'rank_deficient', NULL")
def ols_dropped_columns(spark, sf):
    d = design(spark, sf, "y", "x1", "seven", "again", "x2", "both")
    rows = d.rows.withColumn("seven", F.lit(7.0)).withColumn("again", F.col("x1")).withColumn("both", F.col("x1") + 2 * F.col("x2"))
    out = R.fit(R.Design(rows, d.target, d.columns, d.panelist, d.product))
    kept = coefficients(out, spark).select("term", F.lit("kept").alias("what"), "estimate")
    return kept.union(spark.createDataFrame([(*x, None) for x in out.dropped], "term string, what string, estimate double"))


@query(f"{TWO} SELECT term, round(e, 6) + 0.0 AS estimate, CAST(row_number() OVER (ORDER BY abs(e) DESC, term) AS INTEGER) AS rank FROM (SELECT 'x1' AS term, b1 AS e FROM b UNION ALL SELECT 'x2', b2 FROM b)")
def top_attribute_coefficients(spark, sf):
    table = R.fit(design(spark, sf, "y", "x1", "x2")).frame(spark)
    return Z.top_attributes(table, 10).select("term", r6("estimate").alias("estimate"), "rank")


def designed(spark, sf, name: str):
    return coefficients(R.fit(Z.build(frame(spark, sf), name, "price")), spark).select("term", "estimate")


EFFECTS = "WITH l AS (SELECT l_extendedprice / 1000 AS y, CAST({0} AS VARCHAR) AS g FROM lineitem JOIN orders ON l_orderkey = o_orderkey), m AS (SELECT g, avg(y) AS m FROM l GROUP BY 1) SELECT CASE WHEN g = '0' THEN 'const' ELSE '{1}_' || g END AS term, round(CASE WHEN g = '0' THEN m ELSE m - (SELECT m FROM m WHERE g = '0') END, 6) + 0.0 AS estimate FROM m"


@query(EFFECTS.format("o_custkey % 4", "panelist_id"))
def design_panelist_effects(spark, sf):
    return designed(spark, sf, "panelist_id_fe")


@query(EFFECTS.format("l_suppkey % 5", "product_id"))
def design_product_effects(spark, sf):
    return designed(spark, sf, "product_id_fe")


@query("SELECT 'const' AS term, round(regr_intercept(l_extendedprice / 1000, l_quantity), 6) + 0.0 AS estimate FROM lineitem UNION ALL SELECT 'panelist.quantity', round(regr_slope(l_extendedprice / 1000, l_quantity), 6) + 0.0 FROM lineitem")
def design_panelist_features(spark, sf):
    return designed(spark, sf, "panelist_features")


@query("WITH m AS (SELECT l_tax > 0.04 AS high, avg(l_extendedprice / 1000) AS m FROM lineitem GROUP BY 1) SELECT 'const' AS term, round(m, 6) + 0.0 AS estimate FROM m WHERE high UNION ALL SELECT 'product.tax_low', round(m - (SELECT m FROM m WHERE high), 6) + 0.0 FROM m WHERE NOT high")
def design_product_features(spark, sf):
    return designed(spark, sf, "product_features")


# fixed effects of any number of levels, by alternating group means

PANEL = "SELECT l_extendedprice / 1000 AS y, l_quantity AS x1, l_discount AS x2, o_custkey AS p, l_partkey AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def demeaned(rounds: int) -> str:
    """CTEs t0 .. t2n: y, x1, x2 less their means by p, then by q, and so on."""
    out = [f"t0 AS MATERIALIZED ({PANEL})"]
    for i in range(1, 2 * rounds + 1):
        less = ", ".join(f"{v} - avg({v}) OVER (PARTITION BY {'qp'[i % 2]}) AS {v}" for v in ("y", "x1", "x2"))
        out.append(f"t{i} AS MATERIALIZED (SELECT p, q, {less} FROM t{i - 1})")
    return ", ".join(out)


#: One component, or null: levels that the first customer's rows lead to are counted against all.
REACHED = """e AS MATERIALIZED (SELECT DISTINCT 'p' || p AS a, 'q' || q AS b FROM t0), reach AS (SELECT min(a) AS v FROM e UNION SELECT CASE WHEN e.a = r.v THEN e.b ELSE e.a END FROM reach r JOIN e ON e.a = r.v OR e.b = r.v),
 levels AS (SELECT count(DISTINCT a) + count(DISTINCT b) AS n, CASE WHEN (SELECT count(*) FROM reach) = count(DISTINCT a) + count(DISTINCT b) THEN 1 END AS parts FROM e)"""
TWO_WAY = f"""WITH RECURSIVE {demeaned(16)}, {REACHED}, m AS (SELECT count(*) AS n, sum(x1 * x1) AS s11, sum(x2 * x2) AS s22, sum(x1 * x2) AS s12, sum(x1 * y) AS s1y, sum(x2 * y) AS s2y, sum(y * y) AS syy FROM t32),
 b AS (SELECT *, s11 * s22 - s12 * s12 AS det, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM m),
 v AS (SELECT b.*, (syy - b1 * s1y - b2 * s2y) / (b.n - 2 - (l.n - parts)) AS s2 FROM b, levels l)"""


def absorbed(spark, sf, *effects: str, columns=("x1", "x2"), **options):
    d = design(spark, sf, "y", *columns)
    return B.fit(d.rows, d.target, d.columns, effects, panelist=d.panelist, product=d.product, **options)


@query(f"{TWO_WAY} SELECT 'x1' AS term, round(b1, 6) + 0.0 AS estimate, round(sqrt(s2 * s22 / det), 6) + 0.0 AS std_error FROM v UNION ALL SELECT 'x2', round(b2, 6) + 0.0, round(sqrt(s2 * s11 / det), 6) + 0.0 FROM v")
def ols_absorbed_two_way(spark, sf):
    """Customers and parts as fixed effects, thousands of levels; x1 and x2 against demeaning in SQL."""
    return coefficients(absorbed(spark, sf, "o_custkey", "l_partkey").result, spark).select("term", "estimate", "std_error")


ONE_WAY = f"WITH t0 AS ({PANEL}), l AS (SELECT p, y, x1, y - avg(y) OVER w AS v, x1 - avg(x1) OVER w AS u FROM t0 WINDOW w AS (PARTITION BY p)), m AS (SELECT count(*) AS n, count(DISTINCT p) AS g, sum(u * v) / sum(u * u) AS b, sum(u * u) AS suu FROM l)"


@query(f"{ONE_WAY}, s AS (SELECT p, sum(u * (v - b * u)) AS s FROM l, m GROUP BY p) SELECT 'x1' AS term, round(b, 6) + 0.0 AS estimate, round(sqrt((SELECT sum(s * s) FROM s) * g / (g - 1) * (n - 1) / (n - 1 - g)) / suu, 6) + 0.0 AS std_error FROM m")
def ols_absorbed_cluster(spark, sf):
    """Errors clustered by the absorbed effect."""
    out = absorbed(spark, sf, "o_custkey", columns=("x1",), covariance="cluster_panelist")
    return coefficients(out.result, spark).select("term", "estimate", "std_error")


@query(f"{ONE_WAY}, a AS (SELECT CAST(p AS VARCHAR) AS level, avg(y) - b * avg(x1) AS a FROM l, m GROUP BY p, b) SELECT 'o_custkey' AS effect, level, round(a - (SELECT arg_min(a, level) FROM a), 6) + 0.0 AS estimate FROM a")
def absorbed_level_estimates(spark, sf):
    """Every level's own estimate, as a table."""
    table = absorbed(spark, sf, "o_custkey", columns=("x1",)).effects
    return table.select("effect", "level", r6("estimate").alias("estimate"))


NEAR = "WITH l AS (SELECT l_extendedprice / 1000 AS y, l_quantity AS u, CAST(l_linenumber AS DOUBLE) AS w FROM lineitem), m AS (SELECT avg(y) AS my, avg(u) AS mu, avg(w) AS mw, covar_pop(y, u) AS suy, covar_pop(y, w) AS swy, var_pop(u) AS suu, var_pop(w) AS sww, covar_pop(u, w) AS suw FROM l), b AS (SELECT *, (suy * sww - swy * suw) / (suu * sww - suw * suw) AS bu, (swy * suu - suy * suw) / (suu * sww - suw * suw) AS bw FROM m)"


@query(f"{NEAR} SELECT round(my - bu * mu - bw * mw, 6) + 0.0 AS intercept, round(bu, 6) + 0.0 AS sum_of_slopes, round(bw, 6) + 0.0 AS slope_of_gap FROM b")
def ols_nearly_collinear(spark, sf):
    """Two columns that differ by a millionth part of a third: their slopes are millions, of opposite sign, and
    right to the digits that the third column's own regression shows. Sums of squares cannot tell the two apart."""
    gap = 2.0**-20
    rows = A.table(spark, sf, "lineitem").select((F.col("l_extendedprice") / 1000).alias("y"), F.col("l_quantity").alias("x1"), (F.col("l_quantity") + F.col("l_linenumber") * gap).alias("near"))
    b = dict(zip((out := R.fit(R.Design(rows, "y", ("x1", "near")))).terms, out.estimate.tolist(), strict=True))
    one = spark.range(1)
    return one.select(r6(F.lit(b["const"])).alias("intercept"), r6(F.lit(b["x1"] + b["near"])).alias("sum_of_slopes"), r6(F.lit(b["near"] * gap)).alias("slope_of_gap"))


SHARES_OF_3 = "WITH l AS (SELECT least(floor(l_quantity / 17), 2) AS c FROM lineitem), f AS (SELECT j, CAST(count(*) AS DOUBLE) AS n, avg(CASE WHEN c <= j THEN 1.0 ELSE 0.0 END) AS f FROM l, range(2) r(j) GROUP BY j)"


def thresholds(spark, sf, family: str):
    rows = frame(spark, sf).withColumn("one", F.lit(1.0))
    return R.fit(R.Design(rows, "c", ("one",)), family, classes=3).frame(spark).select("term", "estimate", "std_error")


@query(f"{SHARES_OF_3} SELECT j || '/' || (j + 1) AS term, round(ln(f / (1 - f)), 6) + 0.0 AS estimate, round(sqrt(1 / (n * f * (1 - f))), 6) + 0.0 AS std_error FROM f")
def ordered_logit_thresholds(spark, sf):
    """Three classes and no other column: the cut points are the log odds of the shares below them."""
    return thresholds(spark, sf, "ordered_logit").select("term", r6("estimate").alias("estimate"), r6("std_error").alias("std_error"))


@query(f"{SHARES_OF_3} SELECT j || '/' || (j + 1) AS term, round(f, 6) + 0.0 AS share, round(sqrt(f * (1 - f) / n), 6) + 0.0 AS error_of_share FROM f")
def ordered_probit_thresholds(spark, sf):
    """The cut points as shares, and their errors by way of the normal density there."""
    rows = [(r.term, float(R.normal_cdf(r.estimate)), float(R.normal_pdf(r.estimate)) * r.std_error) for r in thresholds(spark, sf, "ordered_probit").collect()]  # a row a cut point
    return spark.createDataFrame(rows, "term string, share double, error double").select("term", r6("share").alias("share"), r6("error").alias("error_of_share"))


# features that no one declared; results on disk

FOUND = "WITH l AS (SELECT l_extendedprice / 1000 AS y, c_acctbal AS x1, CAST(p_size AS DOUBLE) AS x2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey)"


def feature_rows(spark, sf):
    """Line items with panelist_features and product_features as open payloads."""
    rows = A.table(spark, sf, "lineitem").join(A.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(A.table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(A.table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    person = F.to_variant_object(F.struct(F.struct(F.col("c_acctbal").alias("balance")).alias("account"), F.array("c_mktsegment").alias("segments")))
    thing = F.to_variant_object(F.struct(F.col("p_size").alias("size"), F.lit(None).cast("string").alias("nothing")))
    return rows.select((F.col("l_extendedprice") / 1000).alias("price"), F.col("o_custkey").cast("string").alias("panelist_id"), F.col("l_partkey").cast("string").alias("product_id"), person.alias("panelist_features"), thing.alias("product_features"))


@query(f"""{FOUND}, m AS (SELECT avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, covar_pop(y, x1) AS s1y, covar_pop(y, x2) AS s2y, var_pop(x1) AS s11, var_pop(x2) AS s22, covar_pop(x1, x2) AS s12 FROM l),
 b AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM m)
 SELECT 'const' AS term, round(my - b1 * m1 - b2 * m2, 6) + 0.0 AS estimate FROM b UNION ALL SELECT 'panelist.account.balance', round(b1, 6) + 0.0 FROM b UNION ALL SELECT 'product.size', round(b2, 6) + 0.0 FROM b""")
def design_from_found_features(spark, sf):
    """A design from whatever scalar features the payloads hold."""
    rows = X.as_columns(feature_rows(spark, sf), {"panelist": "panelist_features", "product": "product_features"}).drop("panelist_features", "product_features")
    return coefficients(R.fit(Z.build(rows, "panelist_plus_product_features", "price")), spark).select("term", "estimate")


@query(f"{TWO} SELECT 'coefficients_full' AS name, term, round(e, 6) + 0.0 AS estimate FROM (SELECT 'const' AS term, my - b1 * m1 - b2 * m2 AS e FROM b UNION ALL SELECT 'x1', b1 FROM b UNION ALL SELECT 'x2', b2 FROM b) UNION ALL SELECT 'coefficients_attributes', term, round(e, 6) + 0.0 FROM (SELECT 'x1' AS term, b1 AS e FROM b UNION ALL SELECT 'x2', b2 FROM b) UNION ALL SELECT 'coefficients_top_attributes', CASE WHEN abs(b1) >= abs(b2) THEN 'x1' ELSE 'x2' END, round(CASE WHEN abs(b1) >= abs(b2) THEN b1 ELSE b2 END, 6) + 0.0 FROM b UNION ALL SELECT 'dropped_columns', 'again', NULL UNION ALL SELECT 'summary', 'ols', CAST((SELECT count(*) FROM lineitem) AS DOUBLE)")
def fit_tables_round_trip(spark, sf):
    """A regression's tables on disk, read again from CSV."""
    d, folder = design(spark, sf, "y", "x1", "again", "x2"), scratch(spark)
    out = R.fit(R.Design(d.rows.withColumn("again", F.col("x1")), "y", d.columns))
    W.write_tables(W.fit_tables(spark, out, "two", "y", top=1), folder)
    read = lambda name, term, value: spark.read.csv(f"{folder}/{name}.csv", header=True).select(F.lit(name).alias("name"), F.col(term).alias("term"), r6(F.expr(value).cast("double")).alias("estimate"))
    parts = [read(f"coefficients_{k}", "term", "estimate") for k in ("full", "attributes", "top_attributes")] + [read("dropped_columns", "term", "NULL"), read("summary", "family", "n")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4])


# dispatch by declared types, decisions with their products, coded targets


@query(f"""WITH {EVENTS}, i AS (SELECT intent, count(*) AS n FROM ev WHERE intent IS NOT NULL GROUP BY 1) SELECT 'rating' AS field, 'numeric' AS kind, count(rating) AS n_observed, count(*) - count(rating) AS n_missing, round(avg(rating), 6) + 0.0 AS mean, round(var_pop(rating), 6) + 0.0 AS variance, CAST(NULL AS BIGINT) AS values, CAST(NULL AS DOUBLE) AS entropy FROM ev
 UNION ALL SELECT 'intent', 'categorical', count(intent), count(*) - count(intent), NULL, NULL, (SELECT count(*) FROM i), (SELECT round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) + 0.0 FROM i) FROM ev""")
def declared_summaries(spark, sf):
    out = M.value_summaries(fields(spark, sf), {"rating": "int", "intent": "categorical", "absent": "json"})
    return rounded(out).select("field", "kind", "n_observed", "n_missing", "mean", "variance", "values", "entropy")


@query(f"WITH {DEALT}, n AS (SELECT max(m) AS m FROM goods) SELECT panelist_id, t.t, s.slot, s_name AS product_display FROM people, range(2) t(t), range(2) s(slot), n JOIN goods ON j = (i * 2 + s.slot + {bits('7', chr(39) + 'shift' + chr(39), 't.t')} % n.m) % n.m JOIN supplier ON CAST(s_suppkey AS VARCHAR) = product_id")
def decisions_with_products(spark, sf):
    goods = A.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("product_id"), F.col("s_name").alias("product_display"))
    rows = N.shown(N.decide(N.Policy("random", periods=2, per_period=2, seed=7), panelists(spark, sf), goods), goods)
    return rows.select("panelist_id", "t", "slot", "product_display")


@query(f"WITH {EVENTS} SELECT CAST(CASE intent WHEN 'no' THEN 0 WHEN 'maybe' THEN 1 WHEN 'yes' THEN 2 END AS DOUBLE) AS code, count(*) AS n FROM ev GROUP BY 1")
def coded_targets(spark, sf):
    """An ordinal outcome as its places in the declared order."""
    field = Field("intent", "categorical", True, ("no", "maybe", "yes"), analysis="ordinal", choice_order=("no", "maybe", "yes"))
    _, order = Z.resolve([field], "intent", "ordered_logit")
    rows = A.evaluations(spark, sf).select(P.string(F.col("outcomes"), "intent").alias("intent"))
    return Z.target(rows, field, order).groupBy(F.col("intent").alias("code")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS product_id FROM lineitem WHERE l_partkey % 10 = 0")
def unscheduled_products(spark, sf):
    """Products of a schedule that the catalog does not have."""
    plan = A.table(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("product_id"))
    return N.unscheduled_products(plan, A.metadata(spark, sf).select(F.col("parent_asin").alias("product_id")))
