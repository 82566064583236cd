"""Queries over the standard tables: one or more a temporal operator, each with DuckDB SQL for the same rows.

The table `events` is a timed trace: event_id + 1 is the position, each event_type a
predicate with no argument, with (user) and with (user, value). Unless a query says
otherwise its rows are the violating positions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.plans.monitor import Monitor
from tracewright.plans.parametric import constraints, region
from tracewright.sources.trace import Trace

KINDS = ("click", "error", "purchase", "signup", "view")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str):
    """Whole seconds since 1970 of a timestamp without a zone, whatever the session's zone is."""
    return F.datediff(F.col(ts).cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def events_trace(spark: SparkSession, sf_dir: str) -> Trace:
    events = _read(spark, sf_dir, "events").select("*", (F.col("event_id") + 1).alias("pos")).withColumn("ts", seconds("ts"))
    tables: dict[tuple[str, int], DataFrame] = {}
    for kind in KINDS:
        mine = events.where(F.col("event_type") == kind)
        tables[kind, 0] = mine.select("pos", "ts")
        tables[kind, 1] = mine.select("pos", "ts", F.col("user_id").alias("a0"))
        tables[kind, 2] = mine.select("pos", "ts", F.col("user_id").alias("a0"), F.col("value").alias("a1"))
    k = F.get_json_object("props", "$.k").cast("long")
    tables["req", 2] = events.where("event_type = 'signup'").select("pos", "ts", F.col("user_id").alias("a0"), (k * 600).alias("a1"))
    return Trace(events.select("pos", "ts"), tables=tables)


def pages_trace(spark: SparkSession, sf_dir: str) -> Trace:
    pages = _read(spark, sf_dir, "pages").withColumn("pos", F.col("page_id") + 1)
    return Trace(pages.select("pos", F.lit(None).cast("long").alias("ts")), tables={("page", 1): pages.select("pos", F.col("url").alias("a0"))})


def orders_trace(spark: SparkSession, sf_dir: str) -> Trace:
    """Orders by customer, and line items by part, at the order's place."""
    orders = _read(spark, sf_dir, "orders").withColumn("pos", F.col("o_orderkey") + 1)
    items = _read(spark, sf_dir, "lineitem").withColumn("pos", F.col("l_orderkey") + 1)
    tables = {(name, 1): orders.where(F.col("o_orderstatus") == flag).select("pos", F.col("o_custkey").alias("a0")) for name, flag in (("open", "O"), ("done", "F"), ("part", "P"))}
    tables |= {(name, 1): items.where(F.col("l_returnflag") == flag).select("pos", F.col("l_partkey").alias("a0")) for name, flag in (("returned", "R"), ("new", "N"))}
    return Trace(orders.select("pos", F.lit(None).cast("long").alias("ts")), tables=tables)


DECLARED = "".join(f"pred {k}(u: Int, v: Real)\n" for k in KINDS) + "pred req(u: Int, d: Int)\n"
TRACES: dict[str, tuple[str, Callable[[SparkSession, str], Trace]]] = {"events": (DECLARED, events_trace), "pages": ("", pages_trace), "orders": ("", orders_trace)}


def violations_of(spec: str, on: str = "events") -> Callable[[SparkSession, str], DataFrame]:
    head, trace = TRACES[on]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Monitor(head + spec).violations("p", trace(spark, sf_dir))

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Positions 1.. with second t, user u, kind k and value v.
E = "WITH e AS (SELECT event_id + 1 AS pos, CAST(floor(epoch(ts)) AS BIGINT) AS t, user_id AS u, event_type AS k, value AS v, props FROM events) "


def add(name: str, spec: str, sql: str | None, on: str = "events") -> None:
    QUERIES[name] = violations_of(spec, on)
    if sql:
        SQL[name] = (E if on == "events" else "") + sql


def fails(kind: str, holds: str) -> str:
    """Positions q of a kind where the condition is not true."""
    return f"SELECT q.pos FROM e q WHERE q.k = '{kind}' AND NOT coalesce({holds}, false)"


def some(kind: str, when: str, alias: str = "w", more: str = "", same: bool = True) -> str:
    user = f"{alias}.u = q.u AND " if same else ""
    return f"EXISTS (SELECT 1 FROM e {alias} WHERE {user}{alias}.k = '{kind}' AND {when}{more})"


def no_error(after: str, until: str, alias: str = "w") -> str:
    return f" AND NOT EXISTS (SELECT 1 FROM e r WHERE r.u = {alias}.u AND r.k = 'error' AND r.pos {after} AND r.pos {until})"


PAST, AHEAD = "w.pos <= q.pos", "w.pos >= q.pos"
RUN = no_error("> w.pos", "<= q.pos")


def ago(low: int, high: int | None = None) -> str:
    return f"{PAST} AND q.t - w.t >= {low}" + ("" if high is None else f" AND q.t - w.t <= {high}")


def ahead(low: int, high: int | None = None) -> str:
    return f"{AHEAD} AND w.t - q.t >= {low}" + ("" if high is None else f" AND w.t - q.t <= {high}")


# atoms, relations, arithmetic
add("q_pred_scan", "prop p : !(Exists u . Exists v . purchase(u,v))", "SELECT pos FROM e WHERE k = 'purchase'")
add("q_const_arg", "prop p : !(Exists v . purchase(7,v))", "SELECT pos FROM e WHERE k = 'purchase' AND u = 7")
add("q_truth", "prop p : (purchase | true) & !(false & view) & !error", "SELECT pos FROM e WHERE k = 'error'")
for _name, _op in (("q_less", "<"), ("q_less_equal", "<="), ("q_greater", ">"), ("q_greater_equal", ">=")):
    add(_name, f"prop p : Forall u . Forall v . purchase(u,v) -> v {_op} 30", f"SELECT pos FROM e WHERE k = 'purchase' AND NOT v {_op} 30")
add("q_equal", "prop p : Forall u . Forall v . purchase(u,v) -> !(u = 7)", "SELECT pos FROM e WHERE k = 'purchase' AND u = 7")
add("q_arith", "prop p : Forall u . Forall v . purchase(u,v) -> v * 2 - 1 + u >= 50", "SELECT pos FROM e WHERE k = 'purchase' AND NOT v * 2 - 1 + u >= 50")
add("q_minus", "prop p : Forall u . Forall v . purchase(u,v) -> -u < -20", "SELECT pos FROM e WHERE k = 'purchase' AND NOT -u < -20")

# connectives and quantifiers
add("q_and", "prop p : Forall u . purchase(u) -> (P signup(u)) & (P view(u))", fails("purchase", f"{some('signup', PAST)} AND {some('view', PAST)}"))
add("q_or", "prop p : Forall u . purchase(u) -> (P signup(u)) | (P view(u))", fails("purchase", f"{some('signup', PAST)} OR {some('view', PAST)}"))
add("q_not", "prop p : Forall u . purchase(u) -> !(P error(u))", fails("purchase", f"NOT {some('error', PAST)}"))
add("q_implies", "prop p : Forall u . purchase(u) -> (P error(u)) -> P view(u)", fails("purchase", f"NOT {some('error', PAST)} OR {some('view', PAST)}"))
add("q_iff", "prop p : Forall u . purchase(u) -> ((P error(u)) <-> (P view(u)))", fails("purchase", f"{some('error', PAST)} = {some('view', PAST)}"))
add("q_exists", "prop p : Forall u . purchase(u) -> Exists v . P view(u,v) & v > 90", fails("purchase", some("view", PAST, more=" AND w.v > 90")))
add("q_exists_join", "prop p : Forall u . Forall v1 . Forall v2 . (@ P purchase(u,v1)) & purchase(u,v2) -> v1 < v2", fails("purchase", f"NOT {some('purchase', 'w.pos < q.pos', more=' AND w.v >= q.v')}"))

# untimed past
add("q_prev", "prop p : purchase -> @ view", "SELECT pos FROM (SELECT pos, k, lag(k) OVER (ORDER BY pos) AS b FROM e) WHERE k = 'purchase' AND NOT coalesce(b = 'view', false)")
add("q_once", "prop p : Forall u . purchase(u) -> P signup(u)", fails("purchase", some("signup", PAST)))
add("q_hist", "prop p : Forall u . purchase(u) -> H !error(u)", fails("purchase", f"NOT {some('error', PAST)}"))
add("q_since", "prop p : Forall u . purchase(u) -> (!error(u)) S view(u)", fails("purchase", some("view", PAST, more=RUN)))
add("q_interval", "prop p : Forall u . purchase(u) -> [signup(u),error(u))", fails("purchase", some("signup", PAST, more=RUN)))
add("q_zince", "prop p : Forall u . view(u) -> (!error(u)) Z view(u)", fails("view", some("view", "w.pos < q.pos", more=RUN)))

# timed past
add("q_once_le", "prop p : Forall u . purchase(u) -> P[<=3600] signup(u)", fails("purchase", some("signup", ago(0, 3600))))
add("q_once_lt", "prop p : Forall u . purchase(u) -> P[<86400] signup(u)", fails("purchase", some("signup", ago(0, 86399))))
add("q_once_ge", "prop p : Forall u . purchase(u) -> P[>=3600] signup(u)", fails("purchase", some("signup", ago(3600))))
add("q_once_gt", "prop p : Forall u . purchase(u) -> P[>86400] signup(u)", fails("purchase", some("signup", ago(86401))))
add("q_once_range", "prop p : Forall u . purchase(u) -> P[3600,86400] signup(u)", fails("purchase", some("signup", ago(3600, 86400))))
add("q_hist_t", "prop p : Forall u . purchase(u) -> H[<=86400] !error(u)", fails("purchase", f"NOT {some('error', ago(0, 86400))}"))
add("q_since_t", "prop p : Forall u . purchase(u) -> (!error(u)) S[<=86400] view(u)", fails("purchase", some("view", ago(0, 86400), more=RUN)))
add("q_zince_t", "prop p : Forall u . view(u) -> (!error(u)) Z[60,86400] view(u)", fails("view", some("view", "w.pos < q.pos AND " + ago(60, 86400), more=RUN)))

add("q_hist_range", "prop p : Forall u . purchase(u) -> H[3600,86400] !error(u)", fails("purchase", f"NOT {some('error', ago(3600, 86400))}"))
add("q_since_range", "prop p : Forall u . purchase(u) -> (!error(u)) S[3600,86400] view(u)", fails("purchase", some("view", ago(3600, 86400), more=RUN)))

# future
add("q_next", "prop p : purchase -> X view", "SELECT pos FROM (SELECT pos, k, lead(k) OVER (ORDER BY pos) AS b FROM e) WHERE k = 'purchase' AND NOT coalesce(b = 'view', false)")
add("q_ev", "prop p : Forall u . signup(u) -> F purchase(u)", fails("signup", some("purchase", AHEAD)))
add("q_ev_t", "prop p : Forall u . signup(u) -> F[3600,86400] purchase(u)", fails("signup", some("purchase", ahead(3600, 86400))))
add("q_alw", "prop p : Forall u . signup(u) -> G !error(u)", fails("signup", f"NOT {some('error', AHEAD)}"))
add("q_alw_t", "prop p : Forall u . signup(u) -> G[<=3600] !error(u)", fails("signup", f"NOT {some('error', ahead(0, 3600))}"))
add("q_until", "prop p : Forall u . signup(u) -> (!error(u)) U purchase(u)", fails("signup", some("purchase", AHEAD, more=no_error(">= q.pos", "< w.pos"))))
add("q_until_t", "prop p : Forall u . signup(u) -> (!error(u)) U[<=86400] purchase(u)", fails("signup", some("purchase", ahead(0, 86400), more=no_error(">= q.pos", "< w.pos"))))
add("q_alw_range", "prop p : Forall u . signup(u) -> G[3600,86400] !error(u)", fails("signup", f"NOT {some('error', ahead(3600, 86400))}"))
add("q_until_range", "prop p : Forall u . signup(u) -> (!error(u)) U[600,86400] purchase(u)", fails("signup", some("purchase", ahead(600, 86400), more=no_error(">= q.pos", "< w.pos"))))
add("q_nested_ff", "prop p : Forall u . signup(u) -> F[<=86400] (view(u) & F[<=86400] purchase(u))", fails("signup", some("view", ahead(0, 86400), more=" AND EXISTS (SELECT 1 FROM e x WHERE x.u = w.u AND x.k = 'purchase' AND x.pos >= w.pos AND x.t - w.t <= 86400)")))
add("q_nested_pf", "prop p : Forall u . purchase(u) -> P (signup(u) & F[<=86400] error(u))", fails("purchase", some("signup", PAST, more=" AND EXISTS (SELECT 1 FROM e x WHERE x.u = w.u AND x.k = 'error' AND x.pos >= w.pos AND x.t - w.t <= 86400)")))
add("q_anchored", "prop p anchored : F[<=60] purchase", "SELECT q.pos FROM e q WHERE q.pos = 1 AND NOT EXISTS (SELECT 1 FROM e w WHERE w.k = 'purchase' AND w.t - q.t <= 60)")

# without variables
add("q_closed_since", "prop p : purchase -> (!error) S view", "SELECT pos FROM (SELECT pos, k, max(CASE k WHEN 'view' THEN pos END) OVER o AS a, max(CASE k WHEN 'error' THEN pos END) OVER o AS b FROM e WINDOW o AS (ORDER BY pos)) WHERE k = 'purchase' AND NOT coalesce(a > coalesce(b, 0), false)")
add("q_closed_iff", "prop p : (P[<=600] error) <-> (P[<=600] view)", "SELECT pos FROM (SELECT pos, t, max(CASE k WHEN 'view' THEN t END) OVER o AS a, max(CASE k WHEN 'error' THEN t END) OVER o AS b FROM e WINDOW o AS (ORDER BY pos)) WHERE coalesce(t - a <= 600, false) <> coalesce(t - b <= 600, false)")

# macros, bounds from data, strings, functions
add("q_macro", "pred active(x) = [signup(x),error(x))\nprop p : Forall u . purchase(u) -> active(u)", fails("purchase", some("signup", PAST, more=RUN)))
add("q_databound", "prop p : Forall u . Forall d . req(u,d) -> F[0,d] purchase(u)", fails("signup", some("purchase", AHEAD + " AND w.t - q.t <= 600 * CAST(json_extract_string(q.props, '$.k') AS BIGINT)")))
_D = "600 * CAST(json_extract_string(q.props, '$.k') AS BIGINT)"
add("q_databound_past", "prop p : Forall u . Forall d . req(u,d) -> P[0,d] view(u)", fails("signup", some("view", f"{PAST} AND q.t - w.t <= {_D}")))
add("q_databound_low", "prop p : Forall u . Forall d . req(u,d) -> F[d,*] purchase(u)", fails("signup", some("purchase", f"{AHEAD} AND w.t - q.t >= {_D}")))
add("q_databound_not", "prop p : Forall u . Forall d . req(u,d) -> !F[d,86400] error(u)", fails("signup", f"NOT {some('error', f'{AHEAD} AND w.t - q.t >= {_D} AND w.t - q.t <= 86400')}"))
add("q_databound_until", "prop p : Forall u . Forall d . req(u,d) -> (!error(u)) U[0,d] purchase(u)", fails("signup", some("purchase", f"{AHEAD} AND w.t - q.t <= {_D}", more=no_error(">= q.pos", "< w.pos"))))
add("q_contains", 'prop p : Forall x . page(x) -> !(x contains "/en/")', "SELECT page_id + 1 AS pos FROM pages WHERE contains(url, '/en/')", "pages")
add("q_match_gap", 'prop p : Forall x . page(x) -> !(x matches "...#top")', "SELECT page_id + 1 AS pos FROM pages WHERE ends_with(url, '#top')", "pages")
add("q_match_hole", 'prop p : Forall x . Forall h . page(x) & x matches "http://{h:[a-z]+}.example..." -> h contains "th"', "SELECT page_id + 1 AS pos FROM pages WHERE regexp_matches(url, '^http://[a-z]+[.]example') AND NOT contains(regexp_extract(url, '^http://([a-z]+)[.]example', 1), 'th')", "pages")
add("q_match_regex", "prop p : Forall x . page(x) -> x matches /https?:..m.*/", "SELECT page_id + 1 AS pos FROM pages WHERE NOT regexp_full_match(url, 'https?:..m.*', 's')", "pages")
add("q_match_gaps", 'prop p : Forall x . page(x) -> !(x matches "http...example...en...")', "SELECT page_id + 1 AS pos FROM pages WHERE url LIKE 'http%example%en%'", "pages")
add("q_match_anonymous", 'prop p : Forall x . page(x) -> x matches "http{:s?}://..."', "SELECT page_id + 1 AS pos FROM pages WHERE NOT regexp_matches(url, '^https?://')", "pages")
add("q_match_twice", 'prop p : Forall x . Forall c . !(page(x) & x matches "http...//{c:[a-z][a-z]}{c}...")', "SELECT page_id + 1 AS pos FROM pages WHERE regexp_matches(url, '^https?://[a-z]{4}') AND substr(url, instr(url, '//') + 2, 2) = substr(url, instr(url, '//') + 4, 2)", "pages")
add("q_match_ways", 'prop p : Forall x . Forall a . Forall b . page(x) & x matches "{a}/{b}" -> b contains "e"', "SELECT page_id + 1 AS pos FROM pages WHERE contains(url, '/') AND NOT contains(regexp_extract(url, '([^/]*)$', 1), 'e')", "pages")
_PY = "python:\ndef size(x: str) -> int:\n    return len(x)\ndef deep(x: str) -> bool:\n    return x.count('/') > 4\nend\n"
add("q_udf_term", _PY + "prop p : Forall x . page(x) -> size(x) < 40", "SELECT page_id + 1 AS pos FROM pages WHERE NOT length(url) < 40", "pages")
add("q_udf_atom", _PY + "prop p : Forall x . page(x) -> !deep(x)", "SELECT page_id + 1 AS pos FROM pages WHERE length(url) - length(replace(url, '/', '')) > 4", "pages")

add("q_udf_binds", "python:\ndef half(n: int) -> int:\n    return n // 2\nend\n" + "prop p : Forall u . signup(u) -> F (Exists w . purchase(w) & w = half(u))", "SELECT q.pos FROM e q WHERE q.k = 'signup' AND NOT EXISTS (SELECT 1 FROM e w WHERE w.k = 'purchase' AND w.u = q.u // 2 AND w.pos >= q.pos)")

# orders and line items
_O = "WITH o AS (SELECT o_orderkey + 1 AS pos, o_custkey AS c, o_orderstatus AS s, max(CASE o_orderstatus WHEN 'O' THEN o_orderkey + 1 END) OVER w AS a, max(CASE o_orderstatus WHEN 'P' THEN o_orderkey + 1 END) OVER w AS b FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) "
add("q_orders_once", "prop p : Forall c . done(c) -> P open(c)", _O + "SELECT pos FROM o WHERE s = 'F' AND a IS NULL", "orders")
add("q_orders_since", "prop p : Forall c . done(c) -> (!part(c)) S open(c)", _O + "SELECT pos FROM o WHERE s = 'F' AND NOT coalesce(a > coalesce(b, 0), false)", "orders")
add("q_items_once", "prop p : Forall x . returned(x) -> P new(x)", "SELECT DISTINCT l_orderkey + 1 AS pos FROM lineitem LEFT JOIN (SELECT l_partkey AS k, min(l_orderkey) AS a FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) ON k = l_partkey WHERE l_returnflag = 'R' AND NOT coalesce(a <= l_orderkey, false)", "orders")


# verdicts, and bounds to be found
def q_trace_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every position with its verdict and the position at which it is known."""
    return Monitor(DECLARED + "prop p : Forall u . purchase(u) -> P signup(u)").verdicts("p", events_trace(spark, sf_dir))


def q_determined_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every position with its verdict and the position at which an online monitor knows it, or none before the end."""
    return Monitor(DECLARED + "prop p : Forall u . signup(u) -> F[<=86400] purchase(u)").verdicts("p", events_trace(spark, sf_dir))


def q_several(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdicts of two properties, one of them anchored."""
    spec = "prop bought : Forall u . purchase(u) -> P view(u)\nprop begun anchored : F[<=60] purchase"
    return Monitor(DECLARED + spec).run(events_trace(spark, sf_dir)).select("pos", "property", "holds")


def _parametric(formula: str, whole: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        monitor, trace = Monitor(DECLARED + f"prop p : {formula}"), events_trace(spark, sf_dir)
        return (region if whole else constraints)(monitor, "p", trace)

    return run


QUERIES["q_trace_table"] = q_trace_table
SQL["q_trace_table"] = E + f"SELECT q.pos, 'p' AS property, NOT (q.k = 'purchase' AND NOT {some('signup', PAST)}) AS holds, q.pos AS determined_at FROM e q"


QUERIES["q_determined_at"], QUERIES["q_several"] = q_determined_at, q_several
SQL["q_determined_at"] = E + (
    "SELECT q.pos, 'p' AS property, q.k <> 'signup' OR q.a IS NOT NULL AS holds, CASE WHEN q.k <> 'signup' THEN q.pos ELSE coalesce(q.a, (SELECT min(x.pos) FROM e x WHERE x.t > q.t + 86400)) END AS determined_at "
    f"FROM (SELECT q.pos, q.k, q.t, (SELECT min(w.pos) FROM e w WHERE w.u = q.u AND w.k = 'purchase' AND {ahead(0, 86400)}) AS a FROM e q) q"
)
SQL["q_several"] = E + f"SELECT q.pos, 'bought' AS property, NOT (q.k = 'purchase' AND NOT {some('view', PAST)}) AS holds FROM e q UNION ALL SELECT q.pos, 'begun' AS property, EXISTS (SELECT 1 FROM e w WHERE w.k = 'purchase' AND w.t - q.t <= 60) AS holds FROM e q WHERE q.pos = 1"


def _bound_sql(kind: str, best: str, delay: str, sign: str, witness: str, when: str) -> str:
    return f"SELECT q.pos, CASE WHEN q.k <> '{kind}' THEN 'true' WHEN q.d IS NULL THEN 'false' ELSE '{sign}' END AS kind, CASE WHEN q.k = '{kind}' THEN q.d END AS bound FROM (SELECT q.pos, q.k, (SELECT {best}({delay}) FROM e w WHERE w.u = q.u AND w.k = '{witness}' AND {when}) AS d FROM e q) q"


_PARAM = {
    "q_param_future_up": ("Forall u . signup(u) -> F[<=n] purchase(u)", _bound_sql("signup", "min", "w.t - q.t", "ge", "purchase", AHEAD)),
    "q_param_past_up": ("Forall u . purchase(u) -> P[<=n] signup(u)", _bound_sql("purchase", "min", "q.t - w.t", "ge", "signup", PAST)),
    "q_param_future_low": ("Forall u . signup(u) -> F[n,86400] purchase(u)", _bound_sql("signup", "max", "w.t - q.t", "le", "purchase", ahead(0, 86400))),
    "q_param_past_range": ("Forall u . purchase(u) -> P[3600,n] signup(u)", _bound_sql("purchase", "min", "q.t - w.t", "ge", "signup", ago(3600))),
    "q_param_since": ("Forall u . purchase(u) -> (!error(u)) S[<=n] view(u)", _bound_sql("purchase", "min", "q.t - w.t", "ge", "view", PAST + RUN)),
    "q_param_since_low": ("Forall u . purchase(u) -> (!error(u)) S[n,86400] view(u)", _bound_sql("purchase", "max", "q.t - w.t", "le", "view", ago(0, 86400) + RUN)),
    "q_param_until": ("Forall u . signup(u) -> (!error(u)) U[<=n] purchase(u)", _bound_sql("signup", "min", "w.t - q.t", "ge", "purchase", AHEAD + no_error(">= q.pos", "< w.pos"))),
    "q_param_past_low": ("Forall u . purchase(u) -> P[>=n] signup(u)", _bound_sql("purchase", "max", "q.t - w.t", "le", "signup", PAST)),
}
for _name, (_formula, _sql) in _PARAM.items():
    QUERIES[_name], SQL[_name] = _parametric(_formula), E + _sql
_FIRST = f"(SELECT q.pos, q.k, q.t, (SELECT min(w.t - q.t) FROM e w WHERE w.u = q.u AND w.k = 'error' AND {AHEAD}) AS d FROM e q) q"
QUERIES["q_param_always"] = _parametric("Forall u . signup(u) -> G[<=n] !error(u)")
SQL["q_param_always"] = E + f"SELECT q.pos, CASE WHEN q.k <> 'signup' OR q.d IS NULL THEN 'true' WHEN q.d = 0 THEN 'false' ELSE 'le' END AS kind, CASE WHEN q.k = 'signup' AND q.d > 0 THEN q.d - 1 END AS bound FROM {_FIRST}"
_INNER = "(SELECT w.u, w.pos, w.t, min(x.t - w.t) AS d FROM e w JOIN e x ON x.u = w.u AND x.k = 'purchase' AND x.pos >= w.pos WHERE w.k = 'view' GROUP BY w.u, w.pos, w.t)"
QUERIES["q_param_nested"] = _parametric("Forall u . signup(u) -> F[<=86400] (view(u) & F[<=n] purchase(u))")
SQL["q_param_nested"] = E + f"SELECT q.pos, CASE WHEN q.k <> 'signup' THEN 'true' WHEN q.d IS NULL THEN 'false' ELSE 'ge' END AS kind, CASE WHEN q.k = 'signup' THEN q.d END AS bound FROM (SELECT q.pos, q.k, (SELECT min(w.d) FROM {_INNER} w WHERE w.u = q.u AND {ahead(0, 86400)}) AS d FROM e q) q"
QUERIES["q_region"] = _parametric("Forall u . click(u) -> P[<=n] click(u)", whole=True)
SQL["q_region"] = E + "SELECT CASE WHEN max(d) IS NULL THEN 'true' ELSE 'ge' END AS kind, max(d) AS bound FROM (SELECT CAST(0 AS BIGINT) AS d FROM e WHERE k = 'click')"
