"""Ledger queries over the orders / lineitem / events / customer / conversations stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import ledger as L
from vigil.operators import queue as Q
from vigil.plans.registry import query
from vigil.sources.standins import (approvals_ledger, investigation_updates, investigations_ledger, job_attempts)
from vigil.sources.tables import read_table

INV_SQL = """inv AS (SELECT 'inv_' || CAST(o_orderkey AS VARCHAR) AS investigation_id,
  'evt_' || CAST(o_orderkey AS VARCHAR) AS event_id, o_orderkey, o_custkey, o_orderpriority AS model_name,
  CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'P' THEN 'waiting_for_approval' WHEN 'F' THEN 'resolved' END AS status,
  o_orderdate AS opened_at FROM orders)"""

APR_SQL = """apr AS (SELECT 'apr_' || CAST(o_orderkey AS VARCHAR) AS approval_id,
  'inv_' || CAST(o_orderkey AS VARCHAR) AS investigation_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'rollback_production' WHEN '2-HIGH' THEN 'retrain'
       ELSE 'promote_to_production' END AS requested_action,
  CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'rejected' WHEN 'F' THEN 'approved' END AS status,
  o_orderdate AS created_at, o_orderkey FROM orders)"""


@query("list_by_status", sql=f"WITH {INV_SQL} SELECT investigation_id, model_name FROM inv WHERE status = 'running'")
def list_by_status(spark, sf_dir):
    inv = investigations_ledger(spark, sf_dir)
    return inv.where(F.col("status") == "running").select("investigation_id", "model_name")


@query("open_items", sql=f"WITH {INV_SQL} SELECT investigation_id, status FROM inv WHERE status IN "
       "('open', 'running', 'waiting_for_job', 'waiting_for_approval') "
       "ORDER BY opened_at DESC, investigation_id DESC LIMIT 50")
def open_items(spark, sf_dir):
    inv = investigations_ledger(spark, sf_dir).where(F.col("status").isin(*L.OPEN_STATUSES))
    return L.recent_page(inv, "opened_at", "investigation_id", 0, 50).select("investigation_id", "status")


@query("recent_page", sql=f"WITH {INV_SQL} SELECT investigation_id, model_name FROM inv WHERE status = 'resolved' "
       "ORDER BY opened_at DESC, investigation_id DESC LIMIT 50 OFFSET 10")
def recent_page(spark, sf_dir):
    inv = investigations_ledger(spark, sf_dir)
    return L.recent_page(inv, "opened_at", "investigation_id", offset=10, limit=50, status_col="status",
                         status="resolved").select("investigation_id", "model_name")


@query("pending_fifo", sql=f"WITH {APR_SQL} SELECT approval_id, requested_action FROM apr WHERE status = 'pending' "
       "ORDER BY created_at, approval_id LIMIT 50")
def pending_fifo(spark, sf_dir):
    apr = approvals_ledger(spark, sf_dir)
    return L.recent_page(apr, "created_at", "approval_id", 0, 50, "status", "pending", ascending=True).select(
        "approval_id", "requested_action")


@query("status_counts", sql=f"WITH {INV_SQL} SELECT status, count(*) AS n FROM inv GROUP BY ROLLUP (status)")
def status_counts(spark, sf_dir):
    return L.status_counts(investigations_ledger(spark, sf_dir), "status", total=True)


@query("approval_kpis", sql=f"WITH {APR_SQL} SELECT requested_action, count(*) AS pending FROM apr "
       "WHERE status = 'pending' GROUP BY ALL")
def approval_kpis(spark, sf_dir):
    apr = approvals_ledger(spark, sf_dir).where(F.col("status") == "pending")
    return apr.groupBy("requested_action").agg(F.count(F.lit(1)).alias("pending"))


@query("lookup_by_key", sql=f"WITH {INV_SQL} SELECT investigation_id FROM inv WHERE o_custkey IN "
       "(SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def lookup_by_key(spark, sf_dir):
    keys = read_table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING").select(
        F.col("c_custkey").alias("o_custkey"))
    return L.lookup_by_key(investigations_ledger(spark, sf_dir), keys, "o_custkey").select("investigation_id")


# ---- registry and reference-stat upserts (null-safe composite keys) ----------------------------------------------
REG_SQL = """reg AS (SELECT p_brand AS model_name, CASE WHEN p_size % 10 = 0 THEN NULL ELSE CAST(p_size AS VARCHAR) END
  AS model_version, p_size, p_retailprice FROM part)"""


def _registry(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    return p.select(F.col("p_brand").alias("model_name"),
                    F.when(F.col("p_size") % 10 == 0, F.lit(None).cast("string"))
                    .otherwise(F.col("p_size").cast("string")).alias("model_version"), "p_size", "p_retailprice")


def _reg_side(reg, cond, stage):
    return (reg.where(cond).groupBy("model_name", "model_version")
            .agg(F.round(F.avg("p_retailprice") / 2000, 6).alias("selected_threshold"),
                 F.count(F.lit(1)).alias("n_parts")).withColumn("model_stage", F.lit(stage)))


@query("registry_upsert", sql=f"""WITH {REG_SQL},
tgt AS (SELECT model_name, model_version, round(avg(p_retailprice) / 2000, 6) AS selected_threshold,
        count(*) AS n_parts, 'local' AS model_stage FROM reg WHERE p_size <= 30 GROUP BY ALL),
src AS (SELECT model_name, model_version, round(avg(p_retailprice) / 2000, 6) AS selected_threshold,
        count(*) AS n_parts, 'candidate' AS model_stage FROM reg WHERE p_size >= 20 GROUP BY ALL)
SELECT * FROM src UNION ALL
SELECT * FROM tgt t WHERE NOT EXISTS (SELECT 1 FROM src s WHERE s.model_name IS NOT DISTINCT FROM t.model_name
  AND s.model_version IS NOT DISTINCT FROM t.model_version)""")
def registry_upsert(spark, sf_dir):
    reg = _registry(spark, sf_dir)
    tgt = _reg_side(reg, F.col("p_size") <= 30, "local")
    src = _reg_side(reg, F.col("p_size") >= 20, "candidate")
    return L.upsert(tgt, src, ["model_name", "model_version"])


@query("refstats_upsert", sql="""WITH e AS (SELECT event_type AS model_name,
  CASE WHEN week(ts) = 1 THEN NULL ELSE CAST(week(ts) AS VARCHAR) END AS model_version, ts, value FROM events),
tgt AS (SELECT model_name, model_version, count(*) AS n_rows, round(avg(value), 6) AS mean_value FROM e
        WHERE ts < TIMESTAMP '2024-01-15' GROUP BY ALL),
src AS (SELECT model_name, model_version, count(*) AS n_rows, round(avg(value), 6) AS mean_value FROM e
        WHERE ts >= TIMESTAMP '2024-01-08' GROUP BY ALL)
SELECT * FROM src UNION ALL SELECT * FROM tgt t WHERE NOT EXISTS (SELECT 1 FROM src s
  WHERE s.model_name IS NOT DISTINCT FROM t.model_name AND s.model_version IS NOT DISTINCT FROM t.model_version)""")
def refstats_upsert(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    wk = F.weekofyear("ts")
    e = ev.select(F.col("event_type").alias("model_name"),
                  F.when(wk == 1, F.lit(None).cast("string")).otherwise(wk.cast("string")).alias("model_version"),
                  "ts", "value")

    def side(cond):
        return e.where(cond).groupBy("model_name", "model_version").agg(
            F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("value"), 6).alias("mean_value"))
    cut1, cut2 = F.lit("2024-01-15").cast("timestamp_ntz"), F.lit("2024-01-08").cast("timestamp_ntz")
    return L.upsert(side(F.col("ts") < cut1), side(F.col("ts") >= cut2), ["model_name", "model_version"])


@query("by_model_version", sql=f"""WITH {REG_SQL},
keys AS (SELECT DISTINCT model_name, NULL::VARCHAR AS model_version FROM reg WHERE p_size > 40)
SELECT r.model_name, count(*) AS n FROM reg r JOIN keys k ON r.model_name = k.model_name
  AND r.model_version IS NOT DISTINCT FROM k.model_version GROUP BY ALL""")
def by_model_version(spark, sf_dir):
    """Rows whose (model, version) equals a lookup key null-safely (version IS NULL matches null)."""
    reg = _registry(spark, sf_dir)
    keys = (reg.where(F.col("p_size") > 40).select("model_name").distinct()
            .withColumn("model_version", F.lit(None).cast("string")))
    r, k = reg.alias("r"), keys.alias("k")
    j = r.join(k, (F.col("r.model_name") == F.col("k.model_name"))
               & F.col("r.model_version").eqNullSafe(F.col("k.model_version")))
    return j.groupBy(F.col("r.model_name").alias("model_name")).agg(F.count(F.lit(1)).alias("n"))


# ---- first-write-wins ledgers -------------------------------------------------------------------------------------
@query("event_insert_if_absent", sql="""WITH e AS (SELECT CAST(user_id AS VARCHAR) || ':' ||
  json_extract_string(props, '$.k') AS event_key,
  event_id, ts FROM events),
stored AS (SELECT DISTINCT event_key FROM e WHERE ts < TIMESTAMP '2024-01-15'),
inc AS (SELECT * FROM e WHERE ts >= TIMESTAMP '2024-01-15'
        QUALIFY row_number() OVER (PARTITION BY event_key ORDER BY ts, event_id) = 1)
SELECT event_key, event_id FROM inc WHERE event_key NOT IN (SELECT event_key FROM stored)""")
def event_insert_if_absent(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select(
        F.concat_ws(":", F.col("user_id").cast("string"), F.get_json_object("props", "$.k")).alias("event_key"),
        "event_id", "ts")
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    stored = ev.where(F.col("ts") < cut).select("event_key").distinct()
    new = L.insert_if_absent_agg(stored, ev.where(F.col("ts") >= cut), ["event_key"], ["ts", "event_id"])
    return new.select("event_key", "event_id")


@query("promotion_ledger", sql="""WITH r AS (SELECT 'promote:inv_' || CAST(o_custkey AS VARCHAR) || ':' ||
  o_orderpriority AS request_id, o_orderkey, o_orderdate FROM orders),
stored AS (SELECT DISTINCT request_id FROM r WHERE o_orderdate < TIMESTAMP '1996-01-01'),
inc AS (SELECT * FROM r WHERE o_orderdate >= TIMESTAMP '1996-01-01'
        QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY o_orderdate, o_orderkey) = 1)
SELECT request_id, o_orderkey FROM inc WHERE request_id NOT IN (SELECT request_id FROM stored)""")
def promotion_ledger(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select(
        F.concat(F.lit("promote:inv_"), F.col("o_custkey").cast("string"), F.lit(":"), "o_orderpriority")
        .alias("request_id"), "o_orderkey", "o_orderdate")
    cut = F.lit("1996-01-01").cast("timestamp")
    stored = o.where(F.col("o_orderdate") < cut).select("request_id").distinct()
    return L.insert_if_absent(stored, o.where(F.col("o_orderdate") >= cut), ["request_id"],
                              ["o_orderdate", "o_orderkey"]).select("request_id", "o_orderkey")


@query("rollback_ledger", sql="""WITH r AS (SELECT 'rollback:' || CAST(l_partkey AS VARCHAR) || ':' ||
  CAST(l_suppkey AS VARCHAR)
  AS request_id, l_orderkey, l_linenumber, l_shipdate FROM lineitem),
stored AS (SELECT DISTINCT request_id FROM r WHERE l_shipdate < TIMESTAMP '1997-01-01'),
inc AS (SELECT * FROM r WHERE l_shipdate >= TIMESTAMP '1997-01-01'
        QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY l_shipdate, l_orderkey, l_linenumber) = 1)
SELECT request_id, l_shipdate FROM inc WHERE request_id NOT IN (SELECT request_id FROM stored)""")
def rollback_ledger(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("rollback:"), F.col("l_partkey").cast("string"), F.lit(":"), F.col("l_suppkey").cast("string"))
        .alias("request_id"), "l_orderkey", "l_linenumber", "l_shipdate")
    cut = F.lit("1997-01-01").cast("timestamp")
    stored = li.where(F.col("l_shipdate") < cut).select("request_id").distinct()
    return L.insert_if_absent_agg(stored, li.where(F.col("l_shipdate") >= cut), ["request_id"],
                                  ["l_shipdate", "l_orderkey", "l_linenumber"]).select("request_id", "l_shipdate")


# ---- state folds -----------------------------------------------------------------------------------------------
UPD_SQL = """u AS (SELECT 'inv_' || CAST(l_orderkey AS VARCHAR) AS investigation_id, l_shipdate AS ts,
  l_linenumber AS seq, l_partkey, l_suppkey, l_extendedprice,
  CASE WHEN l_returnflag = 'N' THEN NULL WHEN l_linestatus = 'F' THEN 'resolved' ELSE 'running' END AS status,
  CASE l_returnflag WHEN 'R' THEN 'waiting_for_job' WHEN 'A' THEN 'completed' END AS current_step,
  CASE WHEN l_discount >= 0.05 THEN 'retrain' END AS recommended_action,
  CASE WHEN l_tax = 0 THEN 'tax-free line ' || CAST(l_linenumber AS VARCHAR) END AS summary,
  CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'resolve' ELSE 'update' END AS op FROM lineitem)"""
ORD = "(ts, seq, l_partkey, l_suppkey, l_extendedprice)"


@query("investigation_state", sql=f"""WITH {UPD_SQL}
SELECT investigation_id,
  arg_max_null(status, {ORD}) FILTER (WHERE status IS NOT NULL) AS status,
  arg_max_null(current_step, {ORD}) FILTER (WHERE current_step IS NOT NULL) AS current_step,
  arg_max_null(recommended_action, {ORD}) FILTER (WHERE recommended_action IS NOT NULL) AS recommended_action,
  arg_max_null(summary, {ORD}) FILTER (WHERE summary IS NOT NULL) AS summary,
  coalesce(arg_max_null(ts, {ORD}) FILTER (WHERE op = 'resolve'),
           arg_min_null(ts, {ORD}) FILTER (WHERE status = 'resolved')) AS resolved_at,
  min(ts) AS opened_at, max(ts) AS updated_at
FROM u GROUP BY ALL""")
def investigation_state(spark, sf_dir):
    upd = investigation_updates(spark, sf_dir)
    return L.investigation_state(upd, order_cols=("ts", "seq", "l_partkey", "l_suppkey", "l_extendedprice"))


APR_EV_SQL = APR_SQL + """,
aev AS (SELECT approval_id, created_at AS ts, 0 AS seq, 'pending' AS status, NULL AS actor, NULL AS reason FROM apr
  UNION ALL SELECT approval_id, created_at + INTERVAL 1 DAY, 1, status, 'ops',
    CASE WHEN status = 'rejected' THEN 'rejected by ops' END FROM apr WHERE status <> 'pending')"""


@query("approval_state", sql=f"""WITH {APR_EV_SQL}
SELECT approval_id, arg_max_null(status, (ts, seq)) AS status,
  arg_max_null(CASE WHEN status = 'approved' THEN true WHEN status IN ('rejected', 'expired') THEN false END, (ts, seq))
    FILTER (WHERE status <> 'pending') AS approved,
  arg_max_null(actor, (ts, seq)) FILTER (WHERE status = 'approved') AS approved_by,
  arg_max_null(actor, (ts, seq)) FILTER (WHERE status = 'rejected') AS rejected_by,
  arg_max_null(reason, (ts, seq)) FILTER (WHERE status IN ('rejected', 'expired')) AS rejection_reason
FROM aev GROUP BY ALL""")
def approval_state(spark, sf_dir):
    apr = approvals_ledger(spark, sf_dir)
    created = apr.select("approval_id", F.col("created_at").alias("ts"), F.lit(0).alias("seq"),
                         F.lit("pending").alias("status"), F.lit(None).cast("string").alias("actor"),
                         F.lit(None).cast("string").alias("reason"))
    decided = apr.where(F.col("status") != "pending").select(
        "approval_id", (F.col("created_at") + F.expr("INTERVAL 1 DAY")).alias("ts"), F.lit(1).alias("seq"),
        "status", F.lit("ops").alias("actor"),
        F.when(F.col("status") == "rejected", F.lit("rejected by ops")).alias("reason"))
    st = L.approval_state(created.unionByName(decided))
    return st.select("approval_id", "status", "approved", "approved_by", "rejected_by", "rejection_reason")


# ---- job attempts: numbering, retry, DLQ, state, depth, overlaps -------------------------------------------
ATT_SQL = """att AS (SELECT 'job_' || CAST(user_id AS VARCHAR) || '_' || strftime(ts, '%Y%m%d') AS job_id, user_id,
  event_id, ts, event_type <> 'error' AS ok FROM events),
num AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS attempt FROM att),
fo AS (SELECT job_id, min(attempt) FILTER (WHERE ok) AS first_ok FROM num GROUP BY ALL),
routed AS (SELECT n.*, least(coalesce(fo.first_ok, 3), 3) AS term FROM num n JOIN fo USING (job_id)),
rt AS (SELECT *, CASE WHEN attempt < term THEN 'retrying' WHEN attempt = term AND ok THEN 'completed'
  WHEN attempt = term THEN 'dlq' ELSE 'skipped_duplicate' END AS outcome FROM routed)"""


@query("retry_schedule", sql=f"""WITH {ATT_SQL}
SELECT job_id, attempt, 2 * (1 << greatest(attempt - 1, 0)) AS delay_seconds,
  strftime(ts + to_seconds(2 * (1 << greatest(attempt - 1, 0))), '%Y-%m-%d %H:%M:%S.%f') AS not_before
FROM rt WHERE outcome = 'retrying'""")
def retry_schedule(spark, sf_dir):
    r = Q.route_attempts(job_attempts(spark, sf_dir))
    return r.where(F.col("outcome") == "retrying").select(
        "job_id", "attempt", "delay_seconds",
        F.date_format("not_before", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("not_before"))


@query("dlq_route", sql=f"WITH {ATT_SQL} SELECT job_id, outcome, count(*) AS n FROM rt GROUP BY ALL")
def dlq_route(spark, sf_dir):
    r = Q.route_attempts(job_attempts(spark, sf_dir))
    return r.groupBy("job_id", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("job_state", sql=f"""WITH {ATT_SQL},
lev AS (SELECT job_id, ts, attempt * 2 - 1 AS seq, 'running' AS status, attempt AS attempts FROM rt
        WHERE outcome <> 'skipped_duplicate'
        UNION ALL SELECT job_id, ts, attempt * 2, outcome,
                         CASE WHEN outcome <> 'skipped_duplicate' THEN attempt END FROM rt)
SELECT job_id, arg_max_null(status, (ts, seq)) AS status,
  arg_max_null(attempts, (ts, seq)) FILTER (WHERE attempts IS NOT NULL) AS attempts,
  bool_or(status = 'dlq') AS sent_to_dlq, count(*) FILTER (WHERE status = 'retrying') AS n_retries,
  count(*) AS n_events FROM lev GROUP BY ALL""")
def job_state(spark, sf_dir):
    r = Q.route_attempts(job_attempts(spark, sf_dir))
    st = L.job_state(Q.ledger_events(r))
    return st.select("job_id", "status", "attempts", "sent_to_dlq", "n_retries", "n_events")


@query("queue_depth", sql=f"""WITH {ATT_SQL},
lev AS (SELECT job_id, ts, attempt * 2 - 1 AS seq, 'running' AS status FROM rt WHERE outcome <> 'skipped_duplicate'
        UNION ALL SELECT job_id, ts, attempt * 2, outcome FROM rt),
st AS (SELECT job_id, arg_max_null(status, (ts, seq)) AS status FROM lev GROUP BY ALL)
SELECT count(*) FILTER (WHERE status = 'retrying') AS pending, count(*) FILTER (WHERE status = 'running') AS processing,
  count(*) FILTER (WHERE status = 'dlq') AS dlq, count(*) AS total FROM st""")
def queue_depth(spark, sf_dir):
    r = Q.route_attempts(job_attempts(spark, sf_dir))
    return Q.queue_depth(L.job_state(Q.ledger_events(r)))


@query("overlapping_attempts", sql="""WITH RECURSIVE t AS (SELECT DISTINCT user_id, ts FROM events),
nx AS (SELECT a.user_id, a.ts, min(b.ts) AS later FROM t a JOIN t b ON b.user_id = a.user_id
  AND b.ts >= a.ts + INTERVAL 30 MINUTE GROUP BY ALL),
held AS (SELECT user_id, min(ts) AS ts FROM t GROUP BY ALL
  UNION ALL SELECT h.user_id, nx.later FROM held h JOIN nx USING (user_id, ts)),
holder AS (SELECT min(event_id) AS event_id FROM held JOIN events USING (user_id, ts) GROUP BY user_id, ts)
SELECT user_id, event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM holder)""")
def overlapping_attempts(spark, sf_dir):
    att = job_attempts(spark, sf_dir)
    return Q.overlapping_attempts(att, "user_id", "ts").select("user_id", "event_id")


# ---- nested 1:N summaries ------------------------------------------------------------------------------------
@query("investigation_summary", sql="""WITH lines AS (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY ALL),
o AS (SELECT o.o_custkey, o.o_orderkey, o.o_orderdate, coalesce(l.n_lines, 0) AS n_lines
      FROM orders o LEFT JOIN lines l ON l.l_orderkey = o.o_orderkey)
SELECT c.c_custkey, count(o.o_orderkey) AS n_orders, coalesce(sum(o.n_lines), 0) AS n_lines,
  coalesce(string_agg(CAST(o.o_orderkey AS VARCHAR), ',' ORDER BY o.o_orderdate DESC, o.o_orderkey DESC), '') AS orders
FROM customer c LEFT JOIN o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey""")
def investigation_summary(spark, sf_dir):
    """Customer with its orders (newest first) and their line counts: each side pre-aggregated, then left joins."""
    cust = read_table(spark, sf_dir, "customer").select("c_custkey")
    lines = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"))
    orders = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    o = orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").select(
        "o_custkey", "o_orderkey", "o_orderdate", F.coalesce("n_lines", F.lit(0)).alias("n_lines"))
    nested = L.nested_children(o, "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "n_lines"], "orders",
                               descending=True)
    j = cust.join(nested, cust.c_custkey == nested.o_custkey, "left")
    return j.select("c_custkey", F.coalesce(F.size("orders"), F.lit(0)).cast("long").alias("n_orders"),
                    F.coalesce(F.aggregate("orders", F.lit(0).cast("long"), lambda a, x: a + x["n_lines"]),
                               F.lit(0).cast("long")).alias("n_lines"),
                    F.coalesce(F.array_join(F.transform("orders", lambda x: x["o_orderkey"].cast("string")), ","),
                               F.lit("")).alias("orders"))


@query("conversation_summary", sql="""SELECT conv_id, count(*) AS n_messages,
  string_agg(role, '>' ORDER BY turn) AS roles, sum(length(text)) AS n_chars FROM conversations GROUP BY ALL""")
def conversation_summary(spark, sf_dir):
    """Messages of each conversation in time order (the message list of an investigation)."""
    cv = read_table(spark, sf_dir, "conversations")
    nested = L.nested_children(cv, "conv_id", ["turn"], ["role", "text"], "messages")
    return nested.select("conv_id", F.size("messages").cast("long").alias("n_messages"),
                         F.array_join(F.transform("messages", lambda m: m["role"]), ">").alias("roles"),
                         F.aggregate("messages", F.lit(0).cast("long"), lambda a, m: a + F.length(m["text"]))
                         .alias("n_chars"))
