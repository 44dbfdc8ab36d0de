"""Queries on orders, shipments and events: governance, rolls, scans and the forward ledger."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tidegate.model import digest
from tidegate.operators import forward, governance, panel, rolls, splits
from tidegate.plans.tracks import dense_panel
from tidegate.plans.weekly import BASE, MODELLED, modelled, read
from tidegate.session import kept, shared_path
from tidegate.sources import ledger_files
from tidegate.sources.files import Limits, read_upload
from tidegate.sources.upload import load_upload
from tidegate.streaming.forward import replay

FORWARD_START = "2024-01-03"
PROTOCOL = forward.ForwardProtocol("events", FORWARD_START, minimum_settled=50, minimum_sessions=3)


def merged_intervals(spark, sf_dir):
    """Each user's purchases stretched to 6 hours and merged where they touch."""
    rows = read(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", F.col("ts").alias("info_start"), (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("info_end"))
    found = splits.merged_intervals(rows, "user_id")
    return found.groupBy("user_id").agg(F.count("*").alias("islands"), F.max("members").alias("largest"), F.sum(F.unix_micros(F.col("high").cast("timestamp")) - F.unix_micros(F.col("low").cast("timestamp"))).alias("covered_us"))


def interval_overlap_count(spark, sf_dir):
    """Per user: views whose 2 hours meet the 6 hours of any of the user's purchases."""
    rows = read(spark, sf_dir, "events").where("event_type in ('view', 'purchase')")
    length = F.when(F.col("event_type") == "view", F.expr("INTERVAL 2 HOURS")).otherwise(F.expr("INTERVAL 6 HOURS"))
    marked = rows.select(F.col("user_id").alias("fold"), F.when(F.col("event_type") == "purchase", "test").otherwise("candidate").alias("role"), F.col("ts").alias("info_start"), (F.col("ts") + length).alias("info_end"))
    return splits.with_overlap(marked).where("role = 'candidate'").groupBy(F.col("fold").alias("user_id")).agg(F.count("*").alias("views"), F.count_if("overlaps").alias("overlapping"))


def _decisions(spark, sf_dir):
    """Orders decided 90 days after their date, with shipments as features that become available when shipped."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS")).alias("decision_time"))
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_agg("l_shipdate").alias("feature_available"), F.array_agg("l_quantity").alias("features"))
    return orders.join(lines, "o_orderkey").withColumnRenamed("o_orderkey", "position")


def pit_late_rows(spark, sf_dir):
    return _decisions(spark, sf_dir).where(governance.late()).select("position", F.size(F.filter("feature_available", lambda a: a > F.col("decision_time"))).cast("long").alias("late_features"))


def feature_governance_receipt(spark, sf_dir):
    rows = _decisions(spark, sf_dir)
    return rows.agg(F.count("*").alias("observations"), F.sum(F.size("features")).cast("long").alias("availability_cells"), F.max(F.size("features")).cast("long").alias("widest"), F.count_if(governance.late()).alias("late_rows"))


def duplicate_asset_sessions(spark, sf_dir):
    """Customers with several orders on one day."""
    return governance.duplicates(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("asset"), F.col("o_orderdate").cast("date").alias("session")), "asset", "session")


def daily_label_geometry(spark, sf_dir):
    found = panel.label_geometry(dense_panel(spark, sf_dir), lookback=3, horizon=2, decision_minutes=30)
    return found.select("asset", "session", "info_start", "info_end", F.round(F.col("target") + 0.0, 8).alias("target"), F.unix_micros(F.col("decision_time").cast("timestamp")).alias("decision_us"))


def temporal_supervised_dataset(spark, sf_dir):
    found = panel.temporal_samples(dense_panel(spark, sf_dir), lookback=3, horizon=2)
    lags = [F.round(F.col("features")[i] + 0.0, 6).alias(f"lag_{3 - i}") for i in range(3)]
    return found.select("asset", "session", "info_start", "info_end", F.round(F.col("target") + 0.0, 6).alias("target"), *lags)


def contract_roll_audit(spark, sf_dir):
    """Orders of each customer as a series whose contract is the priority."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("asset"), F.col("o_orderdate").alias("session"), F.col("o_orderkey").alias("tie"), F.col("o_orderpriority").alias("contract"))
    return rolls.roll_audit(rolls.roll_flags(rows, lookback=3, horizon=2, order=("session", "tie")), "asset")


def trailing_window_scan(spark, sf_dir):
    """Orders of the last three years up to the latest, by year."""
    from tidegate.sources.files import trailing_window

    rows = trailing_window(read(spark, sf_dir, "orders"), "o_orderdate", years=3)
    return rows.groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def bounded_projection_scan(spark, sf_dir):
    """Two pruned columns of the filtered lines, summed: the scan reads no others."""
    rows = read(spark, sf_dir, "lineitem").where(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).select("l_returnflag", "l_quantity")
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def csv_bounded_scan(spark, sf_dir):
    """Two of the orders' columns, out of a CSV copy of the table: header checked first, others never parsed into rows."""
    path = shared_path(spark, "orders") + ".csv"
    orders = read(spark, sf_dir, "orders")
    orders.select("o_orderkey", "o_orderpriority", "o_totalprice", F.col("o_orderdate").cast("date").alias("o_orderdate")).write.option("header", True).csv(path)
    limits = Limits(rows=2**31 - 2, file_bytes=2**50)  # a table of the engine's own, not a stranger's file
    rows = read_upload(spark, path, StructType([StructField("o_orderpriority", StringType()), StructField("o_totalprice", DoubleType())]), limits)
    return rows.groupBy("o_orderpriority").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def governed_upload(spark, sf_dir):
    """The weekly samples as an upload: a CSV file, its manifest and its mapping; the receipt and what the dataset holds."""
    data, axis = modelled(spark, sf_dir)
    known = F.col("session").cast("timestamp_ntz")
    stamped = data.select(
        F.concat_ws("::", "asset", "session").alias("id"), "asset", known.alias("session"), F.col("info_start").cast("timestamp_ntz").alias("info_start"), F.col("info_end").cast("timestamp_ntz").alias("info_end"),
        known.alias("decided"), "target", "ret", "price", known.alias("ret_known"), known.alias("price_known"),
    )
    path = shared_path(spark, "samples") + ".csv"
    stamped.repartitionByRange("session").sortWithinPartitions("session", "asset").write.option("header", True).csv(path)
    bundle = digest("lineitem")
    feature = {
        "source_dataset": "lineitem", "source_fields": ["l_extendedprice"], "source_digest": bundle, "transformation_version": "1", "code_digest": digest("weekly panel"), "parameters": {},
        "computation_scope": "precomputed-stateless", "revision_policy": "point-in-time", "uses_target": False,
    }
    manifest = {"schema_version": "1", "source_bundle_digest": bundle, "features": [feature | {"name": "ret", "transformation": "change of a week", "lookback_sessions": 2}, feature | {"name": "price", "transformation": "mean", "lookback_sessions": 1}]}
    mapping = {
        "schema_version": "1", "sample_id_column": "id", "session_column": "session", "asset_id_column": "asset", "interval_start_column": "info_start", "interval_end_column": "info_end",
        "decision_time_column": "decided", "target_column": "target", "feature_columns": ["ret", "price"], "availability_columns": ["ret_known", "price_known"],
        "session_axis": [str(r[0]) for r in axis.orderBy("axis_pos").select("session").collect()],  # a row for each week
        "pit_snapshot": {"snapshot_id": "weekly", "source_digest": bundle, "revision_policy": "point-in-time"},
    }
    found = load_upload(spark, path, manifest, mapping)
    said = [F.lit(found.receipt[n]).cast("long").alias(n) for n in ("observations", "features", "availability_cells", "max_lookback_sessions")]
    held = found.dataset.agg(F.count_distinct("asset").alias("assets"), F.min("axis_pos").alias("first_pos"), F.max("axis_pos").alias("last_pos"), F.round(F.sum("target"), 6).alias("target_sum"))
    return held.select(*said, "assets", "first_pos", "last_pos", "target_sum")


def _ledger(spark, sf_dir):
    """Each user's k-th view is a prediction, settled by the user's k-th purchase; both as tables."""
    events = read(spark, sf_dir, "events").where("event_type in ('view', 'purchase')").withColumn("k", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")))
    views = events.where("event_type = 'view'").select(
        F.col("event_id").alias("sample_id"),
        F.concat_ws(":", "user_id", "k").alias("prediction_digest"),
        F.col("ts").cast("date").alias("decision_session"),
        F.date_add(F.col("ts").cast("date"), 1).alias("label_end_session"),
        (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("label_available_at"),
        F.col("ts").alias("recorded_at"),
        (F.col("value") / 100).alias("prediction"),
    )
    bought = events.where("event_type = 'purchase'").select(F.concat_ws(":", "user_id", "k").alias("prediction_digest"), F.col("ts").alias("settled_at"), (F.col("value") / 100).alias("target"))
    return kept(views, "forward-predictions"), kept(bought, "forward-settlements")


def forward_settled_pairs(spark, sf_dir):
    return forward.settled_pairs(*_ledger(spark, sf_dir)).select("sample_id", "prediction_digest", "decision_session", "prediction", "target")


def forward_integrity(spark, sf_dir):
    return forward.integrity(*_ledger(spark, sf_dir), FORWARD_START)


def forward_report(spark, sf_dir):
    found = forward.report(*_ledger(spark, sf_dir), PROTOCOL)
    return found.withColumns({n: F.round(F.col(n) + 0.0, 6) for n in ("mse", "zero_mse", "mean_ic")})


def ledger_file_faults(spark, sf_dir):
    """The ledger written as lines of JSON, some of them spoilt on the way, and what reading both folders says of each."""
    made, done = _ledger(spark, sf_dir)
    text = lambda c: F.col(c).cast("string")
    rows = made.select(
        text("sample_id").alias("sample_id"), F.lit("all").alias("asset"), "decision_session", "label_end_session", "label_available_at", "prediction", F.lit("-").alias("feature_snapshot_digest"),
        F.lit("-").alias("protocol_digest"), "recorded_at", F.col("sample_id").alias("number"), (F.hour("recorded_at") == 3).alias("changed"),
    )
    rows = rows.withColumn("prediction_digest", ledger_files.recorded_digest()).withColumn("prediction", F.when(F.col("changed"), F.col("prediction") + 1).otherwise(F.col("prediction")))
    settled = done.select("prediction_digest", "target", F.lit("-").alias("target_source_digest"), F.lit("-").alias("protocol_digest"), "settled_at", F.hour("settled_at").alias("number"))
    settled = settled.withColumn("target", F.when(F.col("number") != 5, F.col("target")))
    line = ledger_files.document("predictions")
    lines = {
        "predictions": rows.select(F.when(F.col("number") % 10 == 0, F.concat(F.lit("{"), line)).otherwise(line).alias("value")),
        "settlements": settled.select(F.when(F.col("number") == 7, ledger_files.document("settlements", F.lit(1).alias("more"))).otherwise(ledger_files.document("settlements")).alias("value")),
    }
    found = []
    for kind, texts in lines.items():
        path = shared_path(spark, f"ledger-{kind}")
        texts.write.text(path)
        found.append(ledger_files.fault_counts(ledger_files.read(spark, path, kind, whole=False)).select(F.lit(kind).alias("kind"), "fault", "rows"))
    return found[0].union(found[1])


def forward_stream_join(spark, sf_dir):
    """What becomes of every prediction and settlement, from two streams over the ledger's tables, in rounds of event time."""
    found = replay(*_ledger(spark, sf_dir)).everything()
    return found.select(F.col("sample_id").cast("long").alias("sample_id"), "prediction_digest", "decision_session", "prediction", "target", "outcome")


LEDGER_SQL = """
ev AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
v AS (SELECT event_id AS sample_id, user_id || ':' || k AS prediction_digest, ts::DATE AS decision_session, ts::DATE + 1 AS label_end_session, ts + INTERVAL 1 HOUR AS label_available_at, ts AS recorded_at, value / 100 AS prediction FROM ev WHERE event_type = 'view'),
b AS (SELECT user_id || ':' || k AS prediction_digest, ts AS settled_at, value / 100 AS target FROM ev WHERE event_type = 'purchase'),
pr AS (SELECT v.*, b.settled_at, b.target FROM v JOIN b ON v.prediction_digest = b.prediction_digest WHERE settled_at >= label_available_at AND settled_at > recorded_at)"""
DECIDED = "dec AS (SELECT o_orderkey AS position, o_orderdate + INTERVAL 90 DAY AS decision_time, l_shipdate FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"
WEEKS = """p AS (SELECT date_trunc('week', l_shipdate)::DATE AS session, l_returnflag || l_linestatus AS asset, round(avg(l_extendedprice), 4) AS price FROM lineitem GROUP BY 1, 2),
d AS (SELECT *, coalesce(price / lag(price) OVER (PARTITION BY asset ORDER BY session) - 1, 0.0) AS ret FROM p WHERE session IN (SELECT session FROM p GROUP BY session HAVING count(*) = (SELECT count(DISTINCT asset) FROM p)))"""

SQL = {
    "merged_intervals": """WITH e AS (SELECT user_id, ts AS a, ts + INTERVAL 6 HOUR AS z FROM events WHERE event_type = 'purchase'),
      o AS (SELECT *, CASE WHEN max(z) OVER (PARTITION BY user_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= a THEN 0 ELSE 1 END AS opens FROM e),
      i AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS island FROM o), m AS (SELECT user_id, island, min(a) AS low, max(z) AS high, count(*) AS members FROM i GROUP BY 1, 2)
      SELECT user_id, count(*) AS islands, max(members) AS largest, sum(epoch_us(high) - epoch_us(low))::BIGINT AS covered_us FROM m GROUP BY 1""",
    "interval_overlap_count": """SELECT user_id, count(*) AS views, count(*) FILTER (EXISTS (SELECT 1 FROM events t WHERE t.event_type = 'purchase' AND t.user_id = e.user_id AND t.ts <= e.ts + INTERVAL 2 HOUR AND e.ts <= t.ts + INTERVAL 6 HOUR)) AS overlapping FROM events e WHERE event_type = 'view' GROUP BY 1""",
    "pit_late_rows": f"WITH {DECIDED} SELECT position, count(*) AS late_features FROM dec WHERE l_shipdate > decision_time GROUP BY 1",
    "feature_governance_receipt": f"WITH {DECIDED}, g AS (SELECT position, count(*) AS n, count(*) FILTER (l_shipdate > decision_time) AS late FROM dec GROUP BY 1) SELECT count(*) AS observations, sum(n)::BIGINT AS availability_cells, max(n) AS widest, count(*) FILTER (late > 0) AS late_rows FROM g",
    "duplicate_asset_sessions": "SELECT o_custkey AS asset, o_orderdate::DATE AS session, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1",
    "daily_label_geometry": f"WITH {WEEKS}, q AS (SELECT asset, session, lag(session, 2) OVER w AS info_start, lead(session, 2) OVER w AS info_end, lead(price, 2) OVER w / price - 1 AS target FROM d WINDOW w AS (PARTITION BY asset ORDER BY session)) SELECT asset, session, info_start, info_end, round(target + 0.0, 8) AS target, epoch_us(session::TIMESTAMP + INTERVAL 30 MINUTE) AS decision_us FROM q WHERE info_start IS NOT NULL AND info_end IS NOT NULL",
    "temporal_supervised_dataset": f"WITH {WEEKS}, q AS (SELECT asset, session, lag(session, 3) OVER w AS info_start, lead(session, 2) OVER w AS info_end, lead(price, 2) OVER w / price - 1 AS target, lag(ret, 1) OVER w AS l1, lag(ret, 2) OVER w AS l2, lag(ret, 3) OVER w AS l3 FROM d WINDOW w AS (PARTITION BY asset ORDER BY session)) SELECT asset, session, info_start, info_end, round(target + 0.0, 6) AS target, round(l3 + 0.0, 6) AS lag_3, round(l2 + 0.0, 6) AS lag_2, round(l1 + 0.0, 6) AS lag_1 FROM q WHERE info_start IS NOT NULL AND info_end IS NOT NULL",
    "contract_roll_audit": """WITH n AS (SELECT o_custkey AS asset, o_orderpriority AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS m FROM orders),
      f AS (SELECT n.asset, n.k, n.m, n.c <> b.c AS changed, n.k >= 3 AND n.k + 2 <= n.m AS eligible, EXISTS (SELECT 1 FROM n x WHERE x.asset = n.asset AND x.k BETWEEN n.k + 1 AND n.k + 2 AND x.c <> n.c) AS lc,
        EXISTS (SELECT 1 FROM n x JOIN n y ON x.asset = y.asset AND y.k = x.k + 1 WHERE x.asset = n.asset AND x.k BETWEEN n.k - 2 AND n.k + 1 AND x.c <> y.c) AS ic FROM n LEFT JOIN n b ON b.asset = n.asset AND b.k = n.k - 1)
      SELECT asset, count(*) AS rows, count(*) FILTER (changed) AS transitions, count(*) FILTER (eligible) AS eligible, count(*) FILTER (eligible AND lc) AS label_cross, count(*) FILTER (eligible AND ic) AS interval_cross FROM f GROUP BY 1""",
    "trailing_window_scan": "WITH m AS (SELECT max(o_orderdate) AS last FROM orders) SELECT year(o_orderdate) AS year, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders, m WHERE o_orderdate >= last - INTERVAL 36 MONTH AND o_orderdate <= last GROUP BY 1",
    "bounded_projection_scan": "SELECT l_returnflag, count(*) AS lines, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY 1",
    "csv_bounded_scan": "SELECT o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
    "governed_upload": f"WITH {BASE}{MODELLED} SELECT count(*) AS observations, 2::BIGINT AS features, 2 * count(*) AS availability_cells, 2::BIGINT AS max_lookback_sessions, count(DISTINCT asset) AS assets, min(pos) AS first_pos, max(pos) AS last_pos, round(sum(target), 6) AS target_sum FROM s",
    "forward_settled_pairs": f"WITH {LEDGER_SQL} SELECT sample_id, prediction_digest, decision_session, prediction, target FROM pr",
    "forward_stream_join": f"""WITH {LEDGER_SQL} SELECT sample_id, coalesce(v.prediction_digest, b.prediction_digest) AS prediction_digest, decision_session, prediction, b.target,
      CASE WHEN v.prediction_digest IS NULL THEN 'orphan-settlement' WHEN b.prediction_digest IS NULL THEN 'unsettled' WHEN settled_at >= label_available_at AND settled_at > recorded_at THEN 'settled' ELSE 'settled-early' END AS outcome
      FROM v FULL JOIN b ON v.prediction_digest = b.prediction_digest""",
    "ledger_file_faults": f"""WITH {LEDGER_SQL} SELECT 'predictions' AS kind, CASE WHEN sample_id % 10 = 0 THEN 'malformed' WHEN prediction IS NULL THEN 'missing-value' WHEN hour(recorded_at) = 3 THEN 'altered' ELSE 'none' END AS fault, count(*) AS rows FROM v GROUP BY 1, 2
      UNION ALL SELECT 'settlements', CASE WHEN hour(settled_at) = 7 THEN 'unknown-key' WHEN hour(settled_at) = 5 OR target IS NULL THEN 'missing-value' ELSE 'none' END, count(*) FROM b GROUP BY 1, 2""",
    "forward_integrity": f"""WITH {LEDGER_SQL} SELECT 'before-forward-start' AS rule, count(*) AS violations FROM v WHERE decision_session < DATE '{FORWARD_START}' HAVING count(*) > 0
      UNION ALL SELECT 'repeated-sample', count(*) FROM (SELECT 1 FROM v GROUP BY sample_id HAVING count(*) > 1) UNION ALL SELECT 'repeated-settlement', count(*) FROM (SELECT 1 FROM b GROUP BY prediction_digest HAVING count(*) > 1)
      UNION ALL SELECT 'orphan-settlement', count(*) FROM b WHERE prediction_digest NOT IN (SELECT prediction_digest FROM v) UNION ALL SELECT 'settled-early', count(*) FROM v JOIN b ON v.prediction_digest = b.prediction_digest WHERE settled_at < label_available_at OR settled_at <= recorded_at""",
    "forward_report": f"""WITH {LEDGER_SQL}, rk AS (SELECT *, rank() OVER (PARTITION BY decision_session ORDER BY target) + (count(*) OVER (PARTITION BY decision_session, target) - 1) / 2.0 AS rt, rank() OVER (PARTITION BY decision_session ORDER BY prediction) + (count(*) OVER (PARTITION BY decision_session, prediction) - 1) / 2.0 AS rp FROM pr),
      ic AS (SELECT avg(ic) AS ic FROM (SELECT count(*) AS n, covar_pop(rt, rp) / nullif(stddev_pop(rt) * stddev_pop(rp), 0) AS ic FROM rk GROUP BY decision_session) WHERE n >= 2 AND ic IS NOT NULL),
      a AS (SELECT (SELECT count(*) FROM v) AS predictions, count(*) AS settled, count(DISTINCT decision_session) AS sessions, avg((target - prediction) * (target - prediction)) AS mse, avg(target * target) AS zero_mse FROM pr)
      SELECT predictions, settled, sessions, round(mse, 6) AS mse, round(zero_mse, 6) AS zero_mse, round(ic + 0.0, 6) AS mean_ic, CASE WHEN predictions = 0 THEN 'WAITING_FOR_FUTURE_DATA' WHEN settled < 50 OR sessions < 3 THEN 'COLLECTING' WHEN mse <= zero_mse AND ic >= 0 THEN 'READY_FOR_REVIEW' ELSE 'FAIL' END AS status FROM a, ic""",
}
DATES = {
    "duplicate_asset_sessions": ("session",),
    "daily_label_geometry": ("session", "info_start", "info_end"),
    "temporal_supervised_dataset": ("session", "info_start", "info_end"),
    "forward_settled_pairs": ("decision_session",),
    "forward_stream_join": ("decision_session",),
}
QUERIES = {n: f for n, f in globals().items() if n in SQL}
