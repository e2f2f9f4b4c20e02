"""Registered queries over the test tables, and the SQL that each must equal."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnbeck.functions.expressions import identifier_hash, label_at, order_status
from tarnbeck.functions.lineage import data_snapshot_id, label_version, model_version, schema_digest, snapshot_id, source_fingerprint
from tarnbeck.operators import features, labels, model, quality, serving, silver, snapshot
from tarnbeck.plans import stages
from tarnbeck.sources import adapter
from tarnbeck.sources.contracts import Contract
from tarnbeck.sources.tables import AppendLog, VersionedTable, union_all, upsert
from tarnbeck.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

DAYS = ("2001-03-31", "2001-04-30", "2001-05-31")
AS_OF = DAYS[-1]
HORIZON = 60
RUN_TS = datetime(2001, 9, 1, tzinfo=UTC)
SILVER = Contract.own("silver_orders")
GOLD = Contract.own("gold_features")
BRONZE = Contract.own("bronze_orders")
ALLOWED = SILVER.allowed["order_status"]
ALLOWED_SQL = ", ".join(f"'{s}'" for s in ALLOWED)

#: The raw columns, all of them texts.
RAW_COLUMNS = (
    "order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date",
    "order_delivered_customer_date", "order_estimated_delivery_date",
)


def _digest_sql(text: str, length: int = 16) -> str:
    """A digest that DuckDB computes."""
    return "substr(sha256('" + text.replace("'", "''") + f"'), 1, {length})"


LABEL_VERSION_SQL = _digest_sql(
    f'{{"entity":"customer_daily_snapshot","label_horizon_days":{HORIZON},"label_name":"churn_label",'
    '"positive_class":"no valid future order in horizon","valid_future_order_invalid_statuses":["canceled","unavailable"],"version":1,'
    '"window":"(as_of_date, as_of_date + horizon]"}'
)
GOLD_VERSION_SQL = _digest_sql(json.dumps(json.loads(Contract.own_text("gold_features")), sort_keys=True, separators=(",", ":")))

# --- the same adapters in SQL ---
RAW_SQL = """raw AS (
  SELECT 'O-' || o_orderkey AS order_id, 'C-' || o_custkey AS customer_id,
    CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipment_pending' WHEN 'P' THEN 'cancelled' END AS order_status,
    strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS order_purchase_timestamp
  FROM orders)"""
CLEAN_SQL = """silver AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id, o_orderdate AS order_purchase_ts,
    CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'processing' WHEN 'P' THEN 'canceled' END AS order_status
  FROM orders)"""
DIRTY_SQL = """landed AS (
  SELECT *, unnest(CASE WHEN o_orderkey % 10 = 0 THEN [0, 1] ELSE [0] END) AS land FROM orders
), bronze AS (
  SELECT CASE WHEN o_orderkey % 7 = 0 THEN '  O-' || o_orderkey || ' ' ELSE 'O-' || o_orderkey END AS order_id,
    CASE WHEN o_orderkey % 97 <> 0 THEN 'C-' || o_custkey END AS customer_id,
    CASE WHEN o_orderkey % 83 = 0 THEN 'lost' WHEN land = 1 THEN 'Shipped' ELSE CASE o_orderstatus
      WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipment_pending' WHEN 'P' THEN 'cancelled' END END AS order_status,
    CASE WHEN o_orderkey % 89 = 0 THEN 'not a time' ELSE strftime(o_orderdate + land * INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') END AS raw_ts,
    'run-' || land AS run_id, land
  FROM landed
), plain AS (
  SELECT lower(trim(order_id)) AS order_id, lower(trim(customer_id)) AS customer_id,
    try_strptime(trim(raw_ts), '%Y-%m-%d %H:%M:%S') AS ts,
    CASE lower(trim(order_status)) WHEN 'cancelled' THEN 'canceled' WHEN 'shipment_pending' THEN 'processing'
      ELSE lower(trim(order_status)) END AS order_status,
    run_id, land
  FROM bronze
)"""
VALID_SQL = f"(order_id IS NOT NULL AND customer_id IS NOT NULL AND ts IS NOT NULL AND order_status IS NOT NULL AND order_status IN ({ALLOWED_SQL}))"
RANKED_SQL = f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY ts DESC, land DESC) AS place FROM plain WHERE {VALID_SQL}
)"""
PARTS_SQL = "order_id, customer_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS order_purchase_ts, order_status, run_id AS bronze_run_id"


def _days_sql(days: tuple[str, ...]) -> str:
    return "days AS (SELECT unnest([" + ", ".join(f"DATE '{d}'" for d in days) + "]) AS d)"


def features_sql(days: tuple[str, ...]) -> str:
    """CTEs that end in `feats`, written the long way: one part for each measure, then joined."""
    return f"""{CLEAN_SQL}, {_days_sql(days)}, o AS (
  SELECT d, customer_id, order_id, order_purchase_ts, CAST(order_purchase_ts AS DATE) AS od
  FROM silver JOIN days ON CAST(order_purchase_ts AS DATE) <= d
), life AS (
  SELECT d, customer_id, max(od) AS hi, min(od) AS lo, count(DISTINCT order_id) AS n FROM o GROUP BY ALL
), m AS (SELECT d, customer_id, count(DISTINCT order_id) AS n FROM o WHERE od >= d - 29 GROUP BY ALL
), q AS (SELECT d, customer_id, count(DISTINCT order_id) AS n FROM o WHERE od >= d - 89 GROUP BY ALL
), g AS (
  SELECT d, customer_id, avg(gap) AS gap FROM (
    SELECT d, customer_id, od - lag(od) OVER (PARTITION BY d, customer_id ORDER BY order_purchase_ts, order_id) AS gap FROM o) GROUP BY ALL
), feats AS (
  SELECT life.customer_id, life.d AS as_of_date, CAST(life.d - hi AS INTEGER) AS recency_days,
    CAST(coalesce(m.n, 0) AS BIGINT) AS orders_30d, CAST(coalesce(q.n, 0) AS BIGINT) AS orders_90d, CAST(life.n AS BIGINT) AS lifetime_orders,
    CAST(life.d - lo AS INTEGER) AS customer_tenure_days, coalesce(round(gap, 9), 0.0) AS avg_days_between_orders
  FROM life LEFT JOIN m USING (d, customer_id) LEFT JOIN q USING (d, customer_id) LEFT JOIN g USING (d, customer_id)
)"""


def labels_sql(days: tuple[str, ...]) -> str:
    return f"""known AS (SELECT DISTINCT customer_id, d FROM silver JOIN days ON CAST(order_purchase_ts AS DATE) <= d
), back AS (
  SELECT DISTINCT customer_id, d FROM silver JOIN days
    ON CAST(order_purchase_ts AS DATE) > d AND CAST(order_purchase_ts AS DATE) <= d + {HORIZON}
  WHERE order_status NOT IN ('canceled', 'unavailable')
), lab AS (
  SELECT k.customer_id, k.d AS as_of_date, CAST(CASE WHEN b.customer_id IS NULL THEN 1 ELSE 0 END AS INTEGER) AS churn_label
  FROM known k LEFT JOIN back b USING (customer_id, d)
)"""


def query(sql: str | None = None) -> Callable:
    """Register a function of (spark, sf_dir) under its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("avg_days_between_orders", F.round("avg_days_between_orders", 9))


def _as_text(df: DataFrame) -> DataFrame:
    return df.select(
        "order_id", "customer_id", F.date_format("order_purchase_ts", "yyyy-MM-dd HH:mm:ss").alias("order_purchase_ts"), "order_status",
        F.col("_bronze_run_id").alias("bronze_run_id"),
    )


@query(
    f"WITH {RAW_SQL} SELECT *, 'r1' AS run_id, DATE '2001-09-01' AS ingest_date, (SELECT count(*) FROM raw) AS row_count, "
    f"{_digest_sql('|'.join(f'{n}:string' for n in RAW_COLUMNS))} AS schema_hash FROM raw"
)
def bronze_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = adapter.raw_orders(spark.read.parquet(f"{sf_dir}/orders.parquet"))
    BRONZE.check_schema(raw.schema)
    stamped = stages.stamp_bronze(raw, BRONZE, "r1", RUN_TS, "f0", raw.count())
    return stamped.select(
        "order_id", "customer_id", "order_status", "order_purchase_timestamp", "run_id", "ingest_date", "row_count", "schema_hash"
    )


def _parts(spark: SparkSession, sf_dir: str) -> silver.SilverParts:
    return silver.split_orders(adapter.dirty_bronze(spark, sf_dir), ALLOWED)


@query(f"WITH {DIRTY_SQL}, {RANKED_SQL} SELECT {PARTS_SQL} FROM ranked WHERE place = 1")
def silver_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_text(_parts(spark, sf_dir).kept)


@query(f"WITH {DIRTY_SQL} SELECT {PARTS_SQL} FROM plain WHERE NOT coalesce({VALID_SQL}, false)")
def silver_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_text(_parts(spark, sf_dir).rejects)


@query(f"WITH {DIRTY_SQL}, {RANKED_SQL} SELECT {PARTS_SQL} FROM ranked WHERE place > 1")
def silver_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_text(_parts(spark, sf_dir).duplicates)


@query(f"WITH {DIRTY_SQL} SELECT order_status, count(*) AS orders FROM plain GROUP BY 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapter.dirty_bronze(spark, sf_dir).select(order_status(F.col("order_status")).alias("order_status"))
    return rows.groupBy("order_status").agg(F.count("*").alias("orders"))


@query(f"""WITH {DIRTY_SQL}, dup AS (SELECT order_id, count(*) AS n FROM plain GROUP BY 1 HAVING count(*) > 1)
SELECT 'order_id_not_null' AS check_name, count(*) FILTER (order_id IS NULL) AS bad_rows, 0::BIGINT AS duplicate_keys FROM plain
UNION ALL SELECT 'customer_id_not_null', count(*) FILTER (customer_id IS NULL), 0 FROM plain
UNION ALL SELECT 'unique_order_id', coalesce(sum(n), 0)::BIGINT, count(*) FROM dup
UNION ALL SELECT 'allowed_order_status', count(*) FILTER (order_status IS NULL OR order_status NOT IN ({ALLOWED_SQL})), 0 FROM plain""")
def dq_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.run_suite(silver.normalise(adapter.dirty_bronze(spark, sf_dir)), stages.own_suite())
    rows = [(c["name"], c["bad_rows"], c.get("duplicate_keys", 0)) for c in found.metrics["checks"]]
    return spark.createDataFrame(rows, "check_name string, bad_rows long, duplicate_keys long")


@query(f"""WITH {DIRTY_SQL} SELECT {PARTS_SQL} FROM plain
WHERE order_id IN (SELECT order_id FROM plain GROUP BY 1 HAVING count(*) > 1)""")
def dq_unique_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_text(quality.rows_of_repeated_keys(silver.normalise(adapter.dirty_bronze(spark, sf_dir)), ["order_id"]))


@query(f"WITH {features_sql((AS_OF,))} SELECT * FROM feats")
def pit_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(features.features_at(adapter.clean_silver(spark, sf_dir), AS_OF))


@query(f"WITH {features_sql(DAYS)} SELECT * FROM feats")
def pit_features_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(features.features_over(adapter.clean_silver(spark, sf_dir), DAYS))


@query(f"""WITH {DIRTY_SQL} SELECT {PARTS_SQL} FROM plain
WHERE customer_id IN (SELECT customer_id FROM plain GROUP BY 1 HAVING count(*) > 1)""")
def dq_unique_with_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a customer share no key with each other."""
    return _as_text(quality.rows_of_repeated_keys(silver.normalise(adapter.dirty_bronze(spark, sf_dir)), ["customer_id"]))


@query(f"""WITH {features_sql(DAYS)}, made AS (SELECT *, CAST(customer_id AS BIGINT) % 50 AS n FROM feats), bad AS (
  SELECT customer_id, as_of_date, CASE WHEN n = 2 THEN -1 ELSE recency_days END AS recency_days,
    CASE WHEN n = 3 THEN orders_90d + 1 ELSE orders_30d END AS orders_30d, orders_90d, lifetime_orders, customer_tenure_days,
    CASE WHEN n <> 1 THEN avg_days_between_orders END AS avg_days_between_orders
  FROM made, (SELECT unnest([0, 1]) AS again) WHERE again = 0 OR n = 4)
SELECT
  count(*) FILTER (customer_id IS NULL OR as_of_date IS NULL OR avg_days_between_orders IS NULL) AS null_rows,
  count(*) FILTER (recency_days < 0 OR orders_30d < 0 OR orders_90d < 0 OR lifetime_orders < 1 OR customer_tenure_days < 0) AS range_rows,
  count(*) FILTER (orders_30d > orders_90d OR orders_90d > lifetime_orders OR recency_days > customer_tenure_days) AS order_rows,
  (SELECT count(*) FROM (SELECT 1 FROM bad GROUP BY customer_id, as_of_date HAVING count(*) > 1)) AS duplicate_keys FROM bad""")
def gold_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind of violation, planted by the customer's number, and counted by the contract."""
    made = features.stamp(features.features_over(adapter.clean_silver(spark, sf_dir), DAYS), GOLD.version, "r1", RUN_TS)
    quality.assert_contract(made, GOLD)
    n = F.col("customer_id").cast("long") % 50
    bad = made.unionByName(made.filter(n == 4)).withColumns(
        {
            "recency_days": F.when(n == 2, -1).otherwise(F.col("recency_days")), "orders_30d": F.when(n == 3, F.col("orders_90d") + 1).otherwise(F.col("orders_30d")),
            "avg_days_between_orders": F.when(n != 1, F.col("avg_days_between_orders")),
        }
    )
    found = quality.contract_metrics(bad, GOLD)
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{k} long" for k in found))


@query(f"""WITH {DIRTY_SQL}, dup AS (SELECT order_id FROM plain GROUP BY 1 HAVING count(*) > 1)
SELECT count(*) FILTER (order_id IS NULL OR customer_id IS NULL OR ts IS NULL OR order_status IS NULL) AS null_rows,
  count(*) FILTER (order_status NOT IN ({ALLOWED_SQL})) AS order_status_rows, (SELECT count(*) FROM dup) AS duplicate_keys FROM plain""")
def silver_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver's contract over rows that were not cleaned: nulls, a status out of its domain, repeated keys."""
    rows = silver.stamp(silver.normalise(adapter.dirty_bronze(spark, sf_dir)), SILVER.version, "r1", RUN_TS)
    found = quality.contract_metrics(rows, SILVER)
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{k} long" for k in found))


@query(f"""WITH {CLEAN_SQL} SELECT order_id, customer_id, CAST(order_purchase_ts AS DATE) AS order_day,
  CAST(CAST(order_purchase_ts AS DATE) - lag(CAST(order_purchase_ts AS DATE)) OVER (
    PARTITION BY customer_id ORDER BY order_purchase_ts, order_id) AS INTEGER) AS gap_days FROM silver""")
def order_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.order_gaps(adapter.clean_silver(spark, sf_dir)).select("order_id", "customer_id", "order_day", "gap_days")


@query(f"WITH {CLEAN_SQL}, {_days_sql((AS_OF,))}, {labels_sql((AS_OF,))} SELECT * FROM lab")
def churn_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = adapter.clean_silver(spark, sf_dir)
    labels.check_observable(labels.dataset_end(orders), AS_OF, HORIZON)
    return labels.labels_at(orders, AS_OF, HORIZON)


@query(f"""WITH {CLEAN_SQL}, {_days_sql(DAYS)}, {labels_sql(DAYS)} SELECT count(*) AS row_count,
  count(*) FILTER (churn_label = 1) AS positive_rows, count(*) FILTER (churn_label = 0) AS negative_rows FROM lab""")
def label_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.balance(labels.labels_over(adapter.clean_silver(spark, sf_dir), DAYS, HORIZON))


@query(f"""WITH {features_sql(DAYS[:2])}, old AS (SELECT * FROM feats WHERE as_of_date = DATE '{DAYS[0]}'),
new AS (SELECT * REPLACE (DATE '{DAYS[0]}' AS as_of_date) FROM feats WHERE as_of_date = DATE '{DAYS[1]}' AND length(customer_id) % 2 = 0)
SELECT * FROM new UNION ALL SELECT * FROM old WHERE customer_id NOT IN (SELECT customer_id FROM new)""")
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = adapter.clean_silver(spark, sf_dir)
    old = _rounded(features.features_at(orders, DAYS[0]))
    new = _rounded(features.features_at(orders, DAYS[1])).filter(F.length("customer_id") % 2 == 0)
    return upsert(old, new.withColumn("as_of_date", F.to_date(F.lit(DAYS[0]))), ["customer_id", "as_of_date"])


def _training(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = adapter.clean_silver(spark, sf_dir)
    gold = features.stamp(_rounded(features.features_over(orders, DAYS)), GOLD.version, "r1", RUN_TS)
    return snapshot.training_rows(gold, labels.stamp(labels.labels_over(orders, DAYS, HORIZON), HORIZON, "r1", RUN_TS))


TRAINING_SQL = f"""{features_sql(DAYS)}, {labels_sql(DAYS)}, training AS (
  SELECT feats.*, churn_label, substr(sha256(CAST(as_of_date AS VARCHAR) || '|' || {GOLD_VERSION_SQL}), 1, 16) AS _feature_snapshot_id,
    {GOLD_VERSION_SQL} AS _feature_version, {LABEL_VERSION_SQL} AS _label_version, {HORIZON}::INTEGER AS _label_horizon_days
  FROM feats JOIN lab USING (customer_id, as_of_date))"""


@query(f"WITH {TRAINING_SQL} SELECT * FROM training")
def training_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _training(spark, sf_dir)


@query(f"""WITH {TRAINING_SQL} SELECT count(*) AS row_count, min(as_of_date) AS as_of_date_min, max(as_of_date) AS as_of_date_max,
  string_agg(DISTINCT _feature_version, ',') AS feature_versions FROM training""")
def snapshot_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.bounds(_training(spark, sf_dir)).withColumn("feature_versions", F.array_join("feature_versions", ","))


@query(f"""WITH {TRAINING_SQL} SELECT as_of_date, CASE WHEN as_of_date = DATE '{AS_OF}' THEN 'validation' ELSE 'train' END AS split,
  count(*) AS row_count, round(avg(churn_label), 9) AS positive_rate FROM training GROUP BY 1""")
def time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = model.with_split(_training(spark, sf_dir), 0.2).groupBy("as_of_date", "split")
    return parts.agg(F.count("*").alias("row_count"), F.round(F.avg("churn_label"), 9).alias("positive_rate"))


@query(f"""WITH {features_sql(DAYS)} SELECT * REPLACE (CAST(recency_days + CASE WHEN CAST(customer_id AS BIGINT) % 2 = 0 THEN 1000 ELSE 0 END AS INTEGER) AS recency_days)
FROM feats WHERE (customer_id, as_of_date) IN (
  SELECT (customer_id, max(as_of_date)) FROM feats WHERE length(customer_id) % 3 <> 0 OR as_of_date < DATE '{AS_OF}' GROUP BY customer_id)""")
def latest_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some customers have two rows of a day: the one that was made later counts."""
    made = _rounded(features.features_over(adapter.clean_silver(spark, sf_dir), DAYS))
    gold = features.stamp(made, GOLD.version, "r1", RUN_TS)
    later = features.stamp(made.filter(F.col("customer_id").cast("long") % 2 == 0), GOLD.version, "r0", RUN_TS + timedelta(hours=1))
    both = gold.unionByName(later.withColumn("recency_days", F.col("recency_days") + 1000))
    partly = both.filter((F.length("customer_id") % 3 != 0) | (F.col("as_of_date") < AS_OF))
    return snapshot.latest_features(partly).select("customer_id", "as_of_date", *features.FEATURES)


@query("SELECT DISTINCT 'v' || length(CAST(o_custkey AS VARCHAR)) AS feature_version FROM orders")
def feature_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = adapter.clean_silver(spark, sf_dir).select(
        F.to_date("order_purchase_ts").alias("as_of_date"), F.concat(F.lit("v"), F.length("customer_id")).alias("_feature_version")
    )
    return snapshot.bounds(gold).select(F.explode("feature_versions").alias("feature_version"))


SCORE = "least(1.0, greatest(0.0, recency_days / 400.0))"


@query(f"""WITH {TRAINING_SQL}, s AS (SELECT {SCORE} AS s, churn_label AS y FROM training WHERE as_of_date = DATE '{AS_OF}'),
steps AS (SELECT s, sum(y) AS tp, count(*) AS n FROM s GROUP BY 1),
run AS (SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn, (SELECT sum(y) FROM s) AS p, (SELECT count(*) FROM s) AS total
  FROM steps WINDOW w AS (ORDER BY s DESC))
SELECT round(sum(tp / p * ctp / cn), 9) AS average_precision, round(sum((n - tp) * (ctp - tp / 2.0) / p / (total - p)), 9) AS roc_auc,
  round((SELECT avg((s - y) * (s - y)) FROM s), 9) AS brier FROM run""")
def model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = _training(spark, sf_dir).filter(F.col("as_of_date") == AS_OF).withColumn("score", F.expr(SCORE).cast("double"))
    return model.ranking_metrics(valid).select(*(F.round(c, 9).alias(c) for c in ("average_precision", "roc_auc", "brier")))


@query(f"WITH {features_sql((AS_OF,))} SELECT customer_id, CAST(CASE WHEN {SCORE} >= 0.5 THEN 1 ELSE 0 END AS INTEGER) AS churn_label FROM feats")
def score_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.features_at(adapter.clean_silver(spark, sf_dir), AS_OF)
    return rows.select("customer_id", label_at(F.expr(SCORE)).alias("churn_label"))


@query("SELECT c_custkey, substr(sha256(c_name), 1, 12) AS customer_hash FROM customer")
def customer_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", identifier_hash(F.col("c_name")).alias("customer_hash"))


FIXED_MODEL = model.LogisticModel(["recency_days", "orders_90d"], [100.0, 1.0], [50.0, 2.0], [0.25, 1.5, -0.5])


@query(f"""WITH {features_sql((AS_OF,))}, asked AS (
  SELECT CASE WHEN c_custkey % 10 = 0 THEN ' ' || c_custkey || ' ' WHEN c_custkey % 10 = 1 THEN '  ' ELSE CAST(c_custkey AS VARCHAR) END AS raw FROM customer
), j AS (SELECT trim(raw) AS id, feats.*, CAST(customer_id AS BIGINT) % 10 = 2 AS old FROM asked LEFT JOIN feats ON trim(raw) = customer_id)
SELECT id AS customer_id, CAST(CASE WHEN id = '' THEN 422 WHEN customer_id IS NULL THEN 404 WHEN old THEN 503 ELSE 200 END AS INTEGER) AS status,
  CASE WHEN NOT old THEN round(1 / (1 + exp(-(0.25 + 1.5 * (recency_days - 100.0) / 50.0 - 0.5 * (orders_90d - 1.0) / 2.0))), 9) END AS churn_probability,
  CAST(CASE WHEN customer_id IS NULL OR old THEN NULL WHEN 0.25 + 1.5 * (recency_days - 100.0) / 50.0 - 0.5 * (orders_90d - 1.0) / 2.0 >= 0
    THEN 1 ELSE 0 END AS INTEGER) AS churn_label FROM j""")
def batch_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    raw = F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit(" "), k, F.lit(" "))).when(F.col("c_custkey") % 10 == 1, "  ").otherwise(k)
    asked = spark.read.parquet(f"{sf_dir}/customer.parquet").select(raw.alias("customer_id"))
    gold = features.stamp(features.features_at(adapter.clean_silver(spark, sf_dir), AS_OF), GOLD.version, "r1", RUN_TS)
    version = F.when(F.col("customer_id").cast("long") % 10 == 2, "an older one").otherwise(F.col("_feature_version"))
    scored = serving.score_requests(asked, gold.withColumn("_feature_version", version), FIXED_MODEL, GOLD.version)
    return scored.select("customer_id", "status", F.round("churn_probability", 9).alias("churn_probability"), "churn_label")


@query()
def train_logreg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted weights and the measures on the last day; the tests hold them against numpy."""
    base = _training(spark, sf_dir).persist()
    try:
        rows = model.with_split(base, 0.34)
        fitted = model.fit_logistic(rows.filter("split = 'train'"))
        measured = model.ranking_metrics(rows.filter("split = 'validation'").withColumn("score", fitted.probability())).head().asDict()
    finally:
        base.unpersist()
    named = {"intercept": fitted.weights[0]} | dict(zip((f"w_{f}" for f in fitted.features), fitted.weights[1:], strict=True)) | measured
    return spark.createDataFrame([(k, float(v)) for k, v in named.items()], "name string, value double")


def _scratch(spark: SparkSession) -> str:
    """A folder of its own in the shared folder that the session names."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or "file://" + tempfile.mkdtemp()
    return f"{shared.rstrip('/')}/tarnbeck-{uuid.uuid4().hex}"


@query(f"""WITH {features_sql(DAYS)} SELECT * FROM feats""")
def table_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The backfill, published day by day through a versioned table; the first day twice."""
    table = stages.gold_table(spark, f"{_scratch(spark)}/gold")
    orders = adapter.clean_silver(spark, sf_dir)
    for d in (DAYS[0], *DAYS):
        table.merge(_rounded(features.features_at(orders, d)))
    return table.read()


@query("SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_orderdate AS DATE) AS order_day FROM orders")
def stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a stream of files, appended batch by batch, and read again."""
    base = _scratch(spark)
    schema = spark.read.parquet(f"{sf_dir}/orders.parquet").schema
    rows = AppendLog(spark, f"{base}/log")
    ingest.available_now(spark, sf_dir, schema, f"{base}/checkpoint", ingest.append_batches(rows), "orders.parquet")
    return rows.read(schema).select("o_orderkey", "o_custkey", "o_orderstatus", F.to_date("o_orderdate").alias("order_day"))


@query(f"""WITH {DIRTY_SQL}, {RANKED_SQL} SELECT order_id, customer_id, strftime(ts, '%Y-%m-%d') AS order_day, order_status FROM ranked WHERE place = 1""")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver as a stream, a file a batch: each is refined and merged by order. The later landings come
    first, so the second batch holds rows that are older than those stored."""
    base = _scratch(spark)
    bronze = adapter.dirty_bronze(spark, sf_dir)
    for run in ("run-1", "run-0"):
        bronze.filter(F.col("run_id") == run).coalesce(1).write.mode("append").parquet(f"{base}/bronze")
    table = VersionedTable(spark, f"{base}/silver", ["order_id"])
    refine = lambda batch: silver.split_orders(batch, ALLOWED).kept
    sink = ingest.upsert_batches(table, refine, silver.newest)
    ingest.available_now(spark, f"{base}/bronze", bronze.schema, f"{base}/checkpoint", sink, files_a_batch=1)
    return table.read().select("order_id", "customer_id", F.date_format("order_purchase_ts", "yyyy-MM-dd").alias("order_day"), "order_status")


def _snapshot_id(spark: SparkSession, sf_dir: str) -> str:
    rows = _training(spark, sf_dir)
    limits = snapshot.bounds(rows).head()
    return data_snapshot_id(
        limits["as_of_date_min"], limits["as_of_date_max"], quality.single_value(rows, "_feature_version"),
        quality.single_value(rows, "_label_version"), quality.single_value(rows, "_label_horizon_days"), schema_digest(rows.schema),
    )


@query(f"""WITH {TRAINING_SQL} SELECT DISTINCT substr(sha256('{{"as_of_date_max":"' || CAST(max(as_of_date) OVER () AS VARCHAR)
  || '","as_of_date_min":"' || CAST(min(as_of_date) OVER () AS VARCHAR) || '","feature_version":"' || _feature_version
  || '","label_horizon_days":"{HORIZON}","label_version":"' || _label_version || '","payload_schema_hash":"' ||
  substr(sha256('customer_id:string|as_of_date:date|recency_days:int|orders_30d:bigint|orders_90d:bigint|lifetime_orders:bigint|customer_tenure_days:int|avg_days_between_orders:double|churn_label:int|_feature_snapshot_id:string|_feature_version:string|_label_version:string|_label_horizon_days:int'), 1, 16)
  || '","version":1}}'), 1, 16) AS data_snapshot_id FROM training""")
def snapshot_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(_snapshot_id(spark, sf_dir),)], "data_snapshot_id string")


@query(f"""SELECT 'success' AS status, (SELECT count(*) FROM orders) AS row_count, 1::INTEGER AS source_file_count, 'orders' AS dataset,
  {_digest_sql('|'.join(f'{n}:string' for n in RAW_COLUMNS))} AS schema_hash, (SELECT count(*) FROM orders) AS bronze_rows
UNION ALL SELECT 'skipped_already_ingested', 0, 1, 'orders', {_digest_sql('|'.join(f'{n}:string' for n in RAW_COLUMNS))}, (SELECT count(*) FROM orders)""")
def ingest_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same raw files ingested twice: what the audit says, and how many rows bronze has."""
    base = _scratch(spark)
    adapter.raw_orders(spark.read.parquet(f"{sf_dir}/orders.parquet")).coalesce(1).write.parquet(f"{base}/raw")
    for run in ("r1", "r2"):
        stages.ingest(spark, f"{base}/raw", f"{base}/bronze", run)
    audit = AppendLog(spark, f"{base}/bronze_audit").read(stages.AUDIT)
    rows = stages.read_bronze(spark, f"{base}/bronze").count()
    return audit.select("status", "row_count", "source_file_count", "dataset", "schema_hash", F.lit(rows).cast("long").alias("bronze_rows"))


@query(f"""WITH {DIRTY_SQL}, {RANKED_SQL}, parts AS (
  SELECT 'preclean_invalid' AS part, order_id, customer_id, ts, order_status FROM plain WHERE NOT coalesce({VALID_SQL}, false)
  UNION ALL SELECT CASE WHEN place = 1 THEN 'published' ELSE 'duplicate_rejects' END, order_id, customer_id, ts, order_status FROM ranked)
SELECT part, order_id, customer_id, strftime(ts, '%Y-%m-%d') AS order_day, order_status FROM parts""")
def silver_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole stage from raw files on: what it publishes and what it sets apart in quarantine."""
    base = _scratch(spark)
    raw = adapter.dirty_bronze(spark, sf_dir).select(*(F.col(c) if c not in adapter.LATER else F.lit(None).cast("string").alias(c) for c in RAW_COLUMNS))
    raw.write.parquet(f"{base}/raw")
    stages.ingest(spark, f"{base}/raw", f"{base}/bronze", "b1")
    stages.refine(spark, f"{base}/bronze", f"{base}/silver", "s1")
    parts = {name: spark.read.parquet(f"{base}/silver_quarantine/s1/{name}") for name in ("preclean_invalid", "duplicate_rejects")}
    parts["published"] = stages.silver_table(spark, f"{base}/silver").read()
    return union_all([
        df.select(F.lit(name).alias("part"), "order_id", "customer_id", F.date_format("order_purchase_ts", "yyyy-MM-dd").alias("order_day"), "order_status")
        for name, df in parts.items()
    ])


@query(f"WITH {TRAINING_SQL} SELECT * FROM training WHERE as_of_date BETWEEN DATE '{DAYS[1]}' AND DATE '{DAYS[1]}' + 10")
def training_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with labels of a range of dates, both ends included."""
    orders = adapter.clean_silver(spark, sf_dir)
    gold = features.stamp(_rounded(features.features_over(orders, DAYS)), GOLD.version, "r1", RUN_TS)
    known = labels.stamp(labels.labels_over(orders, DAYS, HORIZON), HORIZON, "r1", RUN_TS)
    return snapshot.training_rows(gold, known, DAYS[1], "2001-05-10")


@query(f"""WITH {CLEAN_SQL}, last AS (SELECT max(CAST(order_purchase_ts AS DATE)) AS dataset_end FROM silver)
SELECT dataset_end - back AS as_of_date, dataset_end, dataset_end - back + {HORIZON} <= dataset_end AS observable
FROM last, (SELECT unnest([0, 59, 60, 61, 400]) AS back)""")
def observable_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which days' labels can be known: the horizon has to end by the last day of the data."""
    end = labels.dataset_end(adapter.clean_silver(spark, sf_dir))

    def observable(day: date) -> bool:
        try:
            labels.check_observable(end, day, HORIZON)
        except RuntimeError:
            return False
        return True

    days = [end - timedelta(days=back) for back in (0, 59, 60, 61, 400)]
    return spark.createDataFrame([(d, end, observable(d)) for d in days], "as_of_date date, dataset_end date, observable boolean")


@query(f"""SELECT 'model' AS what, {_digest_sql('{"algorithm":"logistic_regression","data_snapshot_id":"d0","feature_version":"f0","label_version":"l0","model_name":"m","random_state":42,"validation_fraction":0.2,"version":2}')} AS digest
UNION ALL SELECT 'labels', {LABEL_VERSION_SQL} UNION ALL SELECT 'features', {GOLD_VERSION_SQL}
UNION ALL SELECT 'files', {_digest_sql('[{"path":"hdfs://far/a.parquet"},{"path":"hdfs://far/b.parquet"}]')}
UNION ALL SELECT 'raw columns', {_digest_sql('|'.join(f'{n}:string' for n in RAW_COLUMNS))}
UNION ALL SELECT 'snapshot of 2001-05-31', substr(sha256('2001-05-31|' || {GOLD_VERSION_SQL}), 1, 16)""")
def lineage_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests that lineage rests on, each computed from its canonical text by the other side."""
    found = {
        "model": model_version("m", "d0", "f0", "l0", 0.2, 42), "labels": label_version(HORIZON), "features": GOLD.version,
        "files": source_fingerprint(["hdfs://far/b.parquet", "hdfs://far/a.parquet"]), "raw columns": BRONZE.schema_hash,
        "snapshot of 2001-05-31": snapshot_id("2001-05-31", GOLD.version),
    }
    return spark.createDataFrame(list(found.items()), "what string, digest string")


@query("""SELECT * FROM (VALUES ('as it should be', ''), ('a column less', 'missing columns'), ('another type', 'is int, not string')) AS t(raw, refused)""")
def raw_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is refused before it is ingested, and why."""
    raw = adapter.raw_orders(spark.read.parquet(f"{sf_dir}/orders.parquet"))
    cases = {"as it should be": raw, "a column less": raw.drop("order_status"), "another type": raw.withColumn("order_id", F.lit(1))}
    out = []
    for name, df in cases.items():
        try:
            BRONZE.check_schema(df.schema)
            out.append((name, ""))
        except ValueError as e:
            known = [x for x in ("missing columns", "is int, not string") if x in str(e)]
            out.append((name, ", ".join(known) or str(e)))
    return spark.createDataFrame(out, "raw string, refused string")
