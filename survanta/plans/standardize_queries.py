"""Queries for standardisation, imputation and stored datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import standardize
from ..sources import store
from .inputs import ORDERS_TTE, orders_tte, spread, table
from .registry import query

RAW = """raw AS (SELECT o_orderkey,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 1000 = 3 THEN '0' ELSE CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-02') AS VARCHAR) END AS tenure,
  CASE WHEN o_orderkey % 89 = 0 THEN NULL WHEN o_orderkey % 83 = 0 THEN 'unknown' WHEN o_orderstatus = 'F' THEN 'Yes' WHEN o_orderstatus = 'O' THEN 'no' ELSE 'No-Event' END AS churn,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 53 = 0 THEN 'bad' ELSE CAST(c_custkey % 1000 AS VARCHAR) END AS balance,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS segment,
  CASE WHEN o_orderkey % 250 = 0 THEN 'x' END AS mostly_empty,
  'SN-' || CAST(o_orderkey AS VARCHAR) AS serial, c_custkey AS cust,
  CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-02') AS VARCHAR) || ' days' AS gap
 FROM orders JOIN customer ON o_custkey = c_custkey),
t AS (SELECT *, TRY_CAST(tenure AS DOUBLE) AS tm,
  CASE WHEN lower(churn) IN ('yes') THEN TRUE WHEN lower(churn) IN ('no', 'no-event') THEN FALSE END AS ev FROM raw),
v AS (SELECT * FROM t WHERE tm IS NOT NULL AND ev IS NOT NULL AND tm >= 0)"""


def raw_upload(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    k = F.col("o_orderkey")
    days = F.datediff(F.lit("2001-08-02").cast("date"), F.col("o_orderdate").cast("date")).cast("string")
    return spread(o.join(c, F.col("o_custkey") == F.col("c_custkey"))).select(
        "o_orderkey", F.col("c_custkey").cast("string").alias("Customer ID"),
        F.when(k % 97 == 0, None).when(k % 1000 == 3, "0").otherwise(days).alias(" Tenure "),
        F.when(k % 89 == 0, None).when(k % 83 == 0, "unknown").when(F.col("o_orderstatus") == "F", "Yes")
        .when(F.col("o_orderstatus") == "O", "no").otherwise("No-Event").alias("Churn"),
        F.when(k % 7 == 0, None).when(k % 53 == 0, "bad").otherwise((F.col("c_custkey") % 1000).cast("string")).alias("Acct Balance"),
        F.when(k % 11 == 0, None).otherwise(F.col("c_mktsegment")).alias("Segment"),
        F.when(k % 250 == 0, "x").alias("mostly_empty"),
        F.concat(F.lit("SN-"), k.cast("string")).alias("serial text"))


@query("standardize_upload", f"""WITH {RAW},
m AS (SELECT quantile_cont(TRY_CAST(balance AS DOUBLE), 0.5) AS med, min(tm) AS lo FROM v),
c AS (SELECT s, CAST(row_number() OVER (ORDER BY s) - 1 AS DOUBLE) AS code FROM (SELECT DISTINCT coalesce(segment, '__missing__') AS s FROM v))
SELECT o_orderkey, tm + CASE WHEN lo = 0 THEN 1 ELSE 0 END AS time, ev AS cens, coalesce(TRY_CAST(balance AS DOUBLE), med) AS acct_balance, code AS segment
FROM v CROSS JOIN m JOIN c ON c.s = coalesce(v.segment, '__missing__')""")
def standardize_upload(spark, sf_dir):
    return standardize.run(raw_upload(spark, sf_dir), row_id="o_orderkey")[0]


@query("standardize_manifest", f"""WITH {RAW}
SELECT count(*) AS rows, CAST(2 AS INT) AS feature_count, 'Tenure' AS time_column, 'Churn' AS event_column,
 (SELECT count(*) FROM t) - count(*) AS dropped_rows, CAST(3 AS INT) AS dropped_feature_count,
 'acct_balance,segment' AS features, 'segment' AS categorical, 'Customer ID,mostly_empty,serial text' AS dropped FROM v""")
def standardize_manifest(spark, sf_dir):
    m = standardize.run(raw_upload(spark, sf_dir), row_id="o_orderkey")[1]
    return m.select("rows", "feature_count", "time_column", "event_column", "dropped_rows", "dropped_feature_count",
                    F.array_join("features", ",").alias("features"), F.array_join("categorical_features", ",").alias("categorical"),
                    F.array_join("dropped_features_sample", ",").alias("dropped"))


@query("coerce_time_durations", f"""WITH {RAW}
SELECT o_orderkey, CAST(regexp_extract(gap, '(\\d+) days', 1) AS DOUBLE) AS time FROM raw""")
def coerce_time_durations(spark, sf_dir):
    df = orders_tte(spark, sf_dir).select(F.col("row_id").alias("o_orderkey"), F.concat(
        F.col("time").cast("long").cast("string"), F.lit(" days")).alias("gap"))
    return df.select("o_orderkey", standardize.coerce_time(df, "gap").alias("time"))


@query("coerce_event_tokens", f"""WITH {RAW}
SELECT o_orderkey, CAST(ev AS INT) AS event FROM t""")
def coerce_event_tokens(spark, sf_dir):
    df = raw_upload(spark, sf_dir)
    return df.select("o_orderkey", standardize.coerce_event(df, "Churn").alias("event"))


@query("norm_key_and_slug", """SELECT p_partkey, regexp_replace(lower(trim(p_brand || ' / ' || p_name)), '[^a-z0-9]+', '', 'g') AS norm_key,
 coalesce(nullif(trim(regexp_replace(lower(trim(p_brand || ' / ' || p_name || '!')), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'dataset') AS slug FROM part""")
def norm_key_and_slug(spark, sf_dir):
    raw = F.concat("p_brand", F.lit(" / "), "p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey", T.norm_key(raw).alias("norm_key"), T.slug(F.concat(raw, F.lit("!"))).alias("slug"))


@query("impute_training_columns", f"""WITH {RAW},
m AS (SELECT quantile_cont(TRY_CAST(balance AS DOUBLE), 0.5) AS med FROM raw),
s AS (SELECT segment AS top FROM raw WHERE segment IS NOT NULL GROUP BY segment ORDER BY count(*) DESC, segment LIMIT 1)
SELECT o_orderkey, coalesce(TRY_CAST(balance AS DOUBLE), med) AS balance, coalesce(segment, top) AS segment FROM raw CROSS JOIN m CROSS JOIN s""")
def impute_training_columns(spark, sf_dir):
    df = raw_upload(spark, sf_dir).select("o_orderkey", F.col("Acct Balance").alias("balance"), F.col("Segment").alias("segment"))
    return standardize.impute_train(df, ["balance", "segment"])


@query("feature_defaults", f"""WITH {RAW}, m AS (SELECT quantile_cont(TRY_CAST(balance AS DOUBLE), 0.5) AS med FROM raw)
SELECT o_orderkey, coalesce(TRY_CAST(balance AS DOUBLE), med) AS balance FROM raw CROSS JOIN m""")
def feature_defaults(spark, sf_dir):
    df = raw_upload(spark, sf_dir).select("o_orderkey", F.col("Acct Balance").alias("balance"))
    return standardize.manual_rows(df, standardize.medians(df, ["balance"]))


@query("dataset_eda", f"""WITH {RAW}
SELECT segment, count(*) AS rows, CAST(2 AS INT) AS features, round(100.0 * count(*) FILTER (WHERE NOT ev) / count(*), 6) AS censored_percent,
 count(*) FILTER (WHERE balance IS NULL) + count(*) FILTER (WHERE mostly_empty IS NULL) AS missing_cells, min(tm) AS time_min, max(tm) AS time_max
FROM v GROUP BY segment""")
def dataset_eda(spark, sf_dir):
    df = raw_upload(spark, sf_dir).toDF("o_orderkey", "cust", "tenure", "churn", "balance", "segment", "mostly_empty", "serial")
    typed = df.withColumns({"time": T.to_number(F.col("tenure")), "cens": standardize.coerce_event(df, "churn") == 1})
    valid, _ = standardize.valid_rows(typed, "time", "cens")
    return standardize.eda(valid, "time", "cens", ["balance", "mostly_empty"], ["segment"]).withColumn(
        "censored_percent", F.round("censored_percent", 6))


@query("stored_dataset_round_trip", f"""WITH {ORDERS_TTE}
SELECT cens, count(*) AS n, CAST(sum(time) AS BIGINT) AS total_time FROM orders_tte GROUP BY cens""")
def stored_dataset_round_trip(spark, sf_dir):
    root = store.scratch(spark)
    standard = orders_tte(spark, sf_dir).select("time", "cens", "price", "acctbal")
    manifest = spark.createDataFrame([(2,)], "feature_count int").withColumn("rows", F.lit(0).cast("long"))
    name = store.write_standard(standard, manifest, root, "orders.csv")
    return store.load_standard(spark, root, name).groupBy("cens").agg(
        F.count(F.lit(1)).alias("n"), F.sum("time").cast("long").alias("total_time"))
