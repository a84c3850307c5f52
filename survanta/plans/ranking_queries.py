"""Queries for metric tables, ranking, recommendation and interval-model summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels
from ..functions.numbers import format_number, format_short, parse_params
from ..operators import metric_tables as mt
from ..operators import piecewise, ranking, recommend
from ..operators.lineage import cut_lineage
from ..operators.tasks import ALL_METRICS, TASKS
from ..sources import store
from .inputs import table
from .registry import query

# Metric tables from line items: dataset = region of the supplier, method built from the
# brand. All metrics are quotients of whole numbers, so both engines agree to the last bit.
METRICS = """src AS (SELECT r_name AS dataset, p_brand AS brand, l_linenumber % 3 AS kind,
  CASE WHEN p_size <= 12 THEN 4 WHEN p_size <= 25 THEN 8 WHEN p_size <= 37 THEN 16 ELSE 32 END AS times,
  CAST(round(l_discount * 100) AS BIGINT) AS disc, CAST(round(l_tax * 100) AS BIGINT) AS tax, CAST(l_quantity AS BIGINT) AS qty,
  l_returnflag AS rf, l_linestatus AS ls, CAST(p_size AS BIGINT) AS size, CAST(l_linenumber AS BIGINT) AS line
 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
 JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
named AS (SELECT *, CASE kind WHEN 0 THEN 'ClassifWrapSA(' || brand || ')'
  WHEN 1 THEN 'PiecewiseClassifWrapSA(' || brand || ', times=' || times || ')'
  ELSE 'PiecewiseCensorAwareClassifWrapSA(' || brand || ', times=' || times || ')' END AS method FROM src),
metric AS (SELECT dataset, method,
  CASE WHEN length(dataset) = 4 AND kind = 0 AND CAST(substr(brand, 7) AS INT) % 5 = 0 THEN NULL ELSE CAST(count(*) FILTER (WHERE rf = 'R') AS DOUBLE) / count(*) END AS auc_event_mean,
  CAST(sum(disc) AS DOUBLE) / count(*) AS logloss_event_mean, CAST(sum(tax) AS DOUBLE) / count(*) AS rmse_event_mean,
  CAST(sum(qty) AS DOUBLE) / count(*) AS rmse_time_mean, CAST(count(*) FILTER (WHERE ls = 'O') AS DOUBLE) / count(*) AS r2_time_mean,
  CASE WHEN dataset = 'ASIA' THEN NULL ELSE CAST(sum(line) AS DOUBLE) / count(*) END AS mape_time_mean, CAST(max(qty) AS DOUBLE) AS medape_time_mean,
  CAST(count(*) FILTER (WHERE rf = 'A') AS DOUBLE) / count(*) AS spearman_time_mean, CAST(min(qty) AS DOUBLE) AS rmsle_time_mean,
  CASE WHEN CAST(substr(brand, 7) AS INT) % 7 = 0 THEN NULL ELSE CAST(count(*) FILTER (WHERE rf = 'N') AS DOUBLE) / count(*) END AS ci_mean,
  CAST(sum(size) AS DOUBLE) / count(*) AS ibs_mean, CAST(max(disc) AS DOUBLE) AS auprc_mean
 FROM named GROUP BY dataset, method, kind, brand)"""
MCOLS = [m.column for m in ALL_METRICS]


def metric_wide(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    src = (t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
           .join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
           .join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
           .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")))
    size, kind = F.col("p_size"), F.col("l_linenumber") % 3
    times = F.when(size <= 12, 4).when(size <= 25, 8).when(size <= 37, 16).otherwise(32)
    method = (F.when(kind == 0, F.format_string("ClassifWrapSA(%s)", "p_brand"))
              .when(kind == 1, labels.build(F.lit("PiecewiseClassifWrapSA"), F.col("p_brand"), times))
              .otherwise(labels.build(F.lit("PiecewiseCensorAwareClassifWrapSA"), F.col("p_brand"), times)))
    n = F.count(F.lit(1))
    share = lambda cond: F.count_if(cond).cast("double") / n
    mean = lambda c: F.sum(c.cast("long")).cast("double") / n
    rf, qty, disc = F.col("l_returnflag"), F.col("l_quantity").cast("long"), F.round(F.col("l_discount") * 100).cast("long")
    brand = F.substring("brand", 7, 9).cast("int")
    agg = src.groupBy(F.col("r_name").alias("dataset"), method.alias("method"), kind.alias("kind"), F.col("p_brand").alias("brand")).agg(
        share(rf == "R").alias("auc_event_mean"), mean(disc).alias("logloss_event_mean"),
        mean(F.round(F.col("l_tax") * 100)).alias("rmse_event_mean"), mean(qty).alias("rmse_time_mean"),
        share(F.col("l_linestatus") == "O").alias("r2_time_mean"), mean(F.col("l_linenumber")).alias("mape_time_mean"),
        F.max(qty).cast("double").alias("medape_time_mean"), share(rf == "A").alias("spearman_time_mean"),
        F.min(qty).cast("double").alias("rmsle_time_mean"), share(rf == "N").alias("ci_mean"),
        mean(size).alias("ibs_mean"), F.max(disc).cast("double").alias("auprc_mean"))
    holes = {"auc_event_mean": (F.length("dataset") == 4) & (F.col("kind") == 0) & (brand % 5 == 0),
             "mape_time_mean": F.col("dataset") == "ASIA", "ci_mean": brand % 7 == 0}
    out = agg.withColumns({c: F.when(~hole, F.col(c)) for c, hole in holes.items()}).select("dataset", "method", *MCOLS)
    return cut_lineage(out)  # a metric table is a stored result; the queries below read it many times


def _score_sql(task, name="scored", src="metric", by="dataset"):
    ms = TASKS[task].metrics
    stats = ", ".join(f"min({m.column}) OVER (PARTITION BY {by}) AS lo{i}, max({m.column}) OVER (PARTITION BY {by}) AS hi{i}" for i, m in enumerate(ms))
    nrm = ", ".join(f"CASE WHEN {m.column} IS NULL THEN NULL WHEN lo{i} = hi{i} THEN 1.0 ELSE " + (
        f"({m.column} - lo{i})" if m.direction == "higher" else f"(hi{i} - {m.column})") + f" / (hi{i} - lo{i}) END AS n{i}" for i, m in enumerate(ms))
    got = " + ".join(f"coalesce(n{i}, 0.0) * {m.weight}::DOUBLE" for i, m in enumerate(ms))
    have = " + ".join(f"CASE WHEN n{i} IS NOT NULL THEN {m.weight}::DOUBLE ELSE 0.0::DOUBLE END" for i, m in enumerate(ms))
    full = " + ".join(f"CASE WHEN lo{i} IS NOT NULL THEN {m.weight}::DOUBLE ELSE 0.0::DOUBLE END" for i, m in enumerate(ms))
    return f"""{name}_s AS (SELECT *, {stats} FROM {src}), {name}_n AS (SELECT *, {nrm} FROM {name}_s),
{name} AS (SELECT *, coalesce(({got}) / nullif({have}, 0), 0) * (0.8::DOUBLE + 0.2::DOUBLE * coalesce(({have}) / nullif({full}, 0), 0)) AS score FROM {name}_n)"""


PIECE = f"""{_score_sql("classification")},
parsed AS (SELECT *, regexp_extract(method, '^(Piecewise(?:CensorAware)?ClassifWrapSA)\\(([^,]+),\\s*times=(\\d+)\\)$', 1) AS family,
 regexp_extract(method, '^(Piecewise(?:CensorAware)?ClassifWrapSA)\\(([^,]+),\\s*times=(\\d+)\\)$', 2) AS base_model,
 TRY_CAST(regexp_extract(method, 'times=(\\d+)\\)$', 1) AS INT) AS times FROM scored WHERE method LIKE 'Piecewise%'),
per AS (SELECT family, base_model, times, avg(score) AS mean, count(*) AS n FROM parsed GROUP BY family, base_model, times),
seen AS (SELECT family, base_model, count(DISTINCT dataset) AS a FROM parsed GROUP BY family, base_model),
pick AS (SELECT family, base_model, times, row_number() OVER (PARTITION BY family, base_model ORDER BY (n = a) DESC, round(mean, 12) DESC, n DESC, times) AS rn
 FROM per JOIN seen USING (family, base_model)),
chosen AS (SELECT family, base_model, times FROM pick WHERE rn = 1)"""

PAIRS = f"""{PIECE},
base AS (SELECT *, regexp_extract(method, '^ClassifWrapSA\\((.+)\\)$', 1) AS base_model FROM scored WHERE method LIKE 'ClassifWrapSA(%'),
pairs AS (SELECT p.dataset, p.family, p.base_model, p.times, p.method, b.score * 100 AS base_score, p.score * 100 AS piece_score,
  p.score * 100 - b.score * 100 AS delta_score, b.auc_event_mean AS base_auc, p.auc_event_mean AS piece_auc,
  b.logloss_event_mean AS base_logloss, p.logloss_event_mean AS piece_logloss
 FROM parsed p JOIN chosen USING (family, base_model, times) JOIN base b ON b.dataset = p.dataset AND b.base_model = p.base_model)"""


def _rank_sql():
    parts = []
    for task, cfg in TASKS.items():
        for m in cfg.metrics:
            way = "DESC" if m.direction == "higher" else "ASC"
            c = m.column
            parts.append(f"SELECT dataset, method, '{task}' AS task, '{c[:-5]}' AS metric, {c} AS value, "
                         f"rank() OVER (PARTITION BY dataset ORDER BY {c} {way} NULLS LAST) + (count(*) OVER (PARTITION BY dataset, {c}) - 1) / 2.0 AS rank, "
                         f"count({c}) OVER (PARTITION BY dataset) AS have FROM metric")
    return "ranks AS (SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE have > 0)"


BLOCKS_SQL = f"""{_rank_sql()},
sums AS (SELECT dataset, method, task, sum(rank) AS rs FROM ranks GROUP BY dataset, method, task
 UNION ALL SELECT dataset, method, 'overall', sum(rank) FROM ranks GROUP BY dataset, method),
pos AS (SELECT *, row_number() OVER (PARTITION BY dataset, task ORDER BY rs, method) AS p FROM sums)"""


@query("metric_table", f"WITH {METRICS} SELECT * FROM metric")
def metric_table(spark, sf_dir):
    return metric_wide(spark, sf_dir)


@query("metric_ranks", f"WITH {METRICS}, {_rank_sql()} SELECT dataset, method, metric, value, rank FROM ranks")
def metric_ranks(spark, sf_dir):
    return ranking.metric_ranks(metric_wide(spark, sf_dir))


@query("dataset_rank_blocks", f"""WITH {METRICS}, {BLOCKS_SQL}
SELECT dataset, method, max(CASE WHEN task = 'classification' THEN rs END) AS classification_rank_sum, max(CASE WHEN task = 'classification' THEN p END) AS classification_position,
 max(CASE WHEN task = 'regression' THEN rs END) AS regression_rank_sum, max(CASE WHEN task = 'regression' THEN p END) AS regression_position,
 max(CASE WHEN task = 'survival' THEN rs END) AS survival_rank_sum, max(CASE WHEN task = 'survival' THEN p END) AS survival_position,
 max(CASE WHEN task = 'overall' THEN rs END) AS overall_rank_sum, max(CASE WHEN task = 'overall' THEN p END) AS overall_position FROM pos GROUP BY dataset, method""")
def dataset_rank_blocks(spark, sf_dir):
    t = ranking.blocks(metric_wide(spark, sf_dir))
    return t.select("dataset", "method", *[f"{b}_{x}" for b in ("classification", "regression", "survival", "overall") for x in ("rank_sum", "position")])


@query("leaderboard_task", f"""WITH {METRICS}, {BLOCKS_SQL},
g AS (SELECT upper(task) AS task, method, count(DISTINCT dataset) AS datasets, avg(rs) AS a, avg(p) AS b FROM pos WHERE task <> 'overall' GROUP BY task, method)
SELECT task, method, datasets, round(a, 9) AS avg_ranksum, round(b, 9) AS avg_position,
 row_number() OVER (PARTITION BY task ORDER BY a, b, method) AS overall_position FROM g""")
def leaderboard_task(spark, sf_dir):
    t = ranking.blocks(metric_wide(spark, sf_dir))
    out = None
    for task in TASKS:
        one = ranking.overall(t, task)
        out = one if out is None else out.unionByName(one)
    return out.withColumns({"avg_ranksum": F.round("avg_ranksum", 9), "avg_position": F.round("avg_position", 9)})


ALL_SQL = f"""{BLOCKS_SQL},
med AS (SELECT method, task, median(p) AS m FROM pos WHERE task <> 'overall' GROUP BY method, task),
mm AS (SELECT method, sum(m) / count(m) AS mean_task_median FROM med GROUP BY method),
ds AS (SELECT method, count(DISTINCT dataset) AS datasets FROM pos GROUP BY method)"""


@query("leaderboard_all", f"""WITH {METRICS}, {ALL_SQL}
SELECT 'ALL' AS task, method, datasets, round(mean_task_median, 9) AS mean_task_median, row_number() OVER (ORDER BY round(mean_task_median, 9), method) AS overall_position
FROM mm JOIN ds USING (method)""")
def leaderboard_all(spark, sf_dir):
    t = ranking.overall_all(ranking.blocks(metric_wide(spark, sf_dir)))
    return t.select("task", "method", "datasets", F.round("mean_task_median", 9).alias("mean_task_median"), "overall_position")


@query("leaderboard_stored", f"""WITH {METRICS}, {ALL_SQL},
l AS (SELECT method, datasets, mean_task_median AS v, row_number() OVER (ORDER BY round(mean_task_median, 9), method) AS position FROM mm JOIN ds USING (method))
SELECT CAST(position AS INT) AS position, method, 'Все задачи' AS task, CAST(datasets AS INT) AS datasets,
 CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE regexp_replace(regexp_replace(printf('%.2f', v), '0+$', ''), '\\.$', '') END AS avg_rank_sum, position <= 3 AS is_top_three FROM l""")
def leaderboard_stored(spark, sf_dir):
    root = store.scratch(spark)
    t = ranking.overall_all(ranking.blocks(metric_wide(spark, sf_dir)))
    store.write_tables({"overall_all": t}, root)
    return store.read_leaderboard(spark, root).drop("avg_position")


@query("leaderboard_chunks", f"""WITH {METRICS}, {BLOCKS_SQL},
g AS (SELECT upper(task) AS task, method, count(DISTINCT dataset) AS datasets, avg(rs) AS a, avg(p) AS b FROM pos WHERE task <> 'overall' GROUP BY task, method),
r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY a, b, method) AS n, count(*) OVER (PARTITION BY task) AS c FROM g)
SELECT 'tables/leaderboard' AS source, 'Таблица ' || task AS title, 'Сводная таблица рангов leaderboard, лист ' || task || '.' || chr(10) || 'Строк: ' || max(c) || '. Колонки: method, datasets, overall_position.' || chr(10)
 || 'method,datasets,overall_position' || chr(10) || string_agg(method || ',' || datasets || ',' || n, chr(10) ORDER BY n) || chr(10) AS text FROM r WHERE n <= 16 GROUP BY task""")
def leaderboard_chunks(spark, sf_dir):
    t = ranking.blocks(metric_wide(spark, sf_dir))
    boards = [ranking.overall(t, task) for task in TASKS]
    every = boards[0]
    for b in boards[1:]:
        every = every.unionByName(b)
    return mt.board_text(every, "leaderboard", ["method", "datasets", "overall_position"])


@query("rank_diagnostics", f"""WITH {METRICS}
SELECT dataset, count(*) AS rows, 'ok' AS status,
 concat_ws(', ', CASE WHEN count(rmse_time_mean) > 0 THEN 'RMSE_TIME_mean' END, CASE WHEN count(r2_time_mean) > 0 THEN 'R2_TIME_mean' END, CASE WHEN count(mape_time_mean) > 0 THEN 'MAPE_TIME_mean' END,
  CASE WHEN count(medape_time_mean) > 0 THEN 'MEDAPE_TIME_mean' END, CASE WHEN count(spearman_time_mean) > 0 THEN 'SPEARMAN_TIME_mean' END, CASE WHEN count(rmsle_time_mean) > 0 THEN 'RMSLE_TIME_mean' END) AS regression_present,
 CASE WHEN count(mape_time_mean) = 0 THEN 'MAPE_TIME_mean' ELSE '' END AS regression_missing,
 count(*) FILTER (WHERE method LIKE 'Piecewise%') AS piecewise_rows, count(DISTINCT method) FILTER (WHERE method LIKE 'Piecewise%') AS piecewise_methods FROM metric GROUP BY dataset""")
def rank_diagnostics(spark, sf_dir):
    df = metric_wide(spark, sf_dir)
    d = ranking.diagnostics(df, df.where(F.col("method").startswith("Piecewise")))
    return d.select("dataset", "rows", "status", "regression_present", "regression_missing", "piecewise_rows", "piecewise_methods")


@query("method_scores", f"""WITH {METRICS}, {_score_sql("survival")} SELECT dataset, method, round(score, 9) AS score FROM scored""")
def method_scores(spark, sf_dir):
    return recommend.score(metric_wide(spark, sf_dir), TASKS["survival"].metrics).select(
        "dataset", "method", F.round("score", 9).alias("score"))


@query("metric_min_max", f"""WITH {METRICS}, {_score_sql("regression")} SELECT dataset, method, round(n0, 9) AS rmse_time_norm, round(n1, 9) AS r2_time_norm, round(n2, 9) AS mape_time_norm FROM scored""")
def metric_min_max(spark, sf_dir):
    out = recommend.normalize(metric_wide(spark, sf_dir), TASKS["regression"].metrics)
    return out.select("dataset", "method", *[F.round(c, 9).alias(c) for c in ("rmse_time_norm", "r2_time_norm", "mape_time_norm")])


@query("metric_positions", f"""WITH {METRICS}
SELECT dataset, method, 'CI' AS metric, CASE WHEN count(ci_mean) OVER (PARTITION BY dataset) > 0 THEN rank() OVER (PARTITION BY dataset ORDER BY ci_mean DESC NULLS LAST) END AS position, count(ci_mean) OVER (PARTITION BY dataset) AS total FROM metric
UNION ALL SELECT dataset, method, 'IBS', rank() OVER (PARTITION BY dataset ORDER BY ibs_mean NULLS LAST), count(ibs_mean) OVER (PARTITION BY dataset) FROM metric""")
def metric_positions(spark, sf_dir):
    ms = [m for m in TASKS["survival"].metrics if m.key != "AUPRC"]
    return recommend.positions(metric_wide(spark, sf_dir), ms).select("dataset", "method", "metric", "position", "total")


@query("top_models", f"""WITH {METRICS}, {_score_sql("regression")},
r AS (SELECT dataset, method, score, row_number() OVER (PARTITION BY dataset ORDER BY score DESC, method) AS place FROM scored)
SELECT dataset, method, CAST(place AS INT) AS place, round(score, 9) AS score FROM r WHERE place <= 3""")
def top_models(spark, sf_dir):
    s = recommend.score(metric_wide(spark, sf_dir), TASKS["regression"].metrics)
    return recommend.top(s).select("dataset", "method", "place", F.round("score", 9).alias("score"))


@query("recommendation", f"""WITH {METRICS}, {PIECE},
cand AS (SELECT m.* FROM metric m WHERE method LIKE 'ClassifWrapSA%' UNION ALL
 SELECT m.* FROM metric m JOIN parsed p ON p.dataset = m.dataset AND p.method = m.method JOIN chosen c ON c.family = p.family AND c.base_model = p.base_model AND c.times = p.times),
{_score_sql("classification", "final", "cand")},
r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY score DESC, method) AS place, rank() OVER (PARTITION BY dataset ORDER BY auc_event_mean DESC NULLS LAST) AS p1 FROM final)
SELECT dataset, 'classification' AS task, method AS recommended_method, CAST(round_even(score * 100, 0) AS INT) AS score, 'AUC_EVENT,LOGLOSS_EVENT,RMSE_EVENT' AS available FROM r WHERE place = 1""")
def recommendation(spark, sf_dir):
    df = metric_wide(spark, sf_dir)
    base = df.where(F.col("method").startswith("ClassifWrapSA"))
    extra = piecewise.extract(df, piecewise.global_times(df))
    out = recommend.run(base, "classification", extra)
    return out.select("dataset", "task", "recommended_method", "score", F.array_join("available", ",").alias("available"))


@query("recommendation_facts", f"""WITH {METRICS}, {_score_sql("survival")},
r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY score DESC, method) AS place,
 rank() OVER (PARTITION BY dataset ORDER BY ci_mean DESC NULLS LAST) AS r0, rank() OVER (PARTITION BY dataset ORDER BY ibs_mean NULLS LAST) AS r1, rank() OVER (PARTITION BY dataset ORDER BY auprc_mean DESC NULLS LAST) AS r2,
 count(ci_mean) OVER (PARTITION BY dataset) AS t0, count(*) OVER (PARTITION BY dataset) AS t FROM scored)
SELECT dataset, concat_ws(chr(10), 'Датасет: ' || dataset, 'Задача: Анализ выживаемости', 'Рекомендованная модель: ' || method, 'Итоговая оценка: ' || CAST(round_even(score * 100, 0) AS INT) || '/100') AS head,
 CAST(CASE WHEN r0 <= 3 THEN 1 ELSE 0 END + CASE WHEN r1 <= 3 THEN 1 ELSE 0 END + CASE WHEN r2 <= 3 THEN 1 ELSE 0 END AS INT) AS strong,
 'позиция ' || r1 || ' из ' || t AS ibs_place FROM r WHERE place = 1""")
def recommendation_facts(spark, sf_dir):
    advice = recommend.run(metric_wide(spark, sf_dir), "survival")
    text = recommend.facts(advice)
    first = F.get("top_models", F.lit(0))["metrics"]
    place = F.regexp_extract(F.get(F.filter(first, lambda m: m.startswith("IBS")), F.lit(0)), r"(позиция \d+ из \d+)", 1)
    strong = F.size(F.filter(first, lambda m: F.regexp_extract(m, r"позиция (\d+) из", 1).cast("int") <= 3))
    head = F.array_join(F.slice(F.split("text", "\n"), 1, 4), "\n")
    return advice.join(text.select("dataset", head.alias("head")), "dataset").select(
        "dataset", "head", strong.alias("strong"), place.alias("ibs_place"))


@query("best_candidate", f"""WITH {METRICS}, {_score_sql("survival", "a", "(SELECT * FROM metric WHERE method LIKE 'ClassifWrapSA(Brand#1%')")},
{_score_sql("classification", "b", "(SELECT * FROM metric WHERE method LIKE 'PiecewiseClassifWrapSA%')")},
{_score_sql("classification", "c", "(SELECT * FROM metric WHERE method LIKE 'PiecewiseCensorAware%')")},
u AS (SELECT dataset, 'survival' AS category, 'survival' AS task, method, score, 2 AS o FROM a UNION ALL SELECT dataset, 'piecewiseclassifwrapsa', 'classification', method, score, 3 FROM b
 UNION ALL SELECT dataset, 'piecewisecensorawareclassifwrapsa', 'classification', method, score, 4 FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY score DESC, o, method) AS rn FROM u)
SELECT dataset, category, task, method, round(score, 9) AS score FROM r WHERE rn = 1""")
def best_candidate(spark, sf_dir):
    df = metric_wide(spark, sf_dir)
    tasks = df.where(F.col("method").like("ClassifWrapSA(Brand#1%")).select("method", F.lit("survival").alias("task")).distinct()
    return recommend.best_candidate(df, tasks, df).withColumn("score", F.round("score", 9))


@query("label_parsing", f"""WITH {METRICS}
SELECT DISTINCT method, nullif(regexp_extract(method, '^(Piecewise(?:CensorAware)?ClassifWrapSA)\\(([^,]+),\\s*times=(\\d+)\\)$', 1), '') AS family,
 nullif(regexp_extract(method, '^(Piecewise(?:CensorAware)?ClassifWrapSA)\\(([^,]+),\\s*times=(\\d+)\\)$', 2), '') AS base_model,
 TRY_CAST(nullif(regexp_extract(method, 'times=(\\d+)\\)$', 1), '') AS INT) AS times, nullif(regexp_extract(method, '^ClassifWrapSA\\((.+)\\)$', 1), '') AS plain_base,
 CASE WHEN method LIKE 'PiecewiseC%A%(%' AND method LIKE 'PiecewiseCensor%' THEN 'Censor-aware, ' || regexp_extract(method, '(times=\\d+)', 1) WHEN method LIKE 'Piecewise%' THEN 'Piecewise, ' || regexp_extract(method, '(times=\\d+)', 1) ELSE method END AS display FROM metric""")
def label_parsing(spark, sf_dir):
    m = metric_wide(spark, sf_dir).select("method").distinct()
    return m.select("method", labels.parse(F.col("method")).alias("p"), labels.base_of(F.col("method")).alias("plain_base"),
                    labels.variant(F.col("method")).alias("display")).select("method", "p.*", "plain_base", "display")


@query("global_times", f"WITH {METRICS}, {PIECE} SELECT * FROM chosen")
def global_times(spark, sf_dir):
    return piecewise.global_times(metric_wide(spark, sf_dir))


@query("piecewise_extract", f"""WITH {METRICS}, {PIECE} SELECT p.dataset, p.method, p.auc_event_mean FROM parsed p JOIN chosen USING (family, base_model, times)""")
def piecewise_extract(spark, sf_dir):
    df = metric_wide(spark, sf_dir)
    return piecewise.extract(df, piecewise.global_times(df)).select("dataset", "method", "auc_event_mean")


@query("piecewise_best_rows", f"""WITH {METRICS}, {PIECE},
k AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY auc_event_mean DESC NULLS LAST) + (count(*) OVER (PARTITION BY dataset, auc_event_mean) - 1) / 2.0
 + rank() OVER (PARTITION BY dataset ORDER BY logloss_event_mean NULLS LAST) + (count(*) OVER (PARTITION BY dataset, logloss_event_mean) - 1) / 2.0
 + rank() OVER (PARTITION BY dataset ORDER BY rmse_event_mean NULLS LAST) + (count(*) OVER (PARTITION BY dataset, rmse_event_mean) - 1) / 2.0 AS rs FROM parsed),
f AS (SELECT *, row_number() OVER (PARTITION BY dataset, family, base_model ORDER BY rs, times) AS rn FROM k)
SELECT dataset, method FROM f WHERE rn = 1""")
def piecewise_best_rows(spark, sf_dir):
    return piecewise.extract(metric_wide(spark, sf_dir)).select("dataset", "method")


@query("piecewise_variants", f"""WITH {METRICS}, {PIECE},
w AS (SELECT DISTINCT d.dataset, p.family, p.base_model FROM (SELECT DISTINCT dataset FROM metric) d CROSS JOIN (SELECT DISTINCT family, base_model FROM parsed) p)
SELECT w.dataset, w.family, w.base_model, w.family || '(' || w.base_model || ', times=' || c.times || ')' AS method, m.method IS NOT NULL AS precomputed
FROM w JOIN chosen c USING (family, base_model) LEFT JOIN metric m ON m.dataset = w.dataset AND m.method = w.family || '(' || w.base_model || ', times=' || c.times || ')'""")
def piecewise_variants(spark, sf_dir):
    df = metric_wide(spark, sf_dir)
    named = piecewise.parsed(df)
    # Every dataset asks for every family and model that occurs anywhere.
    wanted = df.select("dataset").distinct().join(named.select("family", "base_model").distinct())
    return piecewise.variant_labels(df, wanted, default_times=8)


@query("piecewise_pairs", f"""WITH {METRICS}, {PAIRS}
SELECT dataset, family, base_model, times, round(base_score, 7) AS base_score, round(piece_score, 7) AS piece_score, round(delta_score, 7) AS delta_score FROM pairs""")
def piecewise_pairs(spark, sf_dir):
    p = piecewise.pairs(metric_wide(spark, sf_dir))
    return p.select("dataset", "family", "base_model", "times", *[F.round(c, 7).alias(c) for c in ("base_score", "piece_score", "delta_score")])


@query("piecewise_summary", f"""WITH {METRICS}, {PAIRS}
SELECT family, base_model, count(DISTINCT dataset) AS datasets, round(avg(base_score), 7) AS base_score, round(avg(piece_score), 7) AS piecewise_score,
 round(avg(delta_score), 7) AS delta_score, round(avg(CASE WHEN delta_score > 0 THEN 1.0 ELSE 0.0 END) * 100, 7) AS win_rate,
 list_aggregate(list_sort(list(DISTINCT times)), 'string_agg', ', ') AS best_times FROM pairs GROUP BY family, base_model""")
def piecewise_summary(spark, sf_dir):
    s = piecewise.summary(piecewise.pairs(metric_wide(spark, sf_dir)))
    return s.withColumns({c: F.round(c, 7) for c in ("base_score", "piecewise_score", "delta_score", "win_rate")})


@query("piecewise_cards", f"""WITH {METRICS}, {PAIRS}
SELECT round(avg(CASE WHEN base_model = 'Brand#12' THEN delta_score END), 7) AS model_gain, round(avg(CASE WHEN base_model = 'Brand#12' THEN CASE WHEN delta_score > 0 THEN 1.0 ELSE 0.0 END END) * 100, 7) AS model_win_rate,
 arg_max(dataset, delta_score) AS best_dataset, arg_max(base_model, delta_score) AS best_model, arg_max(times, delta_score) AS best_times, round(max(delta_score), 7) AS best_gain,
 count(*) FILTER (WHERE delta_score > 0) AS improved, count(*) AS pairs FROM pairs""")
def piecewise_cards(spark, sf_dir):
    c = piecewise.cards(piecewise.pairs(metric_wide(spark, sf_dir)), "Brand#12")
    return c.withColumns({k: F.round(k, 7) for k in ("model_gain", "model_win_rate", "best_gain")})


@query("piecewise_details", f"""WITH {METRICS}, {PAIRS}
SELECT dataset, family, times, round(delta_score, 7) AS delta_score, round((piece_auc - base_auc) * 100, 7) AS auc_delta,
 round((base_logloss - piece_logloss) / abs(base_logloss) * 100, 7) AS logloss_reduction FROM pairs WHERE base_model = 'Brand#12'""")
def piecewise_details(spark, sf_dir):
    d = piecewise.details(piecewise.pairs(metric_wide(spark, sf_dir)), "Brand#12")
    return d.select("dataset", "family", "times", *[F.round(c, 7).alias(c) for c in ("delta_score", "auc_delta", "logloss_reduction")])


WANTED = """wanted AS (SELECT DISTINCT m.dataset, '  ' || upper(m2.method) AS method, k.metric FROM metric m
 JOIN metric m2 ON m2.method LIKE 'ClassifWrapSA%' CROSS JOIN (VALUES ('CI'), ('Mape_time'), ('RMSE_EVENT')) k(metric))"""


def wanted(spark, sf_dir, df):
    names = df.where(F.col("method").startswith("ClassifWrapSA")).select(
        F.concat(F.lit("  "), F.upper("method")).alias("method")).distinct()
    keys = F.explode(F.array(F.lit("CI"), F.lit("Mape_time"), F.lit("RMSE_EVENT"))).alias("metric")
    return df.select("dataset").distinct().join(names).select("dataset", "method", keys)


@query("metric_lookup", f"""WITH {METRICS}, {WANTED}
SELECT w.dataset, w.method, lower(w.metric) AS metric, CASE lower(w.metric) WHEN 'ci' THEN ci_mean WHEN 'mape_time' THEN mape_time_mean ELSE rmse_event_mean END AS value
FROM wanted w LEFT JOIN metric m ON m.dataset = w.dataset AND lower(trim(m.method)) = lower(trim(w.method))""")
def metric_lookup(spark, sf_dir):
    df = metric_wide(spark, sf_dir)
    return mt.lookup(df, wanted(spark, sf_dir, df))


@query("metric_missing", f"""WITH {METRICS}, {WANTED}
SELECT w.dataset, w.method, lower(w.metric) AS metric FROM wanted w LEFT JOIN metric m ON m.dataset = w.dataset AND lower(trim(m.method)) = lower(trim(w.method))
WHERE CASE lower(w.metric) WHEN 'ci' THEN ci_mean WHEN 'mape_time' THEN mape_time_mean ELSE rmse_event_mean END IS NULL""")
def metric_missing(spark, sf_dir):
    df = metric_wide(spark, sf_dir)
    return mt.missing(df, wanted(spark, sf_dir, df))


@query("metric_upsert", f"""WITH {METRICS}
SELECT dataset, method, coalesce(ci_mean, 0.5) AS ci_mean, coalesce(mape_time_mean, 9.0) AS mape_time_mean FROM metric
UNION ALL SELECT DISTINCT dataset, 'NewModel', 0.5, 9.0 FROM metric""")
def metric_upsert(spark, sf_dir):
    df = metric_wide(spark, sf_dir).select("dataset", "method", "ci_mean", "mape_time_mean")
    cells = {"ci_mean": F.lit(0.5), "mape_time_mean": F.lit(9.0)}
    fresh = df.withColumns(cells).unionByName(
        df.select("dataset", F.lit("NewModel").alias("method")).distinct().withColumns(cells))
    return mt.upsert(df, fresh)


@query("metric_get_or_compute", f"""WITH {METRICS}
SELECT dataset, method, coalesce(ci_mean, 0.25) AS ci_mean FROM metric""")
def metric_get_or_compute(spark, sf_dir):
    df = metric_wide(spark, sf_dir).select("dataset", "method", "ci_mean")
    ask = df.select("dataset", "method", F.lit("CI").alias("metric"))
    compute = lambda gaps: gaps.select("dataset", "method", F.lit(0.25).alias("ci_mean"))
    return mt.get_or_compute(df, ask, compute)


@query("metric_names", f"""WITH {METRICS}, u AS (UNPIVOT metric ON COLUMNS(* EXCLUDE (dataset, method)) INTO NAME metric VALUE value)
SELECT DISTINCT dataset, replace(metric, '_mean', '') AS metric FROM u WHERE value IS NOT NULL""")
def metric_names(spark, sf_dir):
    df = metric_wide(spark, sf_dir)
    p = F.col("method").startswith("Piecewise")
    return mt.available_metrics(df.where(~p), df.where(p))


@query("metric_active", f"""WITH {METRICS}
SELECT dataset, CASE WHEN count(mape_time_mean) > 0 THEN 'RMSE_TIME,R2_TIME,MAPE_TIME,MEDAPE_TIME,SPEARMAN_TIME,RMSLE_TIME' ELSE 'RMSE_TIME,R2_TIME,MEDAPE_TIME,SPEARMAN_TIME,RMSLE_TIME' END AS available,
 CASE WHEN count(mape_time_mean) > 0 THEN '' ELSE 'MAPE_TIME' END AS missing FROM metric GROUP BY dataset""")
def metric_active(spark, sf_dir):
    a = mt.active_metrics(metric_wide(spark, sf_dir), TASKS["regression"].metrics)
    return a.select("dataset", F.array_join("available", ",").alias("available"), F.array_join("missing", ",").alias("missing"))


@query("metric_row_filter", f"""WITH {METRICS}, g AS (SELECT dataset, count(mape_time_mean) > 0 OR count(ci_mean) > 0 AS a FROM metric GROUP BY dataset)
SELECT dataset, method FROM metric JOIN g USING (dataset) WHERE NOT a OR mape_time_mean IS NOT NULL OR ci_mean IS NOT NULL""")
def metric_row_filter(spark, sf_dir):
    ms = [m for m in ALL_METRICS if m.key in ("MAPE_TIME", "CI")]
    return mt.rows_with_metrics(metric_wide(spark, sf_dir), ms).select("dataset", "method")


@query("metric_union_keep_last", f"""WITH {METRICS}
SELECT dataset, method, CASE WHEN method LIKE 'Piecewise%' THEN rmse_event_mean + 1 ELSE rmse_event_mean END AS rmse_event_mean, CASE WHEN method LIKE 'Piecewise%' THEN 'new' END AS note FROM metric""")
def metric_union_keep_last(spark, sf_dir):
    df = metric_wide(spark, sf_dir).select("dataset", "method", "rmse_event_mean")
    later = df.where(F.col("method").startswith("Piecewise")).withColumns(
        {"rmse_event_mean": F.col("rmse_event_mean") + 1, "note": F.lit("new")})
    both = df.withColumn("_o", F.lit(0)).unionByName(later.withColumn("_o", F.lit(1)), allowMissingColumns=True)
    return mt.keep_last(both, ["dataset", "method"], "_o").drop("_o")


@query("metric_allow_list", f"""WITH {METRICS} SELECT dataset, method, lower(method) AS method_norm FROM metric WHERE method IN (SELECT 'ClassifWrapSA(' || p_brand || ')' FROM part WHERE p_size > 40)""")
def metric_allow_list(spark, sf_dir):
    allowed = table(spark, sf_dir, "part").where("p_size > 40").select(
        F.format_string("ClassifWrapSA(%s)", "p_brand").alias("method")).distinct()
    return mt.normalize_methods(metric_wide(spark, sf_dir), allowed).select("dataset", "method", "method_norm")


@query("metric_comparison_points", f"""WITH {METRICS}, s AS (SELECT DISTINCT d.dataset, p.method FROM (SELECT DISTINCT dataset FROM metric) d CROSS JOIN (SELECT DISTINCT method FROM metric) p)
SELECT s.dataset, s.method, m.mape_time_mean AS x, m.ci_mean AS y, m.method IS NOT NULL AS has_row,
 concat_ws(', ', CASE WHEN m.mape_time_mean IS NULL THEN 'MAPE_TIME' END, CASE WHEN m.ci_mean IS NULL THEN 'CI' END) AS missing FROM s LEFT JOIN metric m ON m.dataset = s.dataset AND m.method = s.method""")
def metric_comparison_points(spark, sf_dir):
    df = metric_wide(spark, sf_dir)
    chosen = df.select("dataset").distinct().join(df.select("method").distinct())
    return mt.comparison_points(df, chosen, "MAPE_TIME", "CI")


@query("metric_long_and_back", f"""WITH {METRICS} SELECT dataset, method, ci_mean, ibs_mean FROM metric""")
def metric_long_and_back(spark, sf_dir):
    long = mt.long_form(metric_wide(spark, sf_dir))
    return mt.wide_form(long, ["ci", "ibs"])


@query("metric_ensure_columns", f"""WITH {METRICS} SELECT dataset, method, ci_mean, CAST(NULL AS DOUBLE) AS extra_mean FROM metric""")
def metric_ensure_columns(spark, sf_dir):
    return mt.ensure_columns(metric_wide(spark, sf_dir).select("dataset", "method", "ci_mean"), ["extra_mean", "ci_mean"])


@query("metric_tables_stored", f"""WITH {METRICS} SELECT dataset, CASE WHEN method LIKE 'Piecewise%' THEN 'piecewise' ELSE 'base' END AS family, lower(method) AS method_norm, ci_mean FROM metric""")
def metric_tables_stored(spark, sf_dir):
    root = store.scratch(spark)
    df = metric_wide(spark, sf_dir)
    kind = F.when(F.col("method").startswith("Piecewise"), "piecewise").otherwise("base")
    upper = df.withColumn("family", kind).toDF(*["dataset", *[c.upper() for c in df.columns[1:]], "family"])
    store.write_metric_tables(upper, root)
    return store.read_metric_tables(spark, root).select("dataset", "family", "method_norm", "ci_mean")


@query("number_formats", """SELECT o_orderkey, CASE WHEN v >= 100 THEN regexp_replace(regexp_replace(printf('%.1f', v), '0+$', ''), '\\.$', '') ELSE regexp_replace(regexp_replace(printf('%.3f', v), '0+$', ''), '\\.$', '') END AS long_form,
 CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE regexp_replace(regexp_replace(printf('%.2f', v), '0+$', ''), '\\.$', '') END AS short_form
FROM (SELECT o_orderkey, o_orderkey / 64.0 AS v FROM orders)""")
def number_formats(spark, sf_dir):
    v = F.col("o_orderkey") / 64.0
    return table(spark, sf_dir, "orders").select("o_orderkey", format_number(v).alias("long_form"), format_short(v).alias("short_form"))


@query("parameter_texts", """SELECT p_partkey, CAST(p_size AS VARCHAR) AS depth, CASE WHEN p_size % 2 = 0 THEN p_type END AS criterion, CAST(CASE WHEN p_size % 5 = 0 THEN 0 ELSE 2 END AS INT) AS entries
FROM (SELECT p_partkey, p_type, p_size FROM part) WHERE p_size % 5 <> 0
UNION ALL SELECT p_partkey, NULL, NULL, 0 FROM part WHERE p_size % 5 = 0""")
def parameter_texts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    text = F.when(F.col("p_size") % 5 == 0, "not a dict").when(
        F.col("p_size") % 2 == 0, F.format_string("{'depth': %d, 'criterion': '%s'}", "p_size", "p_type")).otherwise(
        F.format_string("{'depth': %d, 'criterion': None}", "p_size"))
    m = p.select("p_partkey", parse_params(text).alias("m"))
    return m.select("p_partkey", F.try_element_at("m", F.lit("depth")).alias("depth"),
                    F.try_element_at("m", F.lit("criterion")).alias("criterion"), F.size("m").alias("entries"))
