"""Metrics, stability, leaderboards and ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from martloom.catalog.common import (
    MODELS,
    SQL_PREDICTIONS,
    SQL_SCORED,
    predictions,
    query,
    r6,
    scored,
    sql_auc,
    sql_metrics,
    sql_r6,
    table,
)
from martloom.learning.jobs import evaluate_sets
from martloom.operators.ensemble import (
    draws,
    gini_of_weights,
    grid,
    mape_of_weights,
    plain_mean,
    search_weights,
    weighted_mean,
    weighted_sum,
    wide_predictions,
)
from martloom.operators.metrics import (
    METRICS,
    OVER_PERIODS,
    OVER_SCORES,
    attach_scores,
    auc,
    best_model,
    classification_metrics,
    gini_by_period,
    gini_stability,
    mean_scores,
    metrics_table,
    regression_metrics,
    stability,
    top_models,
    with_gini,
)

# -- classification -----------------------------------------------------------


def _classified(spark, sf):
    """Return flags as classes, guessed from quantity; a class X that never occurs."""
    guess = F.when(F.col("l_quantity") < 15, "A").when(F.col("l_quantity") < 30, "N")
    guess = guess.when(F.col("l_quantity") < 49, "R").otherwise("X")
    return table(spark, sf, "lineitem").select(
        F.when(F.col("l_shipdate") < F.lit("1999-01-01").cast("date"), "train").otherwise("test").alias("set"),
        F.col("l_returnflag").alias("y"),
        guess.alias("p"),
    )


SQL_CLASSIFIED = """
select case when l_shipdate < timestamp '1999-01-01' then 'train' else 'test' end as set, l_returnflag as y,
  case when l_quantity < 15 then 'A' when l_quantity < 30 then 'N' when l_quantity < 49 then 'R' else 'X' end as p
from lineitem
"""
SQL_METRICS = sql_metrics(SQL_CLASSIFIED)


@query(f"select set, {', '.join(f'{sql_r6(m)} as {m}' for m in METRICS)} from ({SQL_METRICS})")
def macro_metrics(spark, sf):
    out = classification_metrics(_classified(spark, sf), "y", "p", ("set",))
    return out.select("set", *[r6(m).alias(m) for m in METRICS])


@query(
    " union all ".join(
        f"select set || '_{m}' as metric, {sql_r6(m)} as value from ({SQL_METRICS})" for m in METRICS
    )
)
def metrics_by_set(spark, sf):
    return metrics_table(_classified(spark, sf), "y", "p", "set").select("metric", r6("value").alias("value"))


# -- ranking and stability ----------------------------------------------------


@query(f"select {sql_r6('auc')} as auc, {sql_r6('2 * auc - 1')} as gini from ({sql_auc(SQL_SCORED)})")
def auc_gini(spark, sf):
    return with_gini(auc(scored(spark, sf), "target", "score")).select(r6("auc").alias("auc"), r6("gini").alias("gini"))


SQL_ITEM_SCORES = """
select (l_returnflag = 'R')::int as target, l_quantity as score from lineitem
"""


@query(f"select {sql_r6('auc')} as auc from ({sql_auc(SQL_ITEM_SCORES)})")
def auc_many_ties(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").alias("target"), "l_quantity")
    return auc(rows, "target", "l_quantity").select(r6("auc").alias("auc"))


SQL_GINI = f"select period, 2 * auc - 1 as gini from ({sql_auc(SQL_SCORED, ('period',))})"


@query(f"select period, {sql_r6('gini')} as gini from ({SQL_GINI})")
def gini_in_periods(spark, sf):
    return gini_by_period(scored(spark, sf), "period", "target", "score").select("period", r6("gini").alias("gini"))


def _sql_stability(source: str, weights, by: str = "") -> str:
    """Two passes: fit the line, then the deviation of the residuals."""
    g, part = (f"{by}, ", f"partition by {by} ") if by else ("", "")
    falling, spread = weights
    return f"""
      with placed as (select *, (row_number() over ({part}order by period) - 1)::double as x from ({source})
                      where gini is not null),
        line as (select {g}regr_slope(gini, x) as a, regr_intercept(gini, x) as b, avg(gini) as mean
                 from placed {f"group by {by}" if by else ""}),
        left_over as (select {g}sqrt(avg((gini - a * x - b) ** 2)) as spread
                      from placed join line {f"using ({by})" if by else "on true"} {f"group by {by}" if by else ""})
      select {g}mean, a as slope, spread as residual_std,
             mean + ({falling}::double) * least(0.0::double, a) + ({spread}::double) * spread as stability
      from line join left_over {f"using ({by})" if by else "on true"}"""


STABILITY = ("mean", "slope", "residual_std", "stability")


def _rounded(df, *keys):
    return df.select(*keys, *[r6(c).alias(c) for c in STABILITY])


SQL_STABILITY = ", ".join(f"{sql_r6(c)} as {c}" for c in STABILITY)


@query(f"select {SQL_STABILITY} from ({_sql_stability(SQL_GINI, OVER_PERIODS)})")
def gini_stability_score(spark, sf):
    return _rounded(gini_stability(scored(spark, sf), "period", "target", "score"))


@query(f"select {SQL_STABILITY} from ({_sql_stability(SQL_GINI, OVER_SCORES)})")
def stability_of_scores(spark, sf):
    steps = gini_by_period(scored(spark, sf), "period", "target", "score")
    return _rounded(stability(steps, "period", "gini", OVER_SCORES))


SQL_RESCORED = SQL_SCORED.replace("value as score", "(user_id % 50) + value / 1000 as score")
SQL_REGINI = f"select period, 2 * auc - 1 as gini from ({sql_auc(SQL_RESCORED, ('period',))})"


@query(f"select {SQL_STABILITY} from ({_sql_stability(SQL_REGINI, OVER_PERIODS)})")
def stability_of_new_scores(spark, sf):
    new = table(spark, sf, "events").select("event_id", (F.col("user_id") % 50 + F.col("value") / 1000).alias("score"))
    rows = attach_scores(scored(spark, sf).drop("score"), new, "event_id")
    return _rounded(gini_stability(rows, "period", "target", "score"))


SQL_SETS = SQL_SCORED.replace("select event_id", "select case when user_id % 2 = 0 then 'train' else 'test' end as split, event_id")
SQL_SET_GINI = f"select split, period, 2 * auc - 1 as gini from ({sql_auc(SQL_SETS, ('split', 'period'))})"


@query(f"""
select split, {sql_r6("auc")} as auc, {sql_r6("stability")} as stability
from ({sql_auc(SQL_SETS, ("split",))}) join ({_sql_stability(SQL_SET_GINI, OVER_PERIODS, "split")}) using (split)
""")
def evaluate_by_set(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id")
    split = F.when(F.col("user_id") % 2 == 0, "train").otherwise("test")
    rows = scored(spark, sf).join(events.select("event_id", split.alias("split")), "event_id")
    out = evaluate_sets(rows, "target", "score", "period")
    return out.select("split", r6("auc").alias("auc"), r6("stability").alias("stability"))


# -- regression ---------------------------------------------------------------

REGRESSION = {
    "neg_mean_squared_error": "-avg((y - p) ** 2)",
    "neg_root_mean_squared_error": "-sqrt(avg((y - p) ** 2))",
    "neg_mean_absolute_error": "-avg(abs(y - p))",
    "r2": "1 - sum((y - p) ** 2) / sum((y - m) ** 2)",
    "neg_mean_absolute_percentage_error": "-avg(abs(y - p) / greatest(abs(y), 2.220446049250313e-16))",
}


@query(f"""
select grp, {", ".join(f"{sql_r6(e)} as {n}" for n, e in REGRESSION.items())}
from (select *, avg(y) over (partition by grp) as m
      from (select l_returnflag as grp, l_quantity / 10 as y, l_extendedprice / 10000 as p from lineitem))
group by grp
""")
def regression_scores(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("grp"),
        (F.col("l_quantity") / 10).alias("y"),
        (F.col("l_extendedprice") / 10000).alias("p"),
    )
    out = regression_metrics(rows, "y", "p", ("grp",))
    return out.select("grp", *[r6(c).alias(c) for c in REGRESSION])


# -- leaderboards -------------------------------------------------------------


def _fold_scores(spark, sf):
    """Scores per customer segment and order year as if per model and fold."""
    orders = table(spark, sf, "orders")
    customers = table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return orders.join(customers, "o_custkey").groupBy(
        F.col("c_mktsegment").alias("model"), F.year("o_orderdate").alias("fold")
    ).agg(F.avg("o_totalprice").alias("score"))


SQL_FOLD_SCORES = """
select c_mktsegment as model, year(o_orderdate) as fold, avg(o_totalprice) as score
from orders join customer on c_custkey = o_custkey group by all
"""
SQL_MEANS = f"select model, avg(score) as score from ({SQL_FOLD_SCORES}) group by model"


@query(f"select model, {sql_r6('score')} as score from ({SQL_MEANS})")
def mean_fold_scores(spark, sf):
    return mean_scores(_fold_scores(spark, sf), ("model",)).select("model", r6("score").alias("score"))


@query(f"select model, {sql_r6('score')} as score from ({SQL_MEANS}) order by score desc, model limit 3")
def leaderboard_top(spark, sf):
    means = mean_scores(_fold_scores(spark, sf), ("model",))
    return top_models(means, "score", 3).select("model", r6("score").alias("score"))


@query(f"""
select 'max' as direction, arg_max(model, score) as model, {sql_r6("max(score)")} as score from ({SQL_MEANS})
union all select 'min', arg_min(model, score), {sql_r6("min(score)")} from ({SQL_MEANS})
""")
def best_by_direction(spark, sf):
    means = mean_scores(_fold_scores(spark, sf), ("model",))
    pick = lambda d: best_model(means, "score", d).select(F.lit(d).alias("direction"), "model", r6("score").alias("score"))
    return pick("max").unionByName(pick("min"))


# -- ensembles ----------------------------------------------------------------

WEIGHTS = (0.5, -0.25, 1.0)


@query(f"""
select key, {sql_r6("(0.5::double * m1 - 0.25::double * m2 + m3) / 3")} as weighted_mean,
       {sql_r6("0.5::double * m1 - 0.25::double * m2 + m3")} as weighted_sum, {sql_r6("(m1 + m2 + m3) / 3")} as plain_mean
from ({SQL_PREDICTIONS})
""")
def ensemble_scores(spark, sf):
    return predictions(spark, sf).select(
        "key",
        r6(weighted_mean(MODELS, WEIGHTS)).alias("weighted_mean"),
        r6(weighted_sum(MODELS, WEIGHTS)).alias("weighted_sum"),
        r6(plain_mean(MODELS)).alias("plain_mean"),
    )


@query(f"select key, m1, case when m2 >= 0.5 then m2 end as m2, m3 from ({SQL_PREDICTIONS})")
def ensemble_wide(spark, sf):
    """Three models, of which the second has predicted some of the rows only."""
    rows = predictions(spark, sf)
    parts = {m: rows.select("key", F.col(m).alias("score")) for m in MODELS}
    parts["m2"] = parts["m2"].where("score >= 0.5")
    return wide_predictions(parts, "key")


def _sql_grid() -> str:
    """Every grid combination ranked on its own; rounding keeps exact ties exact."""
    values = ", ".join(f"({i}, {a}::double, {b}::double, {c}::double)" for i, (a, b, c) in enumerate(grid(3)))
    spread = f"""select trial, y as target, (w1 * m1 + w2 * m2 + w3 * m3) / 3 as score
      from ({SQL_PREDICTIONS}), (values {values}) t(trial, w1, w2, w3)"""
    return f"select trial, 2 * auc - 1 as gini from ({sql_auc(spread, ('trial',))})"


@query(f"select trial, {sql_r6('gini')} as gini from ({_sql_grid()})")
def ensemble_grid(spark, sf):
    out = gini_of_weights(predictions(spark, sf), "y", MODELS, grid(3))
    return out.select("trial", r6("gini").alias("gini"))


@query(f"select {sql_r6('max(gini)')} as gini, 27 as n_trials from ({_sql_grid()})")
def ensemble_search(spark, sf):
    found = search_weights(predictions(spark, sf), "y", MODELS, max_trials=27)
    return spark.createDataFrame([(round(found.score, 6), found.n_trials)], "gini double, n_trials int")


@query()
def ensemble_search_full(spark, sf):
    """The grid, then draws until `PATIENCE` trials bring no gain; ranking every trial is too much for SQL."""
    found = search_weights(predictions(spark, sf), "y", MODELS)
    row = (list(found.weights), round(found.score, 6), found.n_trials)
    return spark.createDataFrame([row], "weights array<double>, gini double, n_trials int")


def _drawn(n: int):
    source = draws(3)
    return [next(source) for _ in range(n)]


_SQL_DRAWN = ", ".join(f"({i}, {a!r}::double, {b!r}::double, {c!r}::double)" for i, (a, b, c) in enumerate(_drawn(20)))


@query(f"""
select trial, {sql_r6("avg(abs(target - (w1 * m1 + w2 * m2 + w3 * m3)) / greatest(abs(target), 2.220446049250313e-16))")}
       as mape
from ({SQL_PREDICTIONS}), (values {_SQL_DRAWN}) t(trial, w1, w2, w3) group by trial
""")
def ensemble_draws(spark, sf):
    out = mape_of_weights(predictions(spark, sf), "target", MODELS, _drawn(20))
    return out.select("trial", r6("mape").alias("mape"))
