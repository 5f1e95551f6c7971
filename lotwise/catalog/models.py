"""Models, scores, tuning and scoring.

Models are fitted on the whole vector. Least squares has a closed form, which its
SQL solves. What has none is checked by what must hold of it on its training
rows, see ``operators.certify``: the query gives the figures that the model
implies, for instance a mean label for every level, and SQL takes the same figures from
the table. The ``*_numbers`` and ``*_age`` queries fit on features where all
models have a closed form.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lotwise.catalog.data import CLEANED_SQL, COLUMNS_SQL, KEY, LISTINGS_SPEC, listings
from lotwise.catalog.features import SPLIT_SQL, sides
from lotwise.catalog.registry import query
from lotwise.catalog.solved import solved_sql
from lotwise.functions.columns import car_age, round_columns
from lotwise.operators import certify as C
from lotwise.operators import evaluate as E
from lotwise.operators import features as X
from lotwise.operators import models as M
from lotwise.operators import score as S
from lotwise.operators import tune as T
from lotwise.operators.levels import LevelIndexerModel
from lotwise.plans.clean import clean_listings
from lotwise.plans.train import train_and_compare
from lotwise.sources.models import load_model, save_model
from lotwise.sources.workspace import materialize, new_path

LABEL = "worth"
NUMBERS = X.FeatureSpec(numeric=("odometer", "car_age"), categorical=(), label=LABEL)
AGE = X.FeatureSpec(numeric=("car_age",), categorical=(), label=LABEL)
ALL = X.FeatureSpec(label=LABEL)


def vectors(spark, sf, spec):
    """Key, numbers, label and numeric vector of both sides, joined once."""
    df = car_age(listings(spark, sf, *KEY, "odometer", "year", LABEL))
    numbers = materialize(df, "numbers", rebalance=True)
    return X.split_train_test(X.assemble_numeric(spec).transform(numbers), key=KEY)


# Moments of the train side, and least squares with penalties l1 and l2 on
# features and label scaled to unit variance.
MOMENTS_SQL = f"""{SPLIT_SQL},
s as (select avg(odometer) m0, avg(car_age) m1, avg(worth) my, stddev_pop(odometer) d0,
    stddev_pop(car_age) d1, stddev_pop(worth) dy, corr(odometer, car_age) r01,
    corr(odometer, worth) r0, corr(car_age, worth) r1 from train)"""


def _solve_sql(name: str, source: str, reg: str, mix: float) -> str:
    """Both slopes and the intercept; the signs of the slopes are those of r0 and r1."""
    l1, l2 = f"({reg} * {mix} / dy)", f"({reg} * {1 - mix} / dy)"
    a0, a1 = f"(r0 - sign(r0) * {l1})", f"(r1 - sign(r1) * {l1})"
    det = f"((1 + {l2}) * (1 + {l2}) - r01 * r01)"
    return f"""{name} as (select *,
      ((1 + {l2}) * {a0} - r01 * {a1}) / {det} * dy / d0 b0,
      ((1 + {l2}) * {a1} - r01 * {a0}) / {det} * dy / d1 b1 from {source})"""


SCORES_SQL = """1 - avg((y - p) * (y - p)) / var_pop(y) r2, avg((y - p) * (y - p)) mse,
  avg(abs(y - p)) mae, sqrt(avg((y - p) * (y - p))) rmse"""


def _line_sql(reg: float, mix: float) -> str:
    return f"""with {MOMENTS_SQL}, {_solve_sql('fitted', 's', str(reg), mix)},
    scored as (select worth y, my + b0 * (odometer - m0) + b1 * (car_age - m1) p from test, fitted),
    scores as (select {SCORES_SQL} from scored)
    select round(b0, 4) b_odometer, round(b1, 1) b_car_age, round(my - b0 * m0 - b1 * m1, 0) intercept,
      round(r2, 4) "R2" from fitted, scores"""


def _line(spark, sf, estimator):
    train, test = vectors(spark, sf, NUMBERS)
    model = M.fit(estimator(LABEL, X.NUMERIC_VECTOR), train)
    b0, b1 = model.coefficients.toArray().tolist()
    scored = E.regression_metrics(M.predict(model, test), LABEL)
    return scored.select(
        F.round(F.lit(b0), 4).alias("b_odometer"),
        F.round(F.lit(b1), 1).alias("b_car_age"),
        F.round(F.lit(model.intercept), 0).alias("intercept"),
        F.round("R2", 4).alias("R2"),
    )


@query("fit_linear_numbers", _line_sql(0.0, 0.0))
def fit_linear_numbers(spark, sf):
    return _line(spark, sf, M.linear)


@query("fit_ridge_numbers", _line_sql(0.5, 0.0))
def fit_ridge_numbers(spark, sf):
    return _line(spark, sf, M.ridge)


@query("fit_lasso_numbers", _line_sql(0.1, 1.0))
def fit_lasso_numbers(spark, sf):
    return _line(spark, sf, M.lasso)


LEAF_SQL = f"""{SPLIT_SQL},
leaves as (select car_age, avg(worth) p from train group by car_age)"""
TREE_SQL = f"""with {LEAF_SQL} select test.car_age, count(*) n, round(max(p), 2) prediction
  from test join leaves on test.car_age = leaves.car_age group by test.car_age"""


def _tree(spark, sf, estimator):
    train, test = vectors(spark, sf, AGE)
    model = M.fit(estimator(LABEL, X.NUMERIC_VECTOR), train)
    scored = M.predict(model, test).groupBy("car_age")
    return scored.agg(F.count(F.lit(1)).alias("n"), F.round(F.max("prediction"), 2).alias("prediction"))


@query("fit_decision_tree_age", TREE_SQL)
def fit_decision_tree_age(spark, sf):
    return _tree(spark, sf, M.decision_tree)


@query("fit_gbt_age", TREE_SQL)
def fit_gbt_age(spark, sf):
    return _tree(spark, sf, M.gbt)


@query("fit_gbt_tuned_age", TREE_SQL)
def fit_gbt_tuned_age(spark, sf):
    return _tree(spark, sf, M.gbt_tuned)


@query("fit_random_forest_age")
def fit_random_forest_age(spark, sf):
    return _tree(spark, sf, M.random_forest)

def assembled(spark, sf, *names):
    """Label and vector of train rows with the named columns, written once, and the fitted features."""
    train, _ = sides(spark, sf)
    fitted = X.feature_pipeline(train, ALL)
    rows = fitted.transform(train).select(*names, LABEL, X.FEATURES)
    return materialize(rows, "vectors"), fitted


# Added to a mean before it is rounded: means of whole numbers are often right at
# the edge between two roundings, and figures found by another way fall on either side.
EDGE = 0.0031


def _mean_labels_sql(digits: int) -> str:
    """The mean label of every level, and that of the label times each scaled number."""
    levels = " union all ".join(
        f"""select '{c}' column_name, "{c}" "value", count(*) "rows", avg(worth) m from train
            where "{c}" is not null group by "{c}\""""
        for c in ALL.categorical
    )
    numbers = " union all ".join(
        f"select '{c}', null, count(*), avg(worth * ({c} - m{i}) / d{i}) from train, s" for i, c in enumerate(ALL.numeric)
    )
    return f"""with {SPLIT_SQL}, s as (select avg(odometer) m0, stddev_samp(odometer) d0, avg(car_age) m1,
          stddev_samp(car_age) d1 from train)
        select column_name, "value", "rows", round(m + {EDGE}, {digits}) mean_label from ({levels} union all {numbers})"""


def _stationary(spark, sf, estimator, reg: float, mix: float, digits: int):
    vectors, fitted = assembled(spark, sf, *ALL.categorical, X.SCALED_VECTOR)
    indexer = next(stage for stage in fitted.stages if isinstance(stage, LevelIndexerModel))
    model = M.fit(estimator, vectors)
    means = C.stationary_means(model, indexer, M.predict(model, vectors), ALL, reg, mix)
    return means.withColumn("mean_label", F.round(F.col("mean_label") + EDGE, digits))


@query("fit_linear", _mean_labels_sql(1))
def fit_linear(spark, sf):
    """Residuals of least squares add up to zero in every slot, so mean predictions are mean labels."""
    return _stationary(spark, sf, M.linear(LABEL), 0.0, 0.0, 1)


@query("fit_ridge", _mean_labels_sql(2))
def fit_ridge(spark, sf):
    """Mean predictions plus the slope of a squared penalty of 0.5 are mean labels."""
    return _stationary(spark, sf, M.ridge(LABEL), 0.5, 0.0, 2)


@query("fit_lasso", _mean_labels_sql(1))
def fit_lasso(spark, sf):
    """Mean predictions plus the slope of an absolute penalty of 0.1 are mean labels, solved to the last digits."""
    tight = M.lasso(LABEL)
    return _stationary(spark, sf, tight.copy({tight.tol: 1e-14, tight.maxIter: 10_000}), 0.1, 1.0, 1)


def _trees_sql(trees: int, depth: int, bagged: bool = False) -> str:
    """What the evidence of so many trees of that depth must be."""
    mean = "null::double" if bagged else "case when k = 0 then round(m, 2) else 0 end"
    return f"""with {SPLIT_SQL}, t as (select count(*) n, avg(worth) m from train)
        select cast(k as int) tree, {depth} deepest, n "rows", {mean} mean_output, 0 off_leaves, 0 off_predictions
        from t, range({trees}) r(k)"""


def _evidence(spark, sf, estimator, step: float = 1.0, bagged: bool = False):
    vectors, _ = assembled(spark, sf)
    model = M.fit(estimator, vectors)
    found = C.tree_evidence(model, vectors, LABEL, step, bagged)
    mean = F.lit(None).cast("double") if bagged else F.round(F.col("mean_output"), 2) + 0.0
    deepest = found.agg(F.max("depth")).scalar()
    return found.select(
        "tree", deepest.alias("deepest"), "rows", mean.alias("mean_output"),
        F.col("off_leaves").cast("int").alias("off_leaves"), F.col("off_predictions").cast("int").alias("off_predictions"),
    )


@query(
    "fit_decision_tree",
    f"{_trees_sql(1, 5).replace('0 off_predictions', '0 off_predictions, 0 beaten_splits')}",
)
def fit_decision_tree(spark, sf):
    """Every leaf is the mean of its rows, and no slot would have split a node better."""
    vectors, _ = assembled(spark, sf)
    model = M.fit(M.decision_tree(LABEL), vectors)
    beaten = C.beaten_splits(model, vectors, LABEL).agg(F.count(F.lit(1)).cast("int")).scalar()
    found = C.tree_evidence(model, vectors, LABEL)
    return found.select(
        "tree", F.col("depth").alias("deepest"), "rows", F.round("mean_output", 2).alias("mean_output"),
        F.col("off_leaves").cast("int").alias("off_leaves"), F.col("off_predictions").cast("int").alias("off_predictions"),
        beaten.alias("beaten_splits"),
    )


@query("fit_random_forest", _trees_sql(20, 5, bagged=True))
def fit_random_forest(spark, sf):
    """Twenty trees whose mean is the prediction, each leaf the mean of a sample of its rows."""
    return _evidence(spark, sf, M.random_forest(LABEL), bagged=True)


@query("fit_gbt", _trees_sql(20, 5))
def fit_gbt(spark, sf):
    """Twenty trees, each leaf the mean of what a tenth of the trees before left over."""
    return _evidence(spark, sf, M.gbt(LABEL), 0.1)


@query("fit_gbt_tuned", _trees_sql(75, 9))
def fit_gbt_tuned(spark, sf):
    """Seventy-five trees nine deep, with a step of 0.06."""
    return _evidence(spark, sf, M.gbt_tuned(LABEL), 0.06)


PENALTY = 0.5
PREDICTED_SQL = f"""{solved_sql(PENALTY)},
predicted as (select {', '.join(KEY)}, odometer, car_age, numbered.worth, prediction
  from fitted join numbered using (rid) where not fitted.in_train)"""


def _scorer_of_ridge(spark, sf):
    """Features and a ridge model on the whole vector, and the test side as raw rows."""
    train, test = sides(spark, sf)
    features = X.feature_pipeline(train, ALL)
    model = M.fit(M.ridge(LABEL), features.transform(train))
    return features, model, test


def _predicted(spark, sf):
    features, model, test = _scorer_of_ridge(spark, sf)
    return M.predict(model, features.transform(test))


@query(
    "predict",
    f"with recursive {PREDICTED_SQL} select {', '.join(KEY)}, worth, round(prediction, 0) prediction from predicted",
)
def predict(spark, sf):
    return round_columns(_predicted(spark, sf).select(*KEY, LABEL, "prediction"), {"prediction": 0})


@query(
    "prediction_sample",
    f"""with recursive {PREDICTED_SQL} select round((odometer - m0) / d0, 6) z0, round((car_age - m1) / d1, 6) z1, worth,
        round(prediction, 0) prediction from predicted, moments order by {', '.join(KEY)} limit 20""",
)
def prediction_sample(spark, sf):
    shown = M.prediction_sample(_predicted(spark, sf), 20, order_by=KEY, label=LABEL)
    values = vector_to_array(X.FEATURES)
    return shown.select(
        F.round(values[0], 6).alias("z0"), F.round(values[1], 6).alias("z1"), LABEL,
        F.round("prediction", 0).alias("prediction"),
    )


def _metric_query(name: str, measure, digits: int):
    short = name.removeprefix("metric_")

    @query(
        name,
        f"""with recursive {PREDICTED_SQL}, scores as (select {SCORES_SQL} from (select worth y, prediction p from predicted))
            select round({short}, {digits}) {short} from scores""",
    )
    def build(spark, sf):
        scored = _predicted(spark, sf)
        return scored.agg(F.round(measure(LABEL, "prediction"), digits).alias(short))


_metric_query("metric_r2", E.metric_r2, 6)
_metric_query("metric_mse", E.metric_mse, 2)
_metric_query("metric_mae", E.metric_mae, 4)
_metric_query("metric_rmse", E.metric_rmse, 4)

# As coarse as the forest needs: its leaves are means of samples.
BOARD_DIGITS = {"R2": 3, "Mse": -5, "Mae": -1, "Rmse": -1}
LINES = {"Linear": (0.0, 0.0), "Ridge": (0.5, 0.0), "Lasso": (0.1, 1.0)}
TREES = ("RandomForest", "DecisionTree", "GradientBoosting", "GradientBoosting(T)")


def _slope_sql(reg: float, mix: float) -> str:
    return f"((r1 - sign(r1) * {reg * mix} / dy) / (1 + {reg * (1 - mix)} / dy) * dy / d1)"


BOARD_SQL = (
    f"""with {MOMENTS_SQL}, leaves as (select car_age, avg(worth) p from train group by car_age),
    scored as ("""
    + " union all ".join(
        [
            f"select '{n}' model, worth y, my + {_slope_sql(*v)} * (car_age - m1) p from test, s"
            for n, v in LINES.items()
        ]
        + [
            f"select '{n}' model, worth y, p from test join leaves on test.car_age = leaves.car_age"
            for n in TREES
        ]
    )
    + f"""), scores as (select model, {SCORES_SQL} from scored group by model)
    select model "Model", round(r2, 3) "R2", round(mse, -5) "Mse", round(mae, -1) "Mae", round(rmse, -1) "Rmse"
    from scores"""
)


@query("leaderboard", BOARD_SQL)
def leaderboard(spark, sf):
    train, test = vectors(spark, sf, AGE)
    estimators = {n: M.REGRESSORS[n](LABEL, X.NUMERIC_VECTOR) for n in (*LINES, *TREES)}
    return E.leaderboard(E.fit_all(estimators, train), test, LABEL, BOARD_DIGITS)


CLEANED_COLUMNS = COLUMNS_SQL.replace(' "year",', "") + ", car_age"
BOARD_NAMES = ", ".join(f"'{n}'" for n in M.REGRESSORS)


@query(
    "train_listings",
    f"""with {CLEANED_SQL}, marked as (select *, substr(md5(concat_ws('|', '23', {CLEANED_COLUMNS})), 1, 8) < 'cccccccd' in_train from cleaned),
    held as (select var_pop(worth) v, count(*) n from marked where not in_train)
    select unnest([{BOARD_NAMES}]) "Model", round(v, -1) label_variance, true root, true mean_below_root, true explains_most
    from held""",
)
def train_listings(spark, sf):
    """The whole job: clean, split, features, all seven models, and scores that belong to one another and to the label.

    A score of explained variance and a squared error give the variance of the
    label on the test side, which SQL takes from the table.
    """
    cleaned = clean_listings(listings(spark, sf), LISTINGS_SPEC)
    board = train_and_compare(cleaned, ALL, digits=None).board
    return board.select(
        "Model", F.round(F.col("Mse") / (1 - F.col("R2")), -1).alias("label_variance"),
        (F.abs(F.col("Rmse") * F.col("Rmse") / F.col("Mse") - 1) < 1e-9).alias("root"),
        (F.col("Mae") <= F.col("Rmse")).alias("mean_below_root"), (F.col("R2") > 0.75).alias("explains_most"),
    )


# Penalties of the size of the label's spread, so that scores differ.
GRID = {"regParam": (0.0, 500.0, 2000.0, 8000.0), "elasticNetParam": (0.0,)}
GRID_SQL = f"""{solved_sql(*GRID['regParam'])},
scores as (select reg, in_train, {SCORES_SQL} from (select reg, in_train, worth y, prediction p from fitted) group by reg, in_train),
result as (select reg "regParam", 0.0::double "elasticNetParam", max(case when in_train then r2 end) train_r2,
  max(case when not in_train then r2 end) test_r2 from scores group by reg)"""


def _grid(spark, sf):
    train, test = sides(spark, sf)
    fitted = X.feature_pipeline(train, ALL)
    columns = (X.FEATURES, LABEL)
    return T.grid_search(
        M.linear(LABEL),
        GRID,
        materialize(fitted.transform(train).select(*columns), "train"),
        materialize(fitted.transform(test).select(*columns), "test"),
    )


POINT_SQL = '"regParam", "elasticNetParam"'
SCORE_DIGITS = {"train_r2": 6, "test_r2": 6, "gap": 6, "value": 6}


@query(
    "grid_search",
    f"with recursive {GRID_SQL} select {POINT_SQL}, round(train_r2, 6) train_r2, round(test_r2, 6) test_r2 from result",
)
def grid_search(spark, sf):
    return round_columns(_grid(spark, sf), SCORE_DIGITS)


@query("grid_search_train", f"with recursive {GRID_SQL} select {POINT_SQL}, round(train_r2, 6) train_r2 from result")
def grid_search_train(spark, sf):
    return round_columns(T.grid_search_train(_grid(spark, sf)), SCORE_DIGITS)


@query(
    "overfit_gap",
    f"""with recursive {GRID_SQL} select {POINT_SQL}, round(train_r2, 6) train_r2, round(test_r2, 6) test_r2,
        round(train_r2 - test_r2, 6) gap from result""",
)
def overfit_gap(spark, sf):
    return round_columns(T.overfit_gap(_grid(spark, sf)), SCORE_DIGITS)


@query(
    "best_params",
    f"""with recursive {GRID_SQL} select {POINT_SQL}, round(train_r2, 6) train_r2, round(test_r2, 6) test_r2,
        round(train_r2 - test_r2, 6) gap from result order by test_r2 desc, {POINT_SQL} limit 1""",
)
def best_params(spark, sf):
    return round_columns(T.best_params(_grid(spark, sf)), SCORE_DIGITS)


@query(
    "metric_series",
    f"""with recursive {GRID_SQL} select cast(row_number() over (order by {POINT_SQL}) as int) pos,
        concat_ws('.', "regParam", "elasticNetParam") point, round(test_r2, 6) "value" from result""",
)
def metric_series(spark, sf):
    series = T.metric_series(_grid(spark, sf), "test_r2", tuple(GRID))
    return round_columns(series, SCORE_DIGITS)


BOOSTED_GRID = {"maxIter": (5, 10), "maxDepth": (3, 5), "stepSize": (0.1, 0.3)}


def _boosted_sides(spark, sf):
    train, test = X.split_train_test(clean_listings(listings(spark, sf), LISTINGS_SPEC))
    features = X.feature_pipeline(train, ALL)
    columns = (X.FEATURES, LABEL)
    return [
        materialize(features.transform(side).select(*columns), name, rebalance=True)
        for name, side in (("train", train), ("test", test))
    ]


@query("grid_search_boosted")
def grid_search_boosted(spark, sf):
    """Boosted trees on all features of every cleaned listing, a small grid."""
    return T.grid_search(M.gbt(LABEL), BOOSTED_GRID, *_boosted_sides(spark, sf))


@query(
    "grid_search_evidence",
    f"""with {CLEANED_SQL}, marked as (select *, substr(md5(concat_ws('|', '23', {CLEANED_COLUMNS})), 1, 8) < 'cccccccd' in_train from cleaned),
    t as (select count(*) n, avg(worth) m from marked where in_train)
    select d "maxDepth", s "stepSize", cast(count(*) as int) trees, d deepest, n "rows", round(m, 2) mean_output, 0 off_leaves,
      0 off_predictions, true scores_agree
    from t, range({max(BOOSTED_GRID['maxIter'])}) r(k), (select unnest([{', '.join(map(str, BOOSTED_GRID['maxDepth']))}]) d) a,
      (select unnest([{', '.join(f'{v}::double' for v in BOOSTED_GRID['stepSize'])}]) s) b group by d, s, n, m""",
)
def grid_search_evidence(spark, sf):
    """What the model of each setting of the boosted grid is on its training rows.

    The longest model of a setting stands for all its points, as theirs are the
    starts of it. ``scores_agree`` compares the grid's score with the model's own.
    """
    train, test = _boosted_sides(spark, sf)
    models = {}
    result = T.grid_search(
        M.gbt(LABEL), BOOSTED_GRID, train, test,
        fitted=lambda point, model: models.update({(point["maxDepth"], point["stepSize"]): (point["maxIter"], model)}),
    )
    scores = {(r["maxIter"], r["maxDepth"], r["stepSize"]): r["train_r2"] for r in result.collect()}
    found = None
    for (depth, step), (trees, model) in sorted(models.items()):
        r2 = E.leaderboard({"m": model}, train, LABEL, digits=None).first()["R2"]
        told = C.tree_evidence(model, train, LABEL, step).agg(
            F.count(F.lit(1)).cast("int").alias("trees"), F.max("depth").alias("deepest"), F.max("rows").alias("rows"),
            # Trees after the first add nothing to the mean.
            F.round(F.sum("mean_output"), 2).alias("mean_output"), F.sum("off_leaves").cast("int").alias("off_leaves"),
            F.max("off_predictions").cast("int").alias("off_predictions"),
        ).select(
            F.lit(depth).alias("maxDepth"), F.lit(step).alias("stepSize"), "*",
            F.lit(abs(scores[(trees, depth, step)] - r2) < 1e-9).alias("scores_agree"),
        )
        found = told if found is None else found.unionAll(told)
    return found


REQUEST = (*KEY, "odometer", "year", *ALL.categorical)
KEPT = {"region": 5, "model": 50}


def _scorer(spark, sf, estimator):
    """A pipeline with rare-value lists, saved and read back, and its requests."""
    df = car_age(listings(spark, sf, *REQUEST, LABEL))
    train, test = X.written_split(df, key=KEY)
    fitted = S.fit_scorer(train, ALL, estimator, KEPT)
    path = save_model(fitted, new_path(spark, "model"))
    return load_model(path), test.drop(LABEL)


def _scored(spark, sf):
    model, requests = _scorer(spark, sf, M.ridge(LABEL))
    return S.score_listings(model, requests, ALL)


_GROUPED = ", ".join(
    f"case when {c} in (select v from top_{c}) then {c} else 'others' end as {c}, {c} as given_{c}" for c in KEPT
)
GROUPED_SPLIT_SQL = f"""{SPLIT_SQL.replace('aged as', 'raw as', 1).replace('from aged where', 'from raw where')},
{', '.join(f"top_{c} as (select {c} v from train group by {c} order by count(*) desc, {c} limit {k})" for c, k in KEPT.items())},
aged as (select * exclude ({', '.join(KEPT)}), {_GROUPED} from raw)"""
GROUPED_SPLIT_SQL = GROUPED_SPLIT_SQL.replace("train as", "raw_train as").replace("test as", "raw_test as").replace(
    "from train group", "from raw_train group"
) + """,
train as (select * from aged where in_train),
test as (select * from aged where not in_train)"""
SCORED_SQL = f"""with recursive {solved_sql(PENALTY, split=GROUPED_SPLIT_SQL)},
scored as (select numbered.*, prediction from fitted join numbered using (rid) where not fitted.in_train)"""


@query(
    "score_listings",
    f"""{SCORED_SQL} select {', '.join(KEY)}, given_model model, given_region region, "condition", odometer, car_age,
        round(prediction, 0) prediction from scored""",
)
def score_listings(spark, sf):
    """Raw requests through grouping, index, slots and a model on the whole vector, all from one saved pipeline."""
    scored = _scored(spark, sf).select(*KEY, "model", "region", "condition", "odometer", "car_age", "prediction")
    return round_columns(scored, {"prediction": 0})


@query(
    "score_text",
    f"""{SCORED_SQL} select {', '.join(KEY)},
        'Your Car Price is $' || cast(cast(trunc(prediction) as bigint) as varchar) price_text from scored""",
)
def score_text(spark, sf):
    return S.score_text(_scored(spark, sf)).select(*KEY, "price_text")


@query("score_listings_boosted")
def score_listings_boosted(spark, sf):
    """Requests scored by boosted trees on the whole vector."""
    model, requests = _scorer(spark, sf, M.gbt(LABEL))
    return S.score_listings(model, requests, ALL).select(*KEY, "model", "car_age", "prediction")


def _saved(spark, sf):
    features, model, test = _scorer_of_ridge(spark, sf)
    return save_model(PipelineModel([*features.stages, model]), new_path(spark, "model")), test


@query(
    "save_model",
    f"""with recursive {solved_sql(PENALTY)}
        select cast(k - 1 as int) slot, round(b, 1) coefficient from beta""",
)
def save(spark, sf):
    """The saved coefficients, read as a table; the intercept has slot -1."""
    path, _ = _saved(spark, sf)
    model = spark.read.parquet(f"{path}/stages/*LinearRegression*/data")
    slots = model.select(F.posexplode(F.concat(F.array("intercept"), vector_to_array("coefficients"))).alias("k", "b"))
    return slots.select((F.col("k") - 1).alias("slot"), F.round("b", 1).alias("coefficient"))


@query(
    "load_model",
    f"with recursive {PREDICTED_SQL} select {', '.join(KEY)}, round(prediction, 0) prediction from predicted",
)
def load(spark, sf):
    path, test = _saved(spark, sf)
    return round_columns(load_model(path).transform(test).select(*KEY, "prediction"), {"prediction": 0})
