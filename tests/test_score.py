from __future__ import annotations

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from lotwise.operators import models as M
from lotwise.operators import score as S
from lotwise.operators.features import FeatureSpec
from lotwise.operators.stages import QuantileTrimmer, RareGrouper
from lotwise.plans.clean import CleanSpec, clean_and_learn, clean_listings
from lotwise.plans.train import train_and_compare
from lotwise.sources.frames import REQUEST_SCHEMA, request_to_df
from lotwise.sources.models import load_model, save_model

SPEC = FeatureSpec()
SAMPLE = dict(
    car_age=12, odometer=15000, manufacturer="kia", model="others", condition="good", cylinders="6 cylinders",
    fuel="gas", title_status="clean", transmission="automatic", drive="4wd", type="sedan", paint_color="white",
    region="others",
)


@pytest.fixture(scope="module")
def scorer(spark, vehicles, tmp_path_factory):
    cleaned = clean_listings(vehicles, CleanSpec(rel_err=0.0)).cache()
    fitted = S.fit_scorer(cleaned, SPEC, M.gbt(maxIter=3), {"model": 3, "region": 3})
    path = str(tmp_path_factory.mktemp("models") / "scorer")
    return fitted, load_model(save_model(fitted, path)), cleaned


def test_saved_scorer_predicts_the_same(scorer):
    fitted, loaded, cleaned = scorer
    a = S.score_listings(fitted, cleaned, SPEC)
    b = S.score_listings(loaded, cleaned, SPEC)
    assert a.exceptAll(b).isEmpty() and a.count() == cleaned.count()


def test_trees_are_fitted_on_written_vectors(scorer, monkeypatch):
    """Trees go over their vectors several times, so the features are not made again each time."""
    plans = []
    monkeypatch.setattr(S, "fit", lambda estimator, rows: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or scorer[0].stages[-1])
    S.fit_scorer(scorer[2], SPEC, M.gbt(maxIter=3), {"model": 3, "region": 3})
    assert "Join" not in plans[0] and "PythonUDF" not in plans[0]


def test_one_request(spark, scorer):
    scored = S.score_listings(scorer[1], request_to_df(spark, **SAMPLE), SPEC)
    row = scored.first()
    assert row.asDict() == {**{k: float(v) if k in ("car_age", "odometer") else v for k, v in SAMPLE.items()},
                            "prediction": row.prediction}
    text = S.score_text(scored).first().price_text
    assert text == f"Your Car Price is ${int(row.prediction)}"


def test_unseen_raw_values_are_grouped_like_others(spark, scorer):
    usual = S.score_listings(scorer[1], request_to_df(spark, **SAMPLE), SPEC).first()
    raw = S.score_listings(scorer[1], request_to_df(spark, **{**SAMPLE, "model": "never seen"}), SPEC).first()
    assert raw.model == "never seen" and raw.prediction == usual.prediction


def test_requests_are_read_by_name(spark, scorer):
    straight = request_to_df(spark, **SAMPLE)
    turned = straight.select(*reversed(straight.columns))
    assert (S.score_listings(scorer[1], turned, SPEC).first().prediction
            == S.score_listings(scorer[1], straight, SPEC).first().prediction)


def test_missing_values_keep_their_row(spark, scorer):
    df = request_to_df(spark, **{**SAMPLE, "odometer": None}).unionAll(request_to_df(spark, **{**SAMPLE, "fuel": None}))
    rows = S.score_listings(scorer[1], df, SPEC).collect()
    assert rows[0].prediction is None and rows[0].fuel == "gas"
    assert rows[1].prediction is not None and rows[1].fuel is None
    with pytest.raises(ValueError, match="lack"):
        S.score_listings(scorer[1], df.drop("region"), SPEC)


def test_request_fields_are_checked(spark):
    assert request_to_df(spark, **SAMPLE).schema == REQUEST_SCHEMA
    with pytest.raises(ValueError):
        request_to_df(spark, car_age=1)


def test_domains(spark):
    df = spark.createDataFrame(
        [("good", "gas"), ("odd", "steam"), (None, "gas")], "condition string, fuel string"
    )
    domains = {n: S.DOMAINS[n] for n in ("condition", "fuel")}
    counts = {r.column_name: (r["rows"], r.violations) for r in S.validate_domains(df, domains).collect()}
    assert counts == {"condition": (3, 2), "fuel": (3, 1)}
    assert [r.violations for r in S.flag_domains(df, domains).collect()] == [[], ["condition", "fuel"], ["condition"]]


def test_learned_stages_survive_saving(spark, tmp_path):
    df = spark.range(100).select(
        F.when(F.col("id") % 10 < 6, "a").when(F.col("id") % 10 < 9, "b").otherwise("c").alias("v"),
        F.col("id").cast("int").alias("price"),
    )
    stages = [
        RareGrouper(inputCols=["v"], k=[2]),
        QuantileTrimmer(inputCol="price", lower=0.15, qLo=0.15, qHi=0.75, relErr=0.0),
    ]
    fitted = Pipeline(stages=stages).fit(df)
    path = str(tmp_path / "cleaner")
    save_model(fitted, path)
    loaded = PipelineModel.load(path)
    once, again = fitted.transform(df), loaded.transform(df)
    assert once.exceptAll(again).isEmpty() and again.count() == 85
    assert {r.v for r in again.select("v").distinct().collect()} == {"a", "b", "others"}
    # A new frame gets the learned lists and fences, not its own.
    fresh = spark.createDataFrame([("c", 50), ("a", 5)], "v string, price int")
    assert [tuple(r) for r in loaded.transform(fresh).collect()] == [("others", 50)]
    unfitted = str(tmp_path / "stage")
    stages[1].save(unfitted)
    assert QuantileTrimmer.load(unfitted).getOrDefault("qHi") == 0.75


def test_scorer_of_the_training_job_groups_raw_values(spark, vehicles, tmp_path):
    cleaned = clean_and_learn(vehicles, CleanSpec(rel_err=0.0, top_k={"region": 5, "model": 5}))
    job = train_and_compare(cleaned.rows, SPEC, names=("Linear",), before=[cleaned.grouper()])
    path = str(tmp_path / "job")
    save_model(job.scorer("Linear"), path)
    known = request_to_df(spark, **{**SAMPLE, "model": "others", "manufacturer": "others"})
    raw = request_to_df(spark, **{**SAMPLE, "model": "never seen", "manufacturer": "lada"})
    prices = [r.prediction for r in S.score_listings(load_model(path), known.unionAll(raw), SPEC).collect()]
    assert prices[0] == prices[1] is not None
