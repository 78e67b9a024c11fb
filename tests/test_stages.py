import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

from panelkit import catalog
from panelkit.models import stages
from panelkit.operators import impute, selection


FEATURES = [*[f for f in catalog.FEATURES if f not in ("SIRS", "Gender")][:4], "SIRS"]
SMALL = dict(features=FEATURES, sweeps=1, method="binned", k=3)


def told(df):
    rows = df.select("row_id", vector_to_array("probability")[1].alias("p"), vector_to_array("latent").alias("l"))
    return rows.orderBy("row_id").toPandas()


@pytest.fixture(scope="module")
def fitted(cohort):
    return stages.training_pipeline("row_id", hidden=(6,), max_iter=25, **SMALL).fit(cohort)


def test_pipeline_is_saved_and_loaded(cohort, fitted, tmp_path):
    path = str(tmp_path / "pipeline")
    fitted.write().overwrite().save(path)
    again = PipelineModel.load(path)
    assert [type(s) for s in again.stages] == [type(s) for s in fitted.stages]
    want, got = told(fitted.transform(cohort)), told(again.transform(cohort))
    assert np.allclose(want.p, got.p, atol=1e-12) and np.allclose(want.l.to_list(), got.l.to_list(), atol=1e-12)
    assert again.stages[2].selected == fitted.stages[2].selected and again.stages[2].chi2 == fitted.stages[2].chi2
    assert BinaryClassificationEvaluator(labelCol=catalog.LABEL).evaluate(again.transform(cohort)) > 0.85


def test_stages_do_what_the_operators_do(cohort, fitted):
    im = impute.ChainedImputer(FEATURES, max_iter=1).fit(cohort, "row_id")
    plain = im.transform(cohort, "row_id")
    filled = fitted.stages[0].transform(cohort)
    assert filled.exceptAll(plain).isEmpty()
    clipped = fitted.stages[1].transform(filled)
    chosen = selection.TwoTierSelector(method="binned").fit(clipped, catalog.LABEL, FEATURES)
    assert fitted.stages[2].selected == chosen.selected


def test_unfitted_pipeline_is_saved_and_loaded(tmp_path):
    pipeline = stages.training_pipeline("row_id", hidden=(3, 2), sweeps=4)
    pipeline.save(str(tmp_path / "plain"))
    again = type(pipeline).load(str(tmp_path / "plain"))
    assert again.getStages()[4].getOrDefault("hidden") == [3, 2] and again.getStages()[0].getOrDefault("maxIter") == 4


def test_cross_validation_over_a_stage(cohort):
    pipeline = stages.training_pipeline("row_id", hidden=(4,), max_iter=10, **SMALL)
    selector = pipeline.getStages()[2]
    grid = ParamGridBuilder().addGrid(selector.nContinuous, [1, 3]).build()
    judge = BinaryClassificationEvaluator(labelCol=catalog.LABEL)
    best = CrossValidator(estimator=pipeline, estimatorParamMaps=grid, evaluator=judge, numFolds=2, seed=1).fit(cohort)
    assert len(best.avgMetrics) == 2 and all(m > 0.5 for m in best.avgMetrics)
    continuous = [f for f in best.bestModel.stages[2].selected if f not in ("SIRS", "Gender")]
    assert len(continuous) == grid[int(np.argmax(best.avgMetrics))][selector.nContinuous]


def test_nothing_to_fit(cohort):
    with pytest.raises(ValueError, match="no rows"):
        stages.LatentReducer(inputCol="v").fit(cohort.limit(0).selectExpr("array(1.0) as a").select(
            array_to_vector("a").alias("v")))
