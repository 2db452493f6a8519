"""Kernel machines score rows without moving their mapped features."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel

from scorelake.models import hinge, stages, training
from scorelake.sources.models import load_models, save_models


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(1500, 2)), 2)
    y = ((x ** 2).sum(axis=1) + rng.normal(scale=0.3, size=1500) > 1.4).astype(int)
    rows = spark.createDataFrame([(i, int(y[i]), *map(float, x[i])) for i in range(1500)], "id long, y int, a double, b double")
    return training.assemble(rows, "id", "y", ["a", "b"], partitions=3).persist()


def found(rows):
    return {r.row_id: r for r in rows.collect()}


def test_margins_are_those_of_stage_after_stage(table, tmp_path):
    model = stages.KernelSVM(components=40, calibrationFolds=3).fit(table)
    assert "project(" not in model.transform(table).select("row_id", "prediction", "probability")._jdf.queryExecution().optimizedPlan().toString()
    one, other = found(model.transform(table)), found(PipelineModel(model.stages).transform(table))
    assert one.keys() == other.keys() and len(one) == 1500
    for k, r in one.items():
        assert r.prediction == other[k].prediction
        for name in ("kernel_features", "rawPrediction", "margin", "probability"):
            assert r[name].toArray() == pytest.approx(other[k][name].toArray(), abs=1e-9)
    save_models(table.sparkSession, {"SVM": PipelineModel([model])}, str(tmp_path / "models"))
    again = load_models(table.sparkSession, str(tmp_path / "models"))["SVM"].stages[0]
    assert isinstance(again, stages.KernelMachineModel) and again.uid == model.uid
    assert {k: (r.prediction, r.probability) for k, r in found(again.transform(table)).items()} == {
        k: (r.prediction, r.probability) for k, r in one.items()}


def test_no_rows(table):
    model = stages.KernelSVM(components=40, calibrationFolds=3).fit(table)
    assert model.transform(table.where("row_id < 0")).collect() == []


def test_a_fit_calibrates_without_mapped_columns(table, monkeypatch):
    mapped = []
    monkeypatch.setattr(stages.FourierFeatures, "_transform", lambda *given: mapped.append(given))
    model = stages.KernelSVM(components=40, calibrationFolds=3).fit(table)
    assert not mapped
    monkeypatch.undo()
    # The curve is that of the margins which every fold gets from the machine that had not seen it.
    plain = stages.KernelSVM(components=40, calibrationFolds=3)._fit_held(table)
    scores = [{r.row_id: r.probability[1] for r in m.transform(table).collect()} for m in (model, plain)]
    assert np.mean([abs(scores[0][k] - scores[1][k]) for k in scores[0]]) < 0.02


def test_blocks_map_rows_into_one_array():
    rng = np.random.default_rng(3)
    n = hinge.CHUNK + 700
    x, within = rng.normal(size=(n, 3)) * 50, rng.random(n) < 0.8
    block = hinge.Block({"x": x.tobytes(), "y": (np.arange(n) % 2).astype(np.int8).tobytes(), "fold": (np.arange(n) % 5).astype(np.int16).tobytes(),
                         "within": np.stack([np.zeros(n, bool), within], axis=1).tobytes()})
    omega, phase = rng.normal(size=(3, 20)), rng.uniform(0, 6, 20)
    held, rows = [], []
    for z, y, fold in block.mapped(1, omega, phase):
        held.append(z.base if z.base is not None else z)
        rows += [z.copy()]
    assert np.concatenate(rows) == pytest.approx(np.cos(x[within] @ omega + phase) * np.sqrt(2 / 20), abs=1e-5)
    assert all(h is held[0] for h in held) and not list(block.mapped(0, omega, phase))
