"""The models of a training run are trained side by side."""

import threading

from motionlake.plans import learned


def test_three_models_are_trained_at_once(spark, sf_dir, monkeypatch):
    meet, asked = threading.Barrier(3), []

    def predictions(rows, features, target, name, *a, **how):
        asked.append((target, name))
        meet.wait(20)
        return spark.createDataFrame([(target, name, True, 1, "a", "a")], "target string, model string, held_out boolean, id long, truth string, predicted string")

    monkeypatch.setattr(learned.training, "predictions", predictions)
    found = learned.training_run(spark, sf_dir)
    assert sorted(asked) == sorted((t, m) for t in ("label_name", "distortion") for m in ("lightgbm", "svm_rbf", "knn"))
    assert found.count() == 6
