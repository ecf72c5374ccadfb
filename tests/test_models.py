import numpy as np

from tracklake.operators import models


def test_classifier_projection_and_mixture(spark):
    r = np.random.default_rng(0)
    rows = [(i, (r.normal(size=5) + (3.0 if i % 3 == 0 else 0.0)).tolist(), "pos" if i % 3 == 0 else "neg") for i in range(300)]
    df = spark.createDataFrame(rows, "i int, v array<double>, label string")
    for components in (None, 2):
        fitted = models.fit_classifier(df.where("i < 200").union(df.limit(1).selectExpr("-1 AS i", "v", "cast(null AS string) AS label")), "v", "label", components)
        got = models.classify(fitted, df.where("i >= 200").drop("label"), "v").collect()
        assert np.mean([g.predicted == ("pos" if g.i % 3 == 0 else "neg") for g in got]) > 0.95
        assert all(abs(sum(g.probability) - 1) < 1e-6 and len(g.probability) == 2 for g in got)
    p = np.array([g.pca for g in models.project(df, "v", 2).collect()])
    assert p.shape == (300, 2) and p[:, 0].std() > p[:, 1].std()
    two = spark.createDataFrame([(float(x),) for x in np.concatenate([r.normal(0, 1, 200), r.normal(8, 1, 200)])], "x double")
    one = spark.createDataFrame([(float(x),) for x in r.normal(0, 1, 300)], "x double")
    assert models.bimodality(two, "x")[1] and not models.bimodality(one, "x")[1] and models.bimodality(one.limit(5), "x") is None
