"""The registered query delivers the latent vectors themselves."""

import numpy as np

from rankloom.plans import ranking


def test_vectors_come_out(spark):
    got = ranking.latent_vectors(spark, "/root/testdata/sf0.001").collect()
    v = np.array([r["v"] for r in got])
    size = np.linalg.norm(v, axis=1)
    assert v.shape[1] == min(128, len(got) - 1) > 64 and np.all(np.isclose(size, 1) | (size == 0)) and (size > 0).mean() > 0.5
    assert len(np.unique(v.round(6), axis=0)) > len(got) / 2 and 0 < got[0]["explained"] <= 1 + 1e-9
