"""Links between vectors whose squares doubles can't hold."""

import pytest

from fathom.llm.vectors import near_vectors


@pytest.mark.parametrize("scale", [5e-324, 1e-310, 1e-170, 1.0, 1e160, 1.5e308])
def test_scale_does_not_matter(spark, scale):
    rows = [(1, [scale, 0.0, scale], 1), (2, [1.0, 0.0, 1.0], 1), (3, [0.0, scale, 0.0], 1), (4, [0.0, 0.0, 0.0], 1), (5, [0.0, 2.0, 0.0], 1), (6, [scale, 0.0, scale], 2)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert {(r.vec_id, r.n_links, r.component_id) for r in got.collect()} == {(1, 1, 1), (2, 1, 1), (3, 1, 3), (5, 1, 3), (4, 0, 4), (6, 0, 6)}
