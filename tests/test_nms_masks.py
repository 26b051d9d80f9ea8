"""Greedy suppression over the whole of a tile."""

from types import SimpleNamespace

from atlasforge.plans import kernels


def test_boxes_across_a_multiple_of_64_are_compared(spark):
    rows = [(1, 0, False, 63, 0, 103, 40), (2, 0, False, 64, 0, 104, 40), (3, 1, False, 63, 0, 103, 40), (4, 0, False, 300, 0, 310, 10)]
    f = spark.createDataFrame(rows, "id long, tile_no long, err boolean, x0 long, y0 long, x1 long, y1 long")
    assert {r.id for r in kernels.nms_masks(SimpleNamespace(findings=f)).collect()} == {1, 3, 4}  # 1 scores 7919, 2 scores 5831
