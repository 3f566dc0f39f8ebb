from roadlens import catalog
from roadlens.plans import inspect

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return catalog.QUERIES[name](spark, SF)


def test_filters_and_columns_reach_the_scan(spark):
    df = plan(spark, "star_join")
    assert any("o_orderstatus" in f for f in inspect.pushed_filters(df))
    assert {"o_custkey", "o_orderstatus", "o_totalprice"} in inspect.columns_read(df)


def test_no_all_pairs_joins(spark):
    for name in ("merge_both_nullable", "iou_pairs", "nearest_speed", "points_in_boxes", "overlapping_boxes", "precision_recall_curve", "panoptic_relabel", "depth_image"):
        assert not inspect.all_pairs(plan(spark, name)), name


def test_aggregates_shuffle_once(spark):
    assert inspect.shuffles(plan(spark, "segmentation_iou")) <= 2
    assert inspect.shuffles(plan(spark, "unique_ids")) == 1  # row numbers that nothing reads are pruned
    assert inspect.shuffles(plan(spark, "keypoint_pck")) == 1


def test_expressions_stay_in_the_engine(spark):
    for name in ("merge_iou_precision_recall", "motion_map", "keypoint_oks", "occupancy_auc", "range_image_points"):
        assert not any("Python" in o or "Pandas" in o or "Arrow" in o for o in inspect.operators(plan(spark, name))), name
