"""Manifests of screens, and which changed elements they know."""

import pytest

from sightline.operators import visual

FRAME = "pair_id long, keyframe_id string, scroll_y long, element_ids array<string>"
MEASURED = "pair_id long, keyframe_id string, hpid string, found boolean, viewport_x double, viewport_y double, width double, height double, in_viewport boolean, misalign_reason string"


@pytest.fixture(scope="module")
def entries(spark):
    frames = spark.createDataFrame([(1, "kf_0", 0, ["1.1", "1.2"]), (1, "kf_1", 600, ["2.1", "2.2", "2.3"])], FRAME)
    measured = [
        (1, "kf_0", "1.1", True, 0.0, -10.0, 50.0, 40.0, True, None), (1, "kf_0", "1.2", False, None, None, None, None, None, "detached"),
        (1, "kf_1", "2.1", True, 5.0, -100.0, 20.0, 50.0, True, None), (1, "kf_1", "2.3", True, 5.0, 590.0, 20.0, 30.0, False, "covered"),
    ]
    return visual.manifest(frames, spark.createDataFrame(measured, MEASURED), 600)


def test_manifest(entries):
    got = {r.hpid: r for r in entries.collect()}
    flat = {h: (r.rect and tuple(r.rect), r.raw_rect and tuple(r.raw_rect), r.misaligned, r.misalign_reason, r.rect_clipped, r.scroll_y) for h, r in got.items()}
    assert flat == {
        "1.1": ((0.0, 0.0, 50.0, 30.0), (0.0, -10.0, 50.0, 40.0), False, None, True, 0),
        "1.2": (None, None, True, "detached", False, 0), "2.2": (None, None, True, "element-not-found", False, 600),
        "2.1": (None, None, True, "clipped-below-fold", True, 600),  # nothing of it is to be seen
        "2.3": ((5.0, 590.0, 20.0, 10.0), (5.0, 590.0, 20.0, 30.0), True, "covered", True, 600),
    }


def test_diff_map_and_pseudo_styles(spark, entries):
    pseudo = spark.createDataFrame([(1, "1.1", "content: a", None)], "pair_id long, hpid string, before string, after string")
    base = visual.with_pseudo(entries, pseudo)
    other = entries.filter("hpid in ('1.1', '2.1')").withColumn("keyframe_id", entries.keyframe_id.substr(1, 3).cast("string")).replace("kf_", "kf_3", "keyframe_id")
    changed = spark.createDataFrame([(1, "1.1"), (1, "1.1"), (1, "1.2"), (1, "9")], "pair_id long, hpid string")
    got = {r.hpid: r for r in visual.diff_map(changed, base, other).collect()}
    assert set(got) == {"1.1", "1.2"}
    one, two = got["1.1"], got["1.2"]
    assert (one.keyframes_differ, one.baseline_keyframe_id, one.compare_keyframe_id, one.baseline_pseudo_before, one.baseline_rect_clipped, one.compare_misaligned) == (True, "kf_0", "kf_3", "content: a", True, False)
    assert (two.keyframes_differ, two.baseline_misaligned, two.compare_misaligned, two.compare_keyframe_id, two.compare_rect) == (False, True, False, None, None)
