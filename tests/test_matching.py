"""Matching, assignment, tracks and curves against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlens.operators import matching, tracking


def _boxes(n_images, n, seed, score):
    rng = random.Random(seed)
    out = []
    for image in range(n_images):
        for b in range(rng.randint(0, n) if image else n):
            x, y = rng.randint(0, 60), rng.randint(0, 60)
            row = (image, image * 1000 + b, float(x), float(y), float(x + rng.randint(20, 60)), float(y + rng.randint(20, 60)))
            out.append((*row, round(rng.random(), 1)) if score else row)
    return out


def _iou(a, b):
    w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
    inter = max(0, w) * max(0, h)
    return inter / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - inter)


def _brute(dets, gts, thr):
    found = set()
    for image in {d[0] for d in dets}:
        free = sorted(g for g in gts if g[0] == image)
        for d in sorted((d for d in dets if d[0] == image), key=lambda d: (-d[6], d[1])):
            best = max(free, key=lambda g: (_iou(d, g), -g[1]), default=None)
            if best and _iou(d, best) >= thr:
                found.add((image, d[1], best[1]))
                free.remove(best)
    return found


def test_greedy_matches(spark):
    dets, gts = _boxes(6, 14, 1, True), _boxes(6, 14, 2, False)
    schema = "image long, box_id long, x1 double, y1 double, x2 double, y2 double"
    d, g = spark.createDataFrame(dets, schema + ", score double"), spark.createDataFrame(gts, schema)
    got = matching.match_detections(d, g, (0.2, 0.5)).collect()
    for thr in (0.2, 0.5):
        assert {(r["image"], r["det"], r["gt"]) for r in got if r["threshold"] == thr} == _brute(dets, gts, thr)


def test_a_crowded_image_is_matched_as_a_stream(spark):
    rng = random.Random(8)
    pairs = [(1, d, rng.randint(0, 1500), round(1 - d / 4000, 3), round(rng.uniform(0.3, 1), 2)) for d in range(2500) for _ in range(40)]
    pairs = list({(i, d, g): (i, d, g, s, o) for i, d, g, s, o in pairs}.values())
    df = spark.createDataFrame(pairs, "image long, det long, gt long, score double, iou double").repartition(8)
    got = matching.greedy_box_match(df, (0.5, 0.9)).collect()
    for thr in (0.5, 0.9):
        free, done, want = set(), set(), set()
        for _, d, g, _, o in sorted(pairs, key=lambda p: (-p[3], p[1], -p[4], p[2])):
            if o >= thr and d not in done and g not in free:
                done.add(d)
                free.add(g)
                want.add((d, g, o))
        assert {(r["det"], r["gt"], r["iou"]) for r in got if r["threshold"] == thr} == want


def test_pairs_meet_once_across_cells(spark):
    dets, gts = _boxes(3, 20, 5, True), _boxes(3, 20, 6, False)
    schema = "image long, box_id long, x1 double, y1 double, x2 double, y2 double"
    d, g = spark.createDataFrame(dets, schema + ", score double"), spark.createDataFrame(gts, schema)
    want = sorted((a[1], b[1]) for a in dets for b in gts if a[0] == b[0] and _iou(a, b) > 0)
    for cell in (7, 64, 4096):
        pairs = matching.box_pair_join(d, g, cell=cell)
        assert sorted((r["a_box_id"], r["b_box_id"]) for r in pairs.collect()) == want


def test_curve_is_monotone(spark):
    schema = "image long, box_id long, x1 double, y1 double, x2 double, y2 double"
    d = spark.createDataFrame(_boxes(6, 14, 1, True), schema + ", score double")
    g = spark.createDataFrame(_boxes(6, 14, 2, False), schema)
    curve = sorted(matching.pr_curve(d, g, (0.3,)).collect(), key=lambda r: r["tp"] + r["fp"])
    assert [r["tp"] + r["fp"] for r in curve] == list(range(1, d.count() + 1))
    assert all(a["precision"] >= b["precision"] and a["recall"] <= b["recall"] for a, b in itertools.pairwise(curve))


def test_nested_parts(spark):
    d = spark.createDataFrame(_boxes(2, 14, 1, True), "image long, box_id long, x1 double, y1 double, x2 double, y2 double, score double")
    parts = matching.nested_regroup(d.withColumn("label", F.lit(1)), chunk=4).filter("image = 0").orderBy("start").collect()
    scores = [s for p in parts for s in p["scores"]]
    assert [p["start"] for p in parts] == [0, 4, 8, 12] and len(scores) == 14 and scores == sorted(scores, reverse=True)


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for n, m in [(1, 1), (3, 3), (2, 5), (5, 2), (5, 5), (1, 4)]:
        for _ in range(20):
            cost = rng.random((n, m))
            pairs = tracking.solve_assignment(cost)
            assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == min(n, m)
            total = sum(cost[i, j] for i, j in pairs)
            small, large = (cost, m) if n <= m else (cost.T, n)
            best = min(sum(small[i, p[i]] for i in range(min(n, m))) for p in itertools.permutations(range(large), min(n, m)))
            assert abs(total - best) < 1e-9


def test_track_chain(spark):
    boxes = spark.createDataFrame(
        [(1, f, f * 10 + s, 10 * s, 0, 10 * s + 5, 5, "nonmoth" if (f, s) == (2, 1) else "moth") for f in range(9) for s in range(2)],
        "deployment long, frame long, box_id long, x1 long, y1 long, x2 long, y2 long, class string")
    links = spark.createDataFrame([(1, f, f * 10, f * 10 - 10, 0.1) for f in range(1, 9)], "deployment long, frame long, cur long, prev long, cost double")
    out = {r["box_id"]: r for r in tracking.export_tracks(tracking.track_ids(boxes, links)).collect()}
    assert {out[f * 10]["track_id"] for f in range(9)} == {"1"}
    assert out[21]["track_id"] == "NA" and out[1]["track_id"] == "2" and out[11]["track_id"] == "3"
    assert out[10]["prev_x"] == out[0]["centre_x"] and out[0]["prev_x"] is None


def test_crowded_frames_are_linked_whole(spark):
    side = 36  # 1,296 boxes a frame, each moved by one pixel
    rows = [(1, f, f * 10_000 + i, i % side * 40 + f, i // side * 40, i % side * 40 + f + 20, i // side * 40 + 20, "moth", [1.0, i % 7 + 1.0])
            for f in range(2) for i in range(side * side)]
    boxes = spark.createDataFrame(rows, "deployment long, frame long, box_id long, x1 long, y1 long, x2 long, y2 long, class string, feature array<double>")
    links = tracking.frame_assignment(boxes).collect()
    assert len(links) == side * side and all(r["cur"] - r["prev"] == 10_000 for r in links)


def test_assignment_costs_are_those_of_the_pairs(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        x, y = rng.randint(0, 80), rng.randint(0, 80)
        rows.append((1, i // 6, i, x, y, x + rng.randint(5, 40), y + rng.randint(5, 40), "moth" if i % 11 else "nonmoth", [rng.random() + 0.1 for _ in range(4)]))
    boxes = spark.createDataFrame(rows, "deployment long, frame long, box_id long, x1 long, y1 long, x2 long, y2 long, class string, feature array<double>")
    cost = {(r["cur"], r["prev"]): r["cost"] for r in tracking.frame_pairs(boxes).collect()}
    links = tracking.frame_assignment(boxes).collect()
    assert links and all(r["cost"] == pytest.approx(cost[r["cur"], r["prev"]], abs=1e-9) for r in links)
    assert tracking.frame_assignment(boxes.limit(0)).isEmpty()


def test_hard_frames_do_not_depend_on_tiles(spark, rows):
    frames = [(v, f, "b" if f in (7, 20, 40) else "a", 0.9 if f != 30 else 0.2) for v in range(2) for f in range(60)]
    df = spark.createDataFrame(frames, "video long, frame long, class string, confidence double")
    want = rows(tracking.hard_example_window(df, 3, 0.5, tile=10_000), "video", "frame", "correct_class")
    assert want == [(v, f, "a") for v in range(2) for f in (20, 40, 7)]
    assert rows(tracking.hard_example_window(df, 3, 0.5, tile=8), "video", "frame", "correct_class") == want


@pytest.mark.parametrize("segment", [1, 3, 1000])
def test_tracks_do_not_depend_on_segments(spark, monkeypatch, segment):
    monkeypatch.setattr(tracking, "SEGMENT", segment)
    rng = random.Random(segment)
    boxes, links, parent = [], [], {}
    for d in range(2):
        last: list[int] = []
        for f in range(25):
            if rng.random() < 0.1:
                last = []
                continue
            own = [d * 10_000 + f * 100 + i for i in range(rng.randint(1, 6))]
            boxes += [(d, f, b, b % 50, 0, b % 50 + 4, 6, "moth" if b % 7 else "nonmoth") for b in own]
            free = [p for p in last if p % 7]
            rng.shuffle(free)
            for b in own:
                if b % 7 and free and rng.random() < 0.8:
                    parent[b] = free.pop()
                    links.append((d, f, b, parent[b], 0.5))
            last = own
    schema = "deployment long, frame long, box_id long, x1 long, y1 long, x2 long, y2 long, class string"
    got = tracking.track_ids(spark.createDataFrame(boxes, schema).repartition(5), spark.createDataFrame(links, "deployment long, frame long, cur long, prev long, cost double")).collect()

    def root(b):
        return root(parent[b]) if b in parent else b

    frames = {b[2]: b[1] for b in boxes}
    order = {d: sorted({root(b[2]) for b in boxes if b[0] == d and b[7] == "moth"}, key=lambda r: (frames[r], r)) for d in range(2)}
    assert len(got) == len(boxes)
    for r in got:
        b = r["box_id"]
        assert r["track_id"] == (order[r["deployment"]].index(root(b)) + 1 if b % 7 else None)
        assert r["prev_x"] == (parent[b] % 50 + 2 if b in parent else None) and r["prev_y"] == (3 if b in parent else None)
