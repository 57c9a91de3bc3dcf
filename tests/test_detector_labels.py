"""Label lines of detectors, written and read back."""

import glob

from expirylens.sources.readers import read_detector_labels
from expirylens.sources.writers import detector_label_lines, write_detector_labels


def test_lines_come_back_in_few_files(spark, tmp_path):
    rows = [(f"i{n % 40}" if n % 11 else "tab\tname", n, n % 4, 0.5, 0.25, 0.125, n / 1000) for n in range(400)] + [(None, 0, 1, 0.5, 0.5, 0.5, 0.5)]
    boxes = spark.createDataFrame(rows, "image_id string, box_index int, class int, cx double, cy double, width double, height double")
    path = str(tmp_path / "labels")
    write_detector_labels(boxes, path, "date_due_full", buckets=5)
    files = glob.glob(path + "/bucket=*/part-*")
    assert 1 <= len(files) <= 5
    want = [(r.image_id or "", r.value) for r in detector_label_lines(boxes, "date_due_full").collect()]
    back = read_detector_labels(spark, path).collect()
    assert sorted((r.image_id, r.value) for r in back) == sorted(want) and len(want) > 200
    assert all(r.value == f"{r['class']} {r.cx:.6f} {r.cy:.6f} {r.width:.6f} {r.height:.6f}" for r in back)
    for f in files:  # an image's lines stand together, in box order
        with open(f) as lines:
            seen = [x.rsplit("\t", 1) for x in lines.read().splitlines()]
        assert [n for n, _ in seen] == sorted(n for n, _ in seen)
        assert all(a[1].split()[4] <= b[1].split()[4] for a, b in zip(seen, seen[1:]) if a[0] == b[0] != "")


def test_empty(spark, tmp_path):
    boxes = spark.createDataFrame([], "image_id string, box_index int, class int, cx double, cy double, width double, height double")
    write_detector_labels(boxes, str(tmp_path / "none"))
