import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[4]").appName("expirylens-tests")
         .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g")
         .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


TOKENS = ("image_id string, token_index int, text string, confidence double, detection_confidence double, "
          "bbox struct<x1:double,y1:double,x2:double,y2:double>, source string")


@pytest.fixture
def token_table(spark):
    """Build a token table from {image: [(text, confidence, bbox, source, detection), ...]}."""
    def build(images: dict):
        rows = []
        for image, tokens in images.items():
            for i, t in enumerate(tokens):
                text, conf, box, source, det = (list(t) + [None] * 5)[:5] if isinstance(t, tuple) else (t, 0.9, None, None, None)
                rows.append((image, i, text, 0.9 if conf is None else conf, det, tuple(map(float, box)) if box else None, source))
        return spark.createDataFrame(rows, TOKENS)
    return build
