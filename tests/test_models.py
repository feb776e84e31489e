import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quirework.functions import checksums
from quirework.plans import models


def test_registry():
    good = hashlib.sha256(b"x").hexdigest()
    m = models.Manifest("det", "ocr-text", "custom", "1", 1, {"a": good})
    heard = []
    r = models.Registry()
    r.listeners.append(lambda name, state: heard.append(state))
    r.add(m)
    with pytest.raises(ValueError, match="already"):
        r.add(m)
    with pytest.raises(ValueError, match="task"):
        r.add(models.Manifest("x", "cook", "custom", "1", 1))
    assert r.check("det", {"a": b"y"}) == "degraded" and not r.usable("ocr-text")
    assert r.check("det", {"a": b"x"}) == "available" and r.usable("ocr-text") == [m]
    with pytest.raises(ValueError, match="can't go"):
        r.move("det", "importing")
    assert heard == ["not-downloaded", "importing", "verifying", "degraded", "verifying", "available"]


def test_checksums(spark):
    df = spark.createDataFrame([(bytearray(b"hello"),), (None,)], "b binary")
    row = df.select(
        checksums.adler32("b").alias("a"), checksums.crc32(F.col("b")).alias("c"), checksums.matches_sha256(F.col("b"), F.lit(hashlib.sha256(b"hello").hexdigest().upper())).alias("s"),
        checksums.from_data_url(checksums.data_url(F.col("b"), "x/y")).alias("back"),
    ).collect()
    assert (row[0].a, row[0].c, row[0].s, bytes(row[0].back)) == (zlib.adler32(b"hello"), zlib.crc32(b"hello"), True, b"hello")
    assert (row[1].a, row[1].s, row[1].back) == (None, False, None)
