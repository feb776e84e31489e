"""Checksums and data URLs of binary columns."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.LongType())
def adler32(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else zlib.adler32(b))


def crc32(data: Column) -> Column:
    return F.crc32(data)


def matches_sha256(data: Column, digest: Column) -> Column:
    """Whether a hexadecimal SHA-256 is that of the data, whatever its case."""
    return F.coalesce(F.sha2(data, 256) == F.lower(digest), F.lit(False))


def data_url(data: Column, mime: str) -> Column:
    return F.concat(F.lit(f"data:{mime};base64,"), F.base64(data))


def from_data_url(url: Column) -> Column:
    """Bytes of a data URL; null where it is none."""
    body = F.regexp_extract(url, r"^data:[^,]*;base64,([A-Za-z0-9+/=\s]*)$", 1)
    return F.when(url.rlike(r"^data:[^,]*;base64,"), F.unbase64(body))
