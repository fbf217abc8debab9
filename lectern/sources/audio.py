"""16 kHz mono WAV files: how much can be read, and ranges of samples."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, ShortType

RATE, HEADER = 16000, 44


def available_seconds(length: Column) -> Column:
    """Seconds of whole samples in a file of so many bytes, header not counted; a growing file's header is not to be trusted."""
    return F.greatest(F.lit(0), F.floor((length - HEADER) / 2)) / RATE


@pandas_udf(ArrayType(ShortType()))
def samples(content: pd.Series) -> pd.Series:
    """Samples of a file's bytes."""
    return content.map(lambda b: np.frombuffer(bytes(b or b"")[HEADER:], "<i2", count=max(0, (len(b or b"") - HEADER) // 2)))


def span(pcm: Column, start: Column, end: Column) -> Column:
    """Samples from start to end seconds; what lies outside is left out."""
    a, b = F.greatest(F.lit(0), F.floor(start * RATE)), F.least(F.size(pcm).cast("long"), F.floor(end * RATE))
    return F.when(b > a, F.slice(pcm, (a + 1).cast("int"), (b - a).cast("int"))).otherwise(F.array().cast("array<smallint>"))


def to_float(pcm: Column) -> Column:
    return F.transform(pcm, lambda x: x / F.lit(32768.0))


def merge_stereo(left: Column, right: Column) -> Column:
    """Pairs of samples; the shorter side is padded with silence."""
    return F.zip_with(left, right, lambda a, b: F.struct(F.coalesce(a, F.lit(0)).alias("left"), F.coalesce(b, F.lit(0)).alias("right")))


def cut_and_join(pcm: Column, spans: Column, gap: float = 0.45, pad: float = 0.25) -> Column:
    """Samples of spans (array of start and end), each with `pad` around it, with `gap` seconds of silence between them."""
    silence = F.array_repeat(F.lit(0).cast("smallint"), int(gap * RATE))
    return F.flatten(F.transform(spans, lambda s, i: F.concat(F.when(i > 0, silence).otherwise(F.array().cast("array<smallint>")), span(pcm, s["start"] - pad, s["end"] + pad))))


def tumbling_rms(files: DataFrame, seconds: float = 0.5) -> DataFrame:
    """(rec_id, at, rms) for each window of `seconds` of (rec_id, pcm); computed within the array, a row for each window."""
    n = int(seconds * RATE)
    at = F.posexplode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("pcm") - 1), F.lit(n))).alias("w", "from")
    x = files.where(F.size("pcm") > 0).select("rec_id", "pcm", at)
    part = F.slice("pcm", F.col("from") + 1, n)
    square = F.aggregate(part, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    return x.select("rec_id", (F.col("w") * seconds).alias("at"), F.sqrt(square / F.size(part)).alias("rms"))
