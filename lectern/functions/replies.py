"""What workers send: vectors as text, results as JSON."""

import base64

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


@pandas_udf(StringType())
def vector_text(vectors: pd.Series) -> pd.Series:
    """Base64 of the elements as 32-bit floats, little-endian; null stays."""
    return vectors.map(lambda v: None if v is None else base64.b64encode(np.asarray(v, "<f4").tobytes()).decode())


def diarisation_reply(turns: Column, prints: Column, quality: Column) -> Column:
    """JSON of arrays of turns (start, end, speaker, conf), voice prints (speaker, vector text) and quality (speaker, segments, seconds, cohesion)."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    listed = lambda rows, row: F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(rows, F.array()), row), ","), F.lit("]"))
    turn = lambda t: F.concat(F.lit("["), F.concat_ws(",", text(t["start"]), text(t["end"]), text(t["speaker"]), text(t["conf"])), F.lit("]"))
    voice = lambda v: F.concat(F.lit("["), text(v["speaker"]), F.lit(',"'), v["vector"], F.lit('"]'))
    q = lambda x: F.concat(F.lit("["), F.concat_ws(",", text(x["speaker"]), text(x["segments"]), text(x["seconds"]), text(x["cohesion"])), F.lit("]"))
    return F.concat(F.lit('{"ok":true,"turns":'), listed(turns, turn), F.lit(',"vp":'), listed(prints, voice), F.lit(',"quality":'), listed(quality, q), F.lit("}"))


def recognised_lines(reply: Column) -> Column:
    """array<struct<box, text, score>> of a recogniser's JSON reply: parallel lists boxes, txts and scores; what is missing is empty or 0."""
    r = F.from_json(reply, "boxes array<array<array<double>>>, txts array<string>, scores array<double>")
    texts = F.coalesce(r["txts"], F.array().cast("array<string>"))
    box = lambda i: F.coalesce(F.get(r["boxes"], i), F.array().cast("array<array<double>>"))
    return F.transform(texts, lambda t, i: F.struct(box(i).alias("box"), t.alias("text"), F.coalesce(F.get(r["scores"], i), F.lit(0.0)).alias("score")))
