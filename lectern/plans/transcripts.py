"""From segments and turns to a transcript."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.functions.text import degenerate_note, is_degenerate
from lectern.operators.intervals import assign_speakers, cohesion
from lectern.operators.islands import speech_blocks
from lectern.operators.repeats import repeated_phrases
from lectern.operators.transcripts import combine_tracks, render_transcript, speaker_hints, speaker_quality


def mark_degenerate(segments: DataFrame) -> DataFrame:
    """segments with the text of those that repeat themselves replaced by a marker."""
    flagged = segments.withColumn("_bad", F.coalesce(is_degenerate(F.col("text")), F.lit(False)))
    key = F.xxhash64("rec_id", "seq")
    phrases = repeated_phrases(flagged.where("_bad").select(key.alias("doc_id"), "text")).withColumnRenamed("doc_id", "_id")
    x = flagged.withColumn("_id", key).join(phrases, "_id", "left")
    return x.withColumn("text", F.when(F.col("_bad"), degenerate_note(F.col("start"), F.col("end"), F.col("phrase"))).otherwise(F.col("text"))).select(*segments.columns)


def transcribe(segments: DataFrame, turns: DataFrame, title: Column) -> dict[str, DataFrame]:
    """transcripts (rec_id, md), blocks with cohesion, hints and quality of segments and turns."""
    spoken = mark_degenerate(assign_speakers(segments, turns))
    quality = speaker_quality(turns)
    blocks = speech_blocks(spoken).withColumnRenamed("block", "seq")
    return {"transcripts": render_transcript(spoken, title, quality), "blocks": cohesion(blocks, turns), "hints": speaker_hints(spoken), "quality": quality}


def transcribe_tracks(mic: DataFrame, system: DataFrame, title: Column) -> DataFrame:
    """(rec_id, md) of two tracks of spoken segments: the microphone's echoes of the system go, speakers are numbered over both."""
    from lectern.operators.repeats import without_echoes

    both = without_echoes(mic, system).withColumn("track", F.lit("mic")).unionByName(system.withColumn("track", F.lit("system")))
    x = combine_tracks(both)
    order = F.row_number().over(Window.partitionBy("rec_id").orderBy("start", "end", "track", "seq"))
    return render_transcript(x.select("rec_id", order.alias("seq"), "start", "end", F.col("number").alias("speaker"), "text"), title)
