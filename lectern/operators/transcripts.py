"""Transcripts: speakers' numbers and hints, Markdown out and in, renaming."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.functions.labels import DIAGNOSTICS_TITLE, REASSIGNED_ENTRY, REASSIGNED_NOBODY, REASSIGNED_NOTE, TRANSCRIPT_TITLE, UNKNOWN, UNKNOWN_SPEAKER
from lectern.functions.text import is_marker, lines, rename_at_once, speaker_label
from lectern.functions.times import hms
from lectern.operators.intervals import label_blocks
from lectern.operators.islands import first_appearance, islands, speech_blocks, upper_median

#: A speaker's line (fixed pattern).
LABEL_LINE = r"^\*\*(.+?)\*\* \((\d+):([0-5]\d):([0-5]\d)\)\s*$"


def speaker_hints(spoken: DataFrame, most_seconds: float = 60.0) -> DataFrame:
    """(rec_id, speaker, segments, text, start, end): each speaker's longest text, the first of equals.

    Texts of up to most_seconds come before longer ones, and those before markers (of which the first is taken).
    """
    tier = F.when(is_marker(F.col("text")), 0).when(F.col("end") - F.col("start") <= most_seconds, 2).otherwise(1)
    size = F.when(tier == 0, 0).otherwise(F.length(F.coalesce("text", F.lit(""))))
    # a text without characters is no hint of its tier
    tier = F.when((tier > 0) & (size == 0), -1).otherwise(tier)
    best = F.max(F.struct(tier.alias("tier"), size.alias("size"), (-F.col("seq")).alias("at"), F.coalesce("text", F.lit("")).alias("text"), "start", "end")).alias("b")
    return spoken.groupBy("rec_id", "speaker").agg(F.count("*").alias("segments"), best).select("rec_id", "speaker", "segments", "b.text", "b.start", "b.end")


def speaker_quality(turns: DataFrame, known: Column | None = None) -> DataFrame:
    """(rec_id, speaker, segments, seconds, cohesion) of turns; cohesion is the mean conf, 0 without one. Unknown speakers are left out."""
    x = turns.where(F.col("speaker") != UNKNOWN_SPEAKER)
    return x.groupBy("rec_id", "speaker").agg(F.count("*").alias("segments"), F.sum(F.greatest(F.lit(0.0), F.col("end") - F.col("start"))).alias("seconds"), F.coalesce(F.avg(F.when(known, F.col("conf")) if known is not None else F.col("conf")), F.lit(0.0)).alias("cohesion"))


def _element(values: str) -> Column:
    """Element n // 2 of a sorted array column."""
    return F.get(F.col(values), F.floor(F.size(values) / 2).cast("int"))


def check_first(quality: DataFrame, gap: float = 0.10, most: int = 3, least_speakers: int = 3) -> DataFrame:
    """The up to `most` speakers of a recording whose cohesion is `gap` below its upper median, worst first (then by speaker).

    A recording has few speakers (30 at most), so their values fit an array.
    """
    middle = quality.groupBy("rec_id").agg(F.sort_array(F.collect_list("cohesion")).alias("v")).where(F.size("v") >= least_speakers).select("rec_id", _element("v").alias("middle"))
    low = quality.join(middle, "rec_id").where(F.col("cohesion") <= F.col("middle") - gap)
    low = low.withColumn("place", F.row_number().over(Window.partitionBy("rec_id").orderBy("cohesion", "speaker")))
    return low.where(F.col("place") <= most).select("rec_id", "place", "speaker", "cohesion")


def unknown_stats(spoken: DataFrame) -> DataFrame:
    """(rec_id, segments, seconds, upper_median) of the unknown speaker's segments; the median is taken from counts of equal lengths."""
    x = spoken.where(F.col("speaker") == UNKNOWN_SPEAKER).select("rec_id", (F.col("end") - F.col("start")).alias("d"))
    return x.groupBy("rec_id").agg(F.count("*").alias("segments"), F.sum("d").alias("seconds")).join(upper_median(x, ["rec_id"], "d"), "rec_id", "left")


def render_transcript(spoken: DataFrame, title: Column, quality: DataFrame | None = None) -> DataFrame:
    """(rec_id, md): title, then label line and text of each block; with quality, a table of the speakers' numbers at the end.

    spoken: rec_id, seq, start, end, speaker, text. title is an expression of rec_id. A recording's transcript is one
    value, so its blocks meet in one row.
    """
    blocks = speech_blocks(spoken)
    part = F.concat(F.lit("**"), speaker_label(F.col("speaker")), F.lit("** ("), hms(F.col("start")), F.lit(")\n"), F.col("text"), F.lit("\n"))
    body = blocks.groupBy("rec_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", part.alias("p")))), lambda s: s["p"]), "\n").alias("body"))
    md = F.concat(F.lit(TRANSCRIPT_TITLE), title, F.lit("\n\n"), F.col("body"))
    if quality is None:
        return body.select("rec_id", md.alias("md"))
    turns = blocks.where(F.col("speaker") != UNKNOWN_SPEAKER).groupBy("rec_id", "speaker").agg(F.count("*").alias("turns"))
    noted = body.join(speaker_notes(quality, turns), "rec_id", "left")
    return noted.select("rec_id", F.concat(md, F.coalesce(F.concat(F.lit("\n"), "notes"), F.lit(""))).alias("md"))


def speaker_notes(quality: DataFrame, turns: DataFrame) -> DataFrame:
    """(rec_id, notes): the table of the speakers' numbers (quality) and of how often each has the word (turns: rec_id, speaker, turns)."""
    row = F.concat(F.lit("| "), speaker_label(F.col("speaker")), F.lit(" | "), F.coalesce("turns", F.lit(0)).cast("string"), F.lit(" | "), hms(F.col("seconds")), F.lit(" | "), F.format_string("%.2f", F.col("cohesion")), F.lit(" |"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("speaker", row.alias("r")))), lambda s: s["r"]), "\n")
    head = f"{DIAGNOSTICS_TITLE}\n\n| 講者 | 發言輪次 | 總時長 | 群內一致性 |\n| --- | ---: | ---: | ---: |\n"
    return quality.join(turns, ["rec_id", "speaker"], "left").groupBy("rec_id").agg(F.concat(F.lit(head), rows, F.lit("\n")).alias("notes"))


def transcript_lines(transcripts: DataFrame) -> DataFrame:
    """(rec_id, at, line, in_notes, name, start) for each line of (rec_id, md); name and start where it is a speaker's line above the notes."""
    x = transcripts.select("rec_id", F.posexplode(lines(F.col("md"))).alias("at", "line"))
    notes = x.where(F.trim("line").startswith(DIAGNOSTICS_TITLE)).groupBy("rec_id").agg(F.min("at").alias("notes_at"))
    x = x.join(notes, "rec_id", "left").withColumn("in_notes", F.coalesce(F.col("at") >= F.col("notes_at"), F.lit(False)))
    part = lambda i: F.regexp_extract("line", LABEL_LINE, i)
    own = F.col("line").rlike(LABEL_LINE) & ~F.col("in_notes")
    return x.select("rec_id", "at", "line", "in_notes", F.when(own, part(1)).alias("name"), F.when(own, part(2).cast("long") * 3600 + part(3).cast("long") * 60 + part(4).cast("long")).cast("double").alias("start"))


def parse_transcripts(transcripts: DataFrame) -> DataFrame:
    """(rec_id, seq, name, start, text) from (rec_id, md): a row for each speaker's line; its text is the lines below, joined by one space.

    Blank lines and the notes at the end are left out; a transcript without a speaker's line gives no row.
    """
    x = islands(transcript_lines(transcripts).where("not in_notes"), ["rec_id"], ["at"], F.col("name").isNotNull(), "seq").where("seq > 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("name").isNull() & (F.trim("line") != ""), F.struct("at", F.trim("line").alias("t"))))), lambda s: s["t"]), " ")
    return x.groupBy("rec_id", "seq").agg(F.max("name").alias("name"), F.max("start").alias("start"), text.alias("text"))


def labels_in(transcripts: DataFrame) -> DataFrame:
    """(rec_id, number, name): the names of a transcript's lines, from 1 in order of appearance; the unknown one has UNKNOWN_SPEAKER."""
    first = parse_transcripts(transcripts).groupBy("rec_id", "name").agg(F.min("seq").alias("at"))
    known = F.col("name") != UNKNOWN
    nth = F.sum(known.cast("int")).over(Window.partitionBy("rec_id").orderBy("at"))
    return first.select("rec_id", F.when(known, nth).otherwise(UNKNOWN_SPEAKER).cast("int").alias("number"), "name")


def renamed_in(names: Column, old: str, new: str) -> Column:
    """A map of names with the value old replaced by new."""
    old, new = old.strip(), new.strip()
    return F.transform_values(names, lambda k, v: F.when(v == old, F.lit(new)).otherwise(v)) if old and new and old != new else names


def _joined(x: DataFrame) -> DataFrame:
    return x.groupBy("rec_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda s: s["line"]), "\n").alias("md"))


def rename_speakers(transcripts: DataFrame, names: dict[str, str]) -> DataFrame:
    """(rec_id, md) with speakers renamed in their lines, in the rows of the notes' table and where the notes name them."""
    table = F.create_map(*[F.lit(v) for pair in names.items() for v in pair]) if names else None
    if table is None:
        return transcripts.select("rec_id", "md")
    new = F.element_at(table, F.col("name"))
    row = r"^\| ([^|]+?) \| (?=\d)"
    in_row = F.element_at(table, F.regexp_extract("line", row, 1))
    marked = {f"{a}{k}{b}": f"{a}{v}{b}" for k, v in names.items() for a, b in (("**", "**"), ("「", "」"))}
    x = transcript_lines(transcripts)
    line = (
        F.when(new.isNotNull(), F.concat(F.lit("**"), new, F.regexp_extract("line", r"^\*\*.+?(\*\* \(\d+:[0-5]\d:[0-5]\d\)\s*)$", 1)))
        .when(F.col("in_notes") & F.col("line").rlike(row) & in_row.isNotNull(), F.concat(F.lit("| "), in_row, F.regexp_extract("line", r"^\| [^|]+?( \| \d.*)$", 1)))
        .when(F.col("in_notes"), rename_at_once(F.col("line"), marked))
        .otherwise(F.col("line"))
    )
    return _joined(x.withColumn("line", line))


def reassign(transcripts: DataFrame, wanted: DataFrame, new_name: str) -> DataFrame:
    """(rec_id, md, moved): speaker's lines get new_name where wanted (rec_id, name, start, times) asks for the first `times` of a (name, second)."""
    x = transcript_lines(transcripts).withColumn("second", F.floor("start"))
    nth = F.row_number().over(Window.partitionBy("rec_id", "name", "second").orderBy("at"))
    ask = wanted.groupBy("rec_id", "name", F.floor("start").alias("second")).agg(F.sum("times").alias("times"))
    x = x.withColumn("nth", nth).join(ask, ["rec_id", "name", "second"], "left")
    hit = F.col("name").isNotNull() & F.coalesce(F.col("nth") <= F.col("times"), F.lit(False))
    x = x.withColumn("hit", hit).withColumn("line", F.when(F.col("hit"), F.concat(F.lit(f"**{new_name}"), F.regexp_extract("line", r"^\*\*.+?(\*\* \(\d+:[0-5]\d:[0-5]\d\)\s*)$", 1))).otherwise(F.col("line")))
    return _joined(x).join(x.groupBy("rec_id").agg(F.sum(F.col("hit").cast("int")).alias("moved")), "rec_id")


def relabel_blocks(parsed: DataFrame, turns: DataFrame) -> DataFrame:
    """parsed blocks (rec_id, seq, name, start, text) with `speaker` from new turns, numbered by first appearance; neighbours are not merged."""
    from lectern.operators.intervals import block_bounds

    labelled = label_blocks(block_bounds(parsed), turns)
    numbered = first_appearance(labelled, ["rec_id"], F.col("seq"), "label", "speaker", UNKNOWN_SPEAKER)
    return numbered.drop("label", "end")


def recluster(transcripts: DataFrame, turns: DataFrame, quality: DataFrame) -> DataFrame:
    """(rec_id, md): transcripts (rec_id, md) with the speakers of new turns in their lines, and the notes made anew from quality.

    No other line changes, and no two lines of one speaker are put together, so that it can be done again with other turns.
    Speakers are numbered by first appearance, in the notes too; those of quality without a line are left out there. A
    transcript without turns has one speaker; one without speakers' lines keeps its text.
    """
    from lectern.operators.intervals import block_bounds

    blocks = label_blocks(block_bounds(parse_transcripts(transcripts)), turns)
    blocks = first_appearance(blocks, ["rec_id"], F.col("seq"), "label", "speaker", UNKNOWN_SPEAKER).select("rec_id", "seq", "label", "speaker")
    turn = F.coalesce(F.col("speaker") != F.lag("speaker").over(Window.partitionBy("rec_id").orderBy("seq")), F.lit(True))
    said = blocks.withColumn("turn", turn).groupBy("rec_id", "speaker").agg(F.count_if("turn").alias("turns")).where(F.col("speaker") != UNKNOWN_SPEAKER)
    numbered = quality.withColumnRenamed("speaker", "label").join(blocks.select("rec_id", "label", "speaker").distinct(), ["rec_id", "label"]).where(F.col("speaker") != UNKNOWN_SPEAKER).drop("label")
    x = islands(transcript_lines(transcripts).where("not in_notes"), ["rec_id"], ["at"], F.col("name").isNotNull(), "seq").join(blocks, ["rec_id", "seq"], "left")
    line = F.when(F.col("name").isNotNull(), F.concat(F.lit("**"), speaker_label(F.col("speaker")), F.lit("** ("), F.regexp_extract("line", r"\((\d+:[0-5]\d:[0-5]\d)\)\s*$", 1), F.lit(")"))).otherwise(F.col("line"))
    body = _joined(x.withColumn("line", line)).join(speaker_notes(numbered, said), "rec_id", "left")
    return body.select("rec_id", F.concat(F.regexp_replace("md", r"\n+$", ""), F.coalesce(F.concat(F.lit("\n\n"), "notes"), F.lit("\n"))).alias("md"))


def note_reassigned(md: Column, names: Column, new_name: Column, moved: Column) -> Column:
    """md with an entry below the title of its notes that says how many lines of names (an array) went to new_name by hand.

    Entries stand below one heading in the order in which they came. A text without notes, and one of which nothing was
    moved, stays as it is.
    """
    rows = F.split(F.regexp_replace(md, r"\n$", ""), "\n")
    at = F.array_position(F.transform(rows, lambda r: F.trim(r).startswith(DIAGNOSTICS_TITLE)), True)
    who = F.when(F.coalesce(F.size(names), F.lit(0)) > 0, F.array_join(F.transform(names, lambda n: F.concat(F.lit("「"), n, F.lit("」"))), "、")).otherwise(F.lit(REASSIGNED_NOBODY))
    before, of, to, end = REASSIGNED_ENTRY
    entry = F.concat(F.lit(before), who, F.lit(of), moved.cast("string"), F.lit(to), new_name, F.lit(end))
    some = lambda start, length=None: F.slice(rows, start, F.greatest(F.lit(0), length if length is not None else F.size(rows))).cast("array<string>")
    head = F.array_position(F.transform(rows, lambda r, i: (r == REASSIGNED_NOTE) & (i >= at)), True)
    # entries of before end where a line is none
    other = F.array_position(F.transform(rows, lambda r, i: (i >= head) & ~r.startswith("> ")), True)
    last = F.when(other > 0, other - 1).otherwise(F.size(rows)).cast("int")
    first_time = F.concat(some(F.lit(1), at.cast("int")), F.array(F.lit(""), F.lit(REASSIGNED_NOTE), entry), some(at.cast("int") + 1))
    again = F.concat(some(F.lit(1), last), F.array(entry), some(last + 1))
    noted = F.concat(F.array_join(F.when(head > 0, again).otherwise(first_time), "\n"), F.when(md.endswith("\n"), "\n").otherwise(""))
    return F.when((F.coalesce(moved, F.lit(0)) > 0) & (at > 0), noted).otherwise(md)


def speakers_after(parsed: DataFrame, turns: DataFrame) -> DataFrame:
    """(rec_id, speakers): how many known speakers a transcript would have with new turns."""
    x = relabel_blocks(parsed, turns)
    return x.groupBy("rec_id").agg(F.countDistinct(F.when(F.col("speaker") != UNKNOWN_SPEAKER, F.col("speaker"))).alias("speakers"))


def combine_tracks(segments: DataFrame) -> DataFrame:
    """Segments (rec_id, track, start, end, speaker, text) of all tracks with `number`: speakers of a recording, told apart by track,
    counted from 0 in order of (start, end, track); unknown ones stay."""
    key = F.struct("start", "end", "track")
    known = segments.where(F.col("speaker") != UNKNOWN_SPEAKER)
    first = known.groupBy("rec_id", "track", "speaker").agg(F.min(key).alias("first"))
    numbers = first.withColumn("number", F.row_number().over(Window.partitionBy("rec_id").orderBy("first")) - 1).drop("first")
    return segments.join(numbers, ["rec_id", "track", "speaker"], "left").withColumn("number", F.coalesce("number", F.lit(UNKNOWN_SPEAKER)))
