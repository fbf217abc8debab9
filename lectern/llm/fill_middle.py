"""Fill-in-middle transformation with column expressions only.

A text becomes an array of units (runs of letters, and single other characters). Two
places among the units, drawn from a digest of the row's id, cut it into prefix,
middle and suffix, which are put into another order behind sentinels. What a model
is to fill in then stands last, and the order can be undone from the text alone.
"""

from pyspark.sql import Column, DataFrame, functions as F

from lectern.llm.common import table

UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of the texts that are rearranged, and of these the percent with the suffix first.
RATE, SPM_RATE = 90, 20


def draws(doc_id: Column, seed: int = 1) -> list[Column]:
    """Four numbers of 32 bits from the SHA-256 of `<seed>:<doc_id>`; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def arranged(form: Column, prefix: Column, middle: Column, suffix: Column, text: Column) -> Column:
    """The text that stands for the pieces: suffix or prefix first, the middle last; other forms leave the text."""
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)


def restored(output: Column, form: Column) -> Column:
    """The text from which `output` was made, by its sentinels. None of them is in the pieces, nor over the end of one."""

    def between(left: str, right: str) -> Column:
        start = F.instr(output, left) + len(left)
        return F.substring(output, start, F.instr(output, right) - start)

    last = F.substring(output, F.instr(output, MIDDLE) + len(MIDDLE), F.length(output))
    psm = F.concat(between(PREFIX, SUFFIX), last, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), last, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = 1) -> DataFrame:
    """docs with columns n, form (`plain`, `psm`, `spm`), prefix, middle, suffix and output; one row for each row.

    n is the number of units of the text. Null texts count as empty. Empty texts, those that contain a sentinel, and the
    share that is not drawn stay as they are (`plain`, null pieces). Rows of the same id and text have equal results; a
    null id counts as an empty one. Columns of these names in docs are replaced, helper columns (`_units`, `_h`, `_one`, `_two`, `_a`, `_b`) too. A row needs nothing of other rows, so
    nothing is shuffled.
    """
    added = ("n", "form", "prefix", "middle", "suffix", "output")
    x = docs.drop(*[c for c in added if c not in (text, doc_id)])
    whole = F.coalesce(F.col(text), F.lit(""))
    h = draws(F.col(doc_id), seed)
    x = x.withColumns({"_units": F.regexp_extract_all(whole, F.lit(UNIT), F.lit(0)), "_h": F.array(*h)})
    n = F.size("_units")
    x = x.withColumns({"_one": F.col("_h")[0] % (n + 1), "_two": F.col("_h")[1] % (n + 1)})
    kept = (whole == "") | F.contains(whole, F.lit(PREFIX)) | F.contains(whole, F.lit(SUFFIX)) | F.contains(whole, F.lit(MIDDLE)) | (F.col("_h")[2] % 100 >= rate)
    x = x.withColumns({"form": F.when(kept, F.lit("plain")).when(F.col("_h")[3] % 100 < spm_rate, F.lit("spm")).otherwise(F.lit("psm")), "_a": F.least("_one", "_two").cast("int"), "_b": F.greatest("_one", "_two").cast("int")})
    moved = F.col("form") != "plain"
    piece = lambda start, length: F.when(moved, F.array_join(F.slice("_units", start, length), ""))
    a, b = F.col("_a"), F.col("_b")
    x = x.withColumns({"prefix": piece(F.lit(1), a), "middle": piece(a + 1, b - a), "suffix": piece(b + 1, n - b), "n": n.cast("long")})
    return x.withColumn("output", arranged(F.col("form"), F.col("prefix"), F.col("middle"), F.col("suffix"), whole)).drop("_units", "_h", "_one", "_two", "_a", "_b")


def query(spark, sf_dir):
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


ORACLE = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents
), numbers AS (
  SELECT doc_id, t, u, len(u) AS n, CAST('0x' || substr(d, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(d, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(d, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) AS h4 FROM drawn
), cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers
), pieces AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM cuts
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256
FROM pieces
"""
