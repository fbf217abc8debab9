"""Files of a batch: what to take, where it goes, what is kept."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.functions.text import clean_path, stem_of, suffix_of
from lectern.operators.islands import running_sum

MOST_FILES = 500


def scan(files: DataFrame, suffixes: list[str]) -> DataFrame:
    """files (path, ...) with one of the suffixes, without those in hidden or .assets folders and lock files; ordered by lower-cased path."""
    folder = F.regexp_replace("path", r"[^/\\]*$", "")
    name = F.regexp_replace("path", r"^.*[/\\]", "")
    hidden = folder.rlike(r"(?i)(^|[/\\])\.[^/\\.][^/\\]*[/\\]|\.assets[/\\]") | name.startswith("~$")
    return files.where(~hidden & suffix_of(F.col("path")).isin(*suffixes)).orderBy(F.lower("path"))


def validate(paths: DataFrame, suffixes: list[str], most: int | None = MOST_FILES) -> DataFrame:
    """paths (ord, path, exists) with `path` cleaned and `reason`: null if accepted, else repeated, missing, unsupported or too many.

    A path that comes again in any case is a repetition; the first `most` accepted ones are taken, all if it is None. A
    batch takes some hundred files; the first are found as the least of each task, then of those.
    """
    x = paths.withColumn("path", clean_path(F.col("path"))).where("path <> ''")
    nth = F.row_number().over(Window.partitionBy(F.lower("path")).orderBy("ord"))
    x = x.withColumn("reason", F.when(nth > 1, "repeated").when(~F.col("exists"), "missing").when(~suffix_of(F.col("path")).isin(*suffixes), "unsupported"))
    if most is None:
        return x
    ok = x.where("reason is null").orderBy("ord").limit(most).select(F.col("ord").alias("_o"))
    x = x.join(ok, F.col("ord") == F.col("_o"), "left")
    return x.withColumn("reason", F.coalesce("reason", F.when(F.col("_o").isNull(), "too many"))).drop("_o")


def plan_outputs(files: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """files (ord, src, dest) with `reason`: claimed by an earlier file, same as the source, or existing; null if it is to be written."""
    nth = F.row_number().over(Window.partitionBy(F.lower("dest")).orderBy("ord"))
    x = files.withColumn("_nth", nth)
    if existing is not None:
        x = x.join(existing.select(F.lower("path").alias("_e")).distinct(), F.lower("dest") == F.col("_e"), "left")
    there = F.col("_e").isNotNull() if existing is not None else F.lit(False)
    reason = F.when(F.col("_nth") > 1, "claimed").when(F.lower("dest") == F.lower("src"), "source").when(there, "exists")
    return x.select(*files.columns, reason.alias("reason"))


def output_path(src: Column, content: Column, out_dir: str | None = None) -> Column:
    """The .md beside the source, or <stem>-<hash of the content>.md in out_dir."""
    from lectern.functions.text import content_tag

    if out_dir is None:
        return F.concat(F.regexp_replace(src, r"(?<=[^/\\])\.[^./\\]*$", ""), F.lit(".md"))
    return F.concat(F.lit(out_dir.rstrip("/") + "/"), stem_of(src), F.lit("-"), content_tag(content), F.lit(".md"))


def first_of_each(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """rows with `first` (whether it is the first of its keys), for deduplication that keeps the first."""
    return rows.withColumn("first", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)


def unique_names(files: DataFrame, keys: list[str], order: list) -> DataFrame:
    """files (keys, name, ...) with `unique`: the name, with -2, -3, ... before its ending from the second of its keys on."""
    nth = F.row_number().over(Window.partitionBy(*keys, F.lower("name")).orderBy(*order))
    stem, ending = F.regexp_replace("name", r"(?<=.)\.[^.]*$", ""), F.regexp_extract("name", r".(\.[^.]*)$", 1)
    return files.withColumn("unique", F.when(nth == 1, F.col("name")).otherwise(F.concat(stem, F.lit("-"), nth.cast("string"), ending)))


def asset_numbers(assets: DataFrame, slice_size: int = 100_000) -> DataFrame:
    """assets (doc_id, pos, digest, suffix) with `file`: img-0001, ... by the first place of each digest in its document.

    The images of a document are numbered in slices of `slice_size` places, side by side.
    """
    first = assets.groupBy("doc_id", "digest").agg(F.min(F.struct("pos", "suffix")).alias("f"))
    first = running_sum(first.withColumn("_one", F.lit(1)), ["doc_id"], ["f"], "_one", F.floor(F.col("f.pos") / slice_size), "_n")
    n = F.col("_n")
    named = first.select("doc_id", "digest", F.concat(F.lit("img-"), F.lpad(n.cast("string"), 4, "0"), F.col("f.suffix")).alias("file"))
    return assets.join(named, ["doc_id", "digest"]).select(*assets.columns, "file")


def is_ours(md: Column, marker: str, head: int = 4096) -> Column:
    """Whether the front matter within the first characters names the converter."""
    top = F.substring(md, 1, head)
    return F.coalesce(top.startswith("---\n") & F.contains(F.substring_index(F.substring(top, 5, head), "\n---", 1), F.lit(marker)), F.lit(False))


def expired(files: DataFrame, keep: DataFrame, cutoff: Column) -> DataFrame:
    """files (path, mtime, ...) older than cutoff and not in keep (path); an unknown time is not old."""
    return files.where(F.coalesce(F.col("mtime") < cutoff, F.lit(False))).join(keep.select("path").distinct(), "path", "left_anti")


def removable_assets(folders: DataFrame, surviving: DataFrame) -> DataFrame:
    """Asset folders (name) that no surviving Markdown file (stem) uses."""
    from lectern.functions.text import assets_name

    return folders.join(surviving.select(assets_name(F.col("stem")).alias("name")).distinct(), "name", "left_anti")


def top_level(dirs: DataFrame) -> DataFrame:
    """Folders (path) none of whose ancestors is in the table too."""
    d = dirs.select("path").distinct()
    parts = d.withColumn("_parts", F.split("path", "/"))
    above = parts.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_parts") - 1)), lambda i: F.array_join(F.slice("_parts", F.lit(1), i), "/"))).alias("_up")).where("_up <> path")
    inside = above.join(d.select(F.col("path").alias("_up")), "_up", "left_semi").select("path").distinct()
    return d.join(inside, "path", "left_anti")


def ending_counts(files: DataFrame) -> DataFrame:
    """(ending, n) by falling n, then ending."""
    return files.groupBy(suffix_of(F.col("path")).alias("ending")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ending")


def orphans(names: DataFrame, roster: DataFrame) -> DataFrame:
    """Distinct names that the roster lacks."""
    return names.select("name").distinct().join(roster.select("name"), "name", "left_anti")


def stranded(before: DataFrame, after: DataFrame, samples: DataFrame) -> DataFrame:
    """(name, samples): names that left the roster and still own samples."""
    gone = before.select("name").distinct().join(after.select("name"), "name", "left_anti")
    return samples.join(gone, "name", "left_semi").groupBy("name").agg(F.count("*").alias("samples"))


def renamed(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row (old, new) if exactly one name went and one came, else none."""
    b, a = before.select("name").distinct(), after.select("name").distinct()
    gone, come = b.join(a, "name", "left_anti"), a.join(b, "name", "left_anti")
    one = lambda df, n: df.agg(F.count("*").alias("n"), F.max("name").alias(n)).where("n = 1").select(F.lit(1).alias("k"), n)
    return one(gone, "old").join(one(come, "new"), "k").select("old", "new")


def word_list(lines: DataFrame, comments: bool = True) -> DataFrame:
    """(ord, word) of lines (ord, line): trimmed, without blanks, comments and repetitions, which keep their first place."""
    x = lines.withColumn("word", F.trim(F.replace("line", F.lit("﻿"), F.lit("")))).where("word <> ''")
    x = x.where(~F.col("word").startswith("#")) if comments else x
    return x.groupBy("word").agg(F.min("ord").alias("ord")).select("ord", "word")


def parse_rules(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ord, old, new) of lines with two words, and the others (ord, line) that are neither blank nor comments."""
    x = lines.withColumn("_t", F.split(F.trim("line"), r"\s+")).where((F.trim("line") != "") & ~F.trim("line").startswith("#"))
    good = x.where(F.size("_t") >= 2).select("ord", F.get("_t", F.lit(0)).alias("old"), F.get("_t", F.lit(1)).alias("new"))
    return good, x.where(F.size("_t") < 2).select("ord", "line")


def _resolved(path: Column) -> Column:
    """A path without ./ and folder/../ steps, the shortest pairs first, until none is left."""
    parts = F.filter(F.split(path, "/"), lambda p, i: (p != ".") & ((p != "") | (i == 0)))
    up = lambda acc, p: F.when((p == "..") & (F.size(acc) > 1), F.slice(acc, 1, F.size(acc) - 1)).when(p == "..", acc).otherwise(F.array_append(acc, p))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/")


def local_target(folder: Column, reference: Column) -> Column:
    """Path of a reference relative to folder, decoded and without query and fragment; null for URLs and what cannot be decoded."""
    clean = F.regexp_replace(F.try_url_decode(F.replace(reference, F.lit("+"), F.lit("%2B"))), r"[?#].*$", "")
    return F.when(~clean.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), _resolved(F.when(clean.startswith("/"), clean).otherwise(F.concat(folder, clean))))


def referenced_images(images: DataFrame, referrers: DataFrame) -> DataFrame:
    """Images (path) that no referrer (path, content string) names by a relative or absolute path.

    References are src, srcset and href values, Markdown targets and paths in back ticks.
    """
    head = F.col("content")
    found = F.concat(
        F.regexp_extract_all(head, F.lit(r"""(?i)(?:src|href)\s*=\s*["']([^"']+)["']"""), F.lit(1)),
        F.flatten(F.transform(F.regexp_extract_all(head, F.lit(r"""(?i)srcset\s*=\s*["']([^"']+)["']"""), F.lit(1)), lambda s: F.transform(F.split(s, ","), lambda p: F.split(F.trim(p), r"\s+")[0]))),
        F.regexp_extract_all(head, F.lit(r"\]\(<?([^)>\s]+)"), F.lit(1)),
        F.regexp_extract_all(head, F.lit(r"`([^`\n]+\.[A-Za-z]{2,5})`"), F.lit(1)),
    )
    refs = referrers.select(F.regexp_replace("path", r"[^/]*$", "").alias("folder"), F.explode(found).alias("ref"))
    named = refs.select(F.lower(local_target(F.col("folder"), F.col("ref"))).alias("_p")).where("_p is not null").distinct()
    return images.join(named, F.lower("path") == F.col("_p"), "left_anti")


#: An image in Markdown: before the target, the target, behind it.
_IMAGE = r"(!\[[^\]\n]*\]\(<?)([^)>\s]+)"


def copied_images(docs: DataFrame, images: DataFrame) -> DataFrame:
    """docs (doc_id, path, text, ...) with local image targets of the text replaced by images' (path, link), and `failed`: how many are not there.

    URLs and absolute paths stay. A target without an image stays too and counts as failed.
    """
    folder = F.regexp_replace("path", r"[^/]*$", "")
    x = docs.withColumns({"_before": F.regexp_extract_all("text", F.lit(_IMAGE), F.lit(1)), "_targets": F.regexp_extract_all("text", F.lit(_IMAGE), F.lit(2)), "_between": F.split("text", _IMAGE)})
    asked = x.select("doc_id", folder.alias("folder"), F.explode(F.array_distinct("_targets")).alias("target"))
    local = ~F.col("target").rlike(r"^([a-zA-Z][\w+.-]*:|/|\\\\|[a-zA-Z]:[\\/])")
    asked = asked.where(local).withColumn("_p", F.lower(local_target(F.col("folder"), F.col("target"))))
    found = asked.join(images.select(F.lower("path").alias("_p"), "link").dropDuplicates(["_p"]), "_p", "left")
    links = found.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("target", "link"))).alias("_links"))
    x = x.join(links, "doc_id", "left").withColumn("_links", F.coalesce("_links", F.create_map().cast("map<string,string>")))
    link = lambda t: F.coalesce(F.try_element_at("_links", t), t)
    images_of = F.zip_with("_before", "_targets", lambda b, t: F.concat(b, link(t)))
    failed = F.size(F.filter("_targets", lambda t: F.map_contains_key("_links", t) & F.try_element_at("_links", t).isNull()))
    text = F.array_join(F.zip_with("_between", images_of, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")
    return x.withColumns({"text": F.coalesce(text, F.col("text")), "failed": failed}).select(*docs.columns, "failed")


def same_stem(files: DataFrame, others: DataFrame, endings: list[str]) -> DataFrame:
    """files (path) with `found`: the path of others (path) in the same folder with the same stem; endings earlier in the list come first.

    Endings begin with a dot and may have several (.x.npz). A file without one has a null.
    """
    base = lambda p: F.regexp_replace(p, r"(?<=[^/\\])\.[^./\\]*$", "")
    ranked = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(e).alias("ending")) for i, e in enumerate(endings)])
    fit = others.select(F.col("path").alias("other"), F.explode(F.filter(ranked, lambda r: F.endswith(F.lower("path"), r["ending"]))).alias("r"))
    fit = fit.select("other", "r.rank", F.expr("substring(other, 1, length(other) - length(r.ending))").alias("_base"))
    first = fit.groupBy("_base").agg(F.min(F.struct("rank", "other"))["other"].alias("found"))
    return files.join(first, base(F.col("path")) == F.col("_base"), "left").select(*files.columns, "found")


def batch_outputs(converted: DataFrame, skipped: DataFrame, existing: DataFrame, supported: list[str]) -> DataFrame:
    """(path): outputs to read, each once in any case: those of converted (ord, out), then of skipped (ord, src, out) with a supported ending whose output is in existing (path)."""
    there = skipped.where(suffix_of(F.col("src")).isin(*supported)).join(existing.select(F.lower("path").alias("_e")).distinct(), F.lower("out") == F.col("_e"), "left_semi")
    both = converted.select(F.lit(0).alias("from"), "ord", F.col("out").alias("path")).unionByName(there.select(F.lit(1).alias("from"), "ord", F.col("out").alias("path")))
    return both.groupBy(F.lower("path").alias("_k")).agg(F.min(F.struct("from", "ord", "path")).alias("f")).select(F.col("f.from").alias("from"), "f.ord", "f.path")


def missing_defaults(defaults: DataFrame, present: DataFrame) -> DataFrame:
    """Default files (name, ...) to be put in place: those that are not there yet; nothing is replaced."""
    return defaults.join(present.select("name").distinct(), "name", "left_anti")


def mail_budget(attachments: DataFrame, most: int | None = 200, most_bytes: int = 2 << 30, most_one: int = 512 << 20):
    """attachments (mail_id, ord, size, ...) with `admitted`: in order, at most `most` (None: any number) and most_bytes of each mail.

    One that is too large by itself, or that would pass the bytes, is rejected and does not count; the next may fit.
    Because of that the attachments (small rows without their bytes) of a mail that is beyond a limit meet in one task;
    those of a mail that keeps all limits are admitted as they are.
    """
    import pandas as pd

    most = (1 << 62) if most is None else most

    def task(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord")
        n = used = 0
        out = []
        for size in rows["size"]:
            ok = n < most and size <= most_one and used + size <= most_bytes
            n, used = n + ok, used + size * ok
            out.append(bool(ok))
        return rows.assign(admitted=out)

    from pyspark.sql.types import BooleanType, StructType

    mail = Window.partitionBy("mail_id")
    slim = attachments.select("mail_id", "ord", "size")
    keeps = (F.count("*").over(mail) <= most) & (F.sum("size").over(mail) <= most_bytes) & (F.max("size").over(mail) <= most_one) & (F.count("size").over(mail) == F.count("*").over(mail))
    slim = slim.withColumn("keeps", F.coalesce(keeps, F.lit(False)))
    beyond = slim.where(~F.col("keeps")).drop("keeps")
    told = beyond.groupBy("mail_id").applyInPandas(task, StructType(beyond.schema.fields[:]).add("admitted", BooleanType()))
    told = slim.where("keeps").withColumn("admitted", F.lit(True)).drop("keeps").unionByName(told)
    return attachments.join(told.drop("size"), ["mail_id", "ord"])
