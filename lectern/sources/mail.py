"""Mail files and their attachments, to a bounded depth."""

import email
import email.message
import email.policy
from email.headerregistry import HeaderRegistry
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lectern.operators.batches import mail_budget
from lectern.sources.archives import in_batches
from lectern.sources.shared import stored

DEPTH = 3
HEADERS = ("from", "to", "cc", "date", "subject")
_READER = HeaderRegistry()


@lru_cache(maxsize=4096)
def _kept(name: str, value: str):
    return _READER(name, value)


def _header(name: str, value: str):
    """A header as read by the library; short ones that are alike are read once by a task."""
    return _kept(name, value) if len(value) < 1000 else _READER(name, value)


#: The library asks for the headers of a part again and again, and reads them anew each time.
_POLICY = email.policy.default.clone(header_factory=_header)


def message(raw: bytes) -> email.message.EmailMessage:
    return email.message_from_bytes(raw, policy=_POLICY)


def mail_parts(files: DataFrame) -> DataFrame:
    """(doc_id, headers map<string,string>, body, is_html, attachments array<struct<name, data>>) of (doc_id, content) messages.

    The body is the first plain text part, else the first HTML part. Named parts are attachments; messages within a
    message too. Other columns of files go along, in front of headers.
    """
    kind = pa.list_(pa.struct([("name", pa.string()), ("data", pa.binary())]))
    found = [("headers", pa.map_(pa.string(), pa.string())), ("body", pa.string()), ("is_html", pa.bool_()), ("attachments", kind)]
    more = [c for c in files.columns if c not in ("doc_id", "content")]

    def one(raw: bytes):
        whole = message(raw)
        plain = page = None
        attached = []
        for part in whole.walk():
            name = part.get_filename()
            if part.get_content_type() == "message/rfc822":
                inner = part.get_payload()
                attached.append({"name": name or "message.eml", "data": inner[0].as_bytes() if isinstance(inner, list) and inner else b""})
            elif part.is_multipart():
                continue
            elif name or part.get_content_disposition() == "attachment":
                attached.append({"name": name or "attachment", "data": part.get_payload(decode=True) or b""})
            elif part.get_content_type() == "text/plain" and plain is None:
                plain = part.get_content()
            elif part.get_content_type() == "text/html" and page is None:
                page = part.get_content()
        heads = {h: str(whole[h]) for h in HEADERS if whole[h]}
        return heads, plain if plain is not None else page or "", plain is None and page is not None, attached

    def read(batch):
        given = [batch.column(c).to_pylist() for c in ("doc_id", *more)]
        for *known, content in zip(*given, batch.column("content")):
            raw = content.as_py() or b""
            heads, body, is_html, attached = one(raw)
            yield (*known, list(heads.items()), body, is_html, attached), len(raw)

    def run(batches):
        for batch in batches:
            schema = pa.schema([("doc_id", pa.int64()), *[(c, batch.schema.field(c).type) for c in more], *found])
            yield from in_batches(read(batch), schema)

    kinds = dict(files.dtypes)
    also = "".join(f"{c} {kinds[c]}, " for c in more)
    return files.select(F.col("doc_id").cast("long"), *more, "content").mapInArrow(run, f"doc_id long, {also}headers map<string,string>, body string, is_html boolean, attachments array<struct<name string, data binary>>")


def opened(files: DataFrame) -> DataFrame:
    """mail_parts of (doc_id, content) messages with path and above, as attachments() starts from."""
    return mail_parts(files.select("doc_id", F.array().cast("array<int>").alias("path"), F.array(F.sha2("content", 256)).alias("above"), "content"))


def attachments(messages: DataFrame, depth: int = DEPTH, most: int | None = 200) -> DataFrame:
    """(mail_id, path array<int>, depth, name, data, digest, reason) of all attachments, those of attached messages included.

    messages are files (doc_id, content) or what opened() made of them. reason is null for what is taken, else `cycle` (the
    same content as a message above it), `budget` (see mail_budget; `most` of a mail, None: all) or `depth`. A round stores
    what was attached to the messages of one level and opens those that are among it, so there are at most `depth` rounds
    and each message is opened once.
    """
    from lectern.operators.batches import suffix_of

    found = messages if "attachments" in messages.columns else opened(messages)
    out = None
    for level in range(1, depth + 1):
        x = found.select(F.col("doc_id").alias("mail_id"), "path", "above", F.posexplode("attachments").alias("i", "a"))
        x = x.select("mail_id", F.concat("path", F.array(F.col("i").cast("int"))).alias("path"), "above", F.col("a.name").alias("name"), F.col("a.data").alias("data"), F.sha2("a.data", 256).alias("digest"))
        reason = F.when(F.array_contains("above", F.col("digest")), "cycle")
        x = x.select("mail_id", "path", F.lit(level).alias("depth"), "name", "data", "digest", reason.alias("reason"), "above")
        x = stored(x, "attached")
        out = x if out is None else out.unionByName(x)
        front = x.where((suffix_of(F.col("name")) == ".eml") & F.col("reason").isNull()).select(F.col("mail_id").alias("doc_id"), "path", F.concat("above", F.array("digest")).alias("above"), F.col("data").alias("content"))
        if front.isEmpty():
            break
        found = mail_parts(front)
    sized = out.select("mail_id", F.array_join(F.transform("path", lambda p: F.lpad(p.cast("string"), 6, "0")), ".").alias("ord"), F.length("data").cast("long").alias("size"), "path", "depth", "name", "data", "digest", "reason")
    admitted = mail_budget(sized.where("reason is null"), most)
    kept = admitted.withColumn("reason", F.when(~F.col("admitted"), "budget")).drop("admitted")
    return kept.unionByName(sized.where("reason is not null").select(*kept.columns)).drop("ord", "size")


def header_lines(headers, labels: dict[str, str] | None = None):
    """Markdown list items of the headers that are there, in a fixed order."""
    items = [F.when(F.coalesce(F.try_element_at(headers, F.lit(h)), F.lit("")) != "", F.concat(F.lit(f"- {(labels or {}).get(h, h)}:"), F.try_element_at(headers, F.lit(h)))) for h in HEADERS]
    return F.array_join(F.array_compact(F.array(*items)), "\n")


def web_archives(files: DataFrame) -> DataFrame:
    """(doc_id, html, resources map<string, binary>) of MHTML files: the first HTML part, and the others by location and content id."""
    schema = pa.schema([("doc_id", pa.int64()), ("html", pa.string()), ("resources", pa.map_(pa.string(), pa.binary()))])

    def run(batches):
        for batch in batches:
            for doc_id, content in zip(batch.column("doc_id").to_pylist(), batch.column("content")):
                page, found = None, {}
                for part in message(content.as_py() or b"").walk():
                    if part.is_multipart():
                        continue
                    if part.get_content_type() == "text/html" and page is None:
                        page = part.get_content()
                        continue
                    data = part.get_payload(decode=True) or b""
                    for key in (part["Content-Location"], part["Content-ID"] and f"cid:{str(part['Content-ID']).strip('<>')}"):
                        if key:
                            found[str(key)] = data
                yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([page], pa.string()), pa.array([list(found.items())], schema.field("resources").type)], schema=schema)

    return files.select(F.col("doc_id").cast("long"), "content").mapInArrow(run, "doc_id long, html string, resources map<string,binary>")
