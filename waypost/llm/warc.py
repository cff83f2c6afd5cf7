"""WARC archives of pages: written and read back as a table of records and chunks.

A payload of at most CHUNK bytes is one row from the scan to the archive and back. An oversized one becomes rows of
record identifier and chunk number: Spark slices it, a task streams the slices and carries the running digest, and
the archive holds a record per slice, the first and its `continuation` records, as the format provides for. No step
after the scan holds a whole oversized payload. Digests of small payloads are column functions.

Archives are written by Spark's text writer with the record separator as line separator, so they can lie in any store
that Spark reaches. They are read by the text reader with the record mark (`WARC/1.0` and a line end) as separator,
so a file may be split between tasks at any place. For that the mark must not stand in a payload: the writer cuts a
payload inside each mark, as if it were oversized. A record whose block has not the stated length, or whose payload
not the stated digest, is an error.

Of records with equal payloads (length and SHA-256) of at least `least` bytes, those with the largest page_id are
responses and all others are revisits that name it. Defined cases: a null html is an empty payload; a null page_id
is below all others (if all of a group are null, they are responses); repeated rows are records of their own that
share their record's identifier, told apart by a row number; line ends in a url are escaped; other columns are
ignored; an empty table gives an archive without records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypost.llm.common import attach_groups, settled, shared_folder

#: Bytes of a slice; a payload beyond it is oversized.
CHUNK = 65_536
#: Revisit records that may be broadcast to the writing scan.
MAX_REVISITS = 200_000
#: Fixed values of the format: the line before each record's fields, what ends the fields and the record, base32 digits.
MARK, END = "WARC/1.0\r\n", "\r\n\r\n"
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + END
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def base32(hexes: Column) -> Column:
    """Base32 of a digest of 40 hex digits: every ten of them are eight digits of base 32."""
    parts = [F.lpad(F.conv(F.substring(hexes, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), HEX32, BASE32)


def with_payload(pages: DataFrame) -> DataFrame:
    """page_id, url, the payload, its length, whether it must be cut, and the identifier of its record."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    df = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url") if "url" in pages.columns else F.lit("").alias("url"),
        body.alias("html"),
        F.octet_length(body).cast("bigint").alias("size"),
        F.xxhash64(body).alias("hash"),
        F.monotonically_increasing_id().alias("row"),
    )
    return df.withColumn("record", record_id(F.col("page_id")))


def record_id(page_id: Column) -> Column:
    """The identifier of a page's record, from the page and its payload's hash and length."""
    key = F.concat_ws(":", F.coalesce(page_id.cast("string"), F.lit("")), F.col("hash").cast("string"), F.col("size").cast("string"))
    return F.regexp_replace(F.md5(key.cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def slices(rows: DataFrame, chunk: int) -> DataFrame:
    """A row per slice of each payload, in order: all columns but html, then chunk (number), last, data."""
    count = F.greatest(F.lit(1), F.ceil(F.col("size") / chunk)).cast("int")
    df = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), count - 1)))
    data = F.substring(F.col("html").cast("binary"), F.col("chunk") * chunk + 1, F.lit(chunk))
    return df.withColumn("last", F.col("chunk") == count - 1).withColumn("data", data).drop("html")


def streamed_digests(chunks: DataFrame, carry: list[str], *, strong: bool) -> DataFrame:
    """Of chunk rows that lie in order: the carried columns, payload_bytes, payload_digest and (`strong`) SHA-256 of each record."""
    fields = {f.name: f.dataType.simpleString() for f in chunks.schema.fields}

    def stream(batches):
        plain, wide, size = hashlib.sha1(), hashlib.sha256(), 0
        for batch in batches:
            data = batch.column("data")
            done, found = [], []
            for i, last in enumerate(batch.column("last").to_pylist()):
                piece = data[i].as_buffer()
                plain.update(piece)
                if strong:
                    wide.update(piece)
                size += piece.size
                if last:
                    done.append(i)
                    found.append((size, base64.b32encode(plain.digest()).decode(), wide.hexdigest() if strong else None))
                    plain, wide, size = hashlib.sha1(), hashlib.sha256(), 0
            kept = batch.select(carry).take(pa.array(done, pa.int64()))
            n, digest, strong_digest = zip(*found) if found else ((), (), ())
            columns = [*kept.columns, pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(strong_digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*carry, "payload_bytes", "payload_digest", "sha256"])

    schema = ", ".join(f"`{c}` {fields[c]}" for c in carry)
    return chunks.select(*carry, "last", "data").mapInArrow(stream, schema + ", payload_bytes bigint, payload_digest string, sha256 string")


def payload_digests(rows: DataFrame, chunk: int) -> DataFrame:
    """page_id, hash, size, record, payload_digest, sha256 of every payload."""
    keys = ["page_id", "hash", "size", "record"]
    body = F.col("html").cast("binary")
    small = rows.where(F.col("size") <= chunk).select(*keys, base32(F.sha1(body)).alias("payload_digest"), F.sha2(body, 256).alias("sha256"))
    large = streamed_digests(slices(rows.where(F.col("size") > chunk), chunk), keys, strong=True)
    return small.unionByName(large.drop("payload_bytes"))


def revisit_records(digests: DataFrame, least: int) -> DataFrame:
    """record, payload_digest, target (page_id), target_record of the records that are written as revisits, one row each."""
    same = digests.where(F.col("size") >= least).withColumn("payload", F.concat_ws(":", "sha256", F.col("size").cast("string")))
    groups = same.groupBy("payload").agg(F.max("page_id").alias("target"), F.count("*").alias("n")).where("n > 1")
    total = same.agg(F.count("*")).first()[0]
    found = attach_groups(same, groups, "payload", "n", total, F.col("record"))
    later = found.where(F.col("target").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("target")))
    return later.select("record", "payload_digest", "target", record_id(F.col("target")).alias("target_record")).dropDuplicates(["record"])


def fields(*pairs: tuple[str, Column | str]) -> Column:
    """The mark and the fields of a record; a field without a value is left out."""
    lines = [F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value)) for name, value in pairs]
    return F.concat(F.lit(MARK), F.concat_ws("\r\n", *lines), F.lit(END))


def common_fields(kind: str, record: Column) -> list[tuple[str, Column | str]]:
    return [
        ("WARC-Type", kind), ("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), record, F.lit(">"))), ("WARC-Date", DATE),
        ("WARC-Target-URI", F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        ("X-Page-ID", F.col("page_id").cast("string")), ("X-Row", F.col("row").cast("string")),
    ]


def cut_records(chunks: DataFrame) -> DataFrame:
    """A record (value) per piece of payloads that need cutting: each slice, cut again inside every mark in it."""
    mark, http = MARK.encode(), HTTP.encode()

    def cut(batches):
        plain, size, number = hashlib.sha1(), 0, 0
        for batch in batches:
            values = []
            heads = batch.column("head").to_pylist()
            for i, (last, data) in enumerate(zip(batch.column("last").to_pylist(), batch.column("data").to_pylist())):
                plain.update(data)
                size += len(data)
                starts, at = [0], data.find(mark)
                while at >= 0:
                    starts.append(at + 4)
                    at = data.find(mark, at + 4)
                for a, b in zip(starts, [*starts[1:], len(data)]):
                    number += 1
                    end = last and b == len(data)
                    block = (http if number == 1 else b"") + data[a:b]
                    kind = "response" if number == 1 else "continuation"
                    lines = [f"{MARK}WARC-Type: {kind}", heads[i], f"WARC-Segment-Number: {number}", f"Content-Length: {len(block)}"]
                    if number == 1:
                        lines.append("Content-Type: application/http; msgtype=response")
                    if end:
                        digest = base64.b32encode(plain.digest()).decode()
                        lines += [f"WARC-Segment-Total-Length: {size}", f"WARC-Payload-Digest: sha1:{digest}"]
                    values.append("\r\n".join(lines).encode() + END.encode() + block)
                if last:
                    plain, size, number = hashlib.sha1(), 0, 0
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary())], ["value"])

    return chunks.select("head", "last", "data").mapInArrow(cut, "value binary").select(F.col("value").cast("string").alias("value"))


def write_archives(rows: DataFrame, revisits: DataFrame, path: str, *, chunk: int = CHUNK, compression: str | None = None) -> None:
    """Write a record per row of `with_payload`; `revisits` names those without a payload of their own."""
    if revisits.limit(MAX_REVISITS + 1).count() <= MAX_REVISITS:
        revisits = F.broadcast(revisits)
    marked = rows.withColumn("cut", (F.col("size") > chunk) | F.contains(F.col("html"), F.lit(MARK)))
    joined = marked.join(revisits, "record", "left")
    again = fields(
        *common_fields("revisit", F.col("record")), ("WARC-Profile", PROFILE),
        ("WARC-Refers-To", F.concat(F.lit("<urn:uuid:"), F.col("target_record"), F.lit(">"))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), ("Content-Length", "0"),
    )
    length = (F.col("size") + len(HTTP)).cast("string")
    whole = fields(
        *common_fields("response", F.col("record")), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", length),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.sha1(F.col("html").cast("binary"))))),
    )
    first = F.col("target_record").isNull()
    value = F.when(first, F.concat(whole, F.lit(HTTP), F.col("html"))).otherwise(again)
    simple = joined.where(~first | ~F.col("cut")).select(value.alias("value"))
    # The lines between the type and the numbers of a piece.
    head = F.substring_index(F.substring(fields(*common_fields("", F.col("record"))), len(MARK) + len("WARC-Type: ") + 3, 1_000_000), END, 1)
    pieces = cut_records(slices(joined.where(first & F.col("cut")).withColumn("head", head), chunk))
    options = {"compression": compression} if compression else {}
    simple.unionByName(pieces).write.options(lineSep=END, **options).text(path)


def read_archives(spark, path: str) -> DataFrame:
    """The chunk table of archives: record, row, page_id, kind, segment (null: the only one), last, refers_to, digest, data."""
    raw = spark.read.text(path, lineSep=MARK).where("value <> ''")
    head = F.substring_index("value", END, 1)
    parsed = raw.select("value", head.alias("head")).withColumn("f", F.str_to_map("head", F.lit("\r\n"), F.lit(": ")))
    start = F.octet_length("head") + len(END)
    size = F.octet_length("value") - start - len(END)
    block = F.substring(F.col("value").cast("binary"), start + 1, size)
    right = F.col("f")["Content-Length"].cast("int").eqNullSafe(size)
    block = F.when(right, block).otherwise(F.raise_error(F.concat(F.lit("a block differs from its stated length: "), F.col("head"))))

    def name(field: str) -> Column:
        return F.regexp_extract(F.col("f")[field], "<urn:uuid:(.*)>", 1)

    segment = F.col("f")["WARC-Segment-Number"].cast("int")
    table = parsed.select(
        name("WARC-Record-ID").alias("record"),
        F.col("f")["X-Row"].cast("bigint").alias("row"),
        F.col("f")["X-Page-ID"].cast("bigint").alias("page_id"),
        F.col("f")["WARC-Type"].alias("kind"),
        segment.alias("segment"),
        (segment.isNull() | F.col("f")["WARC-Segment-Total-Length"].isNotNull()).alias("last"),
        name("WARC-Refers-To").alias("refers_to"),
        F.regexp_replace(F.col("f")["WARC-Payload-Digest"], "^sha1:", "").alias("digest"),
        block.alias("block"),
    )
    # The payload of an HTTP message is what follows its own fields.
    body = F.octet_length(F.substring_index(F.col("block").cast("string"), END, 1)) + len(END)
    data = F.when(F.col("kind") == "response", F.substring(F.col("block"), body + 1, F.octet_length("block"))).otherwise(F.col("block"))
    return table.withColumn("data", data).drop("block")


def checked(digest: Column, stated: Column) -> Column:
    return F.when(digest == stated, digest).otherwise(F.raise_error(F.concat(F.lit("a payload differs from its stated digest "), stated)))


def archived_pages(spark, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of the archives."""
    table = read_archives(spark, path)
    whole = table.where("kind = 'response' AND segment IS NULL")
    whole = whole.select("record", "page_id", F.octet_length("data").cast("bigint").alias("payload_bytes"), checked(base32(F.sha1("data")), F.col("digest")).alias("payload_digest"))
    segments = table.where("segment IS NOT NULL").repartition("record", "row").sortWithinPartitions("record", "row", "segment")
    large = streamed_digests(segments, ["record", "page_id", "digest"], strong=False)
    large = large.select("record", "page_id", "payload_bytes", checked(F.col("payload_digest"), F.col("digest")).alias("payload_digest"))
    responses = settled(whole.unionByName(large), "warc-responses")
    revisits = settled(table.where("kind = 'revisit'").select("record", "page_id", "refers_to", "digest"), "warc-revisits")
    named = revisits.groupBy("refers_to").agg(F.count("*").alias("n"))
    targets = responses.groupBy(F.col("record").alias("refers_to")).agg(F.max("page_id").alias("target"), F.max("payload_bytes").alias("payload_bytes"), F.max("payload_digest").alias("own"))
    groups = named.join(targets, "refers_to")
    total = revisits.agg(F.count("*")).first()[0]
    found = attach_groups(revisits, groups, "refers_to", "n", total, F.col("record"))
    again = found.select(
        "page_id", "payload_bytes", checked(F.col("own"), F.col("digest")).alias("payload_digest"), F.lit("revisit").alias("record_type"), F.col("target").alias("refers_to")
    )
    first = responses.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("bigint").alias("refers_to"))
    return first.unionByName(again)


def round_trip(pages: DataFrame, *, least: int = 0, chunk: int = CHUNK, compression: str | None = None) -> DataFrame:
    """Write the pages (page_id, url, html) to new archives in the shared folder and read them back."""
    spark = pages.sparkSession
    rows = with_payload(pages)
    revisits = settled(revisit_records(settled(payload_digests(rows, chunk), "warc-digests"), least), "warc-roles")
    path = f"{shared_folder(spark)}/waypost-llm/warc-{uuid.uuid4().hex}"
    write_archives(rows, revisits, path, chunk=chunk, compression=compression)
    return archived_pages(spark, path)
