"""WARC archives: write, normalise monolithic gzip, index, read back.

Records of pages are written as WARC 1.1 through Spark's own text writer with
gzip compression, so every file is one gzip stream over all of its records (a
monolithic archive that cannot be entered in the middle).  The normaliser
inflates each stream once, from front to back, cuts it into records by their
Content-Length and rewrites every record as a gzip member of its own; a
sidecar table holds (archive, seq, offset, length) of every member, so a
reader inflates only the records it wants.

Raw bytes go through the text writer as well (a string column is written
byte for byte).  The writer ends every row with a separator that it wants
non-empty; the separator used is the zero byte that ends a gzip member (the
high byte of a length below 16 MiB), which is left out of the row.  A longer
record is followed by an empty member, which ends in a zero byte as well and
which readers skip.

Defined cases: a null payload is empty; equal payloads of at least
``min_bytes`` bytes keep the row with the largest page_id as response, the
others are revisits (rows that repeat that page_id too are responses); null
urls become empty; rows with a null page_id are responses and never a
revisit's target; an empty table gives no archive and an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapecode.llm.common import delete, run_dir, written
from shapecode.session import ship_package

MIN_BYTES = 1000
ARCHIVE_BYTES = 64 << 20   # payload bytes per archive file, on average
DATE = "2024-01-01T00:00:00Z"
FILTER_BITS = 1 << 24      # of the repeated digests; a full filter only sends more rows to the join


def classify(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html",
             min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, url, html, bytes, digest, refers_to): which record each row becomes.

    Digests are pre-aggregated before the shuffle.  A bitmap of fixed size
    (``FILTER_BITS``, broadcast as at most FILTER_BITS / 64 words) of the
    repeated digests tells which rows can repeat at all; only those move to be
    joined, and the others stay where they are.
    """
    html = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
                        html.alias("html"), F.octet_length(html).cast("long").alias("bytes"),
                        F.sha1(F.encode(html, "UTF-8")).alias("digest"))
    repeated = (rows.where(F.col("bytes") >= min_bytes).groupBy("digest")
                .agg(F.count(F.lit(1)).alias("_n"), F.max("page_id").alias("_first")).where("_n > 1").drop("_n"))
    repeated = written(repeated, "repeated-digests")
    place = F.pmod(F.xxhash64("digest"), F.lit(FILTER_BITS))
    words = (repeated.select(place.alias("_p")).groupBy(F.shiftright("_p", 6).alias("_word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(_p & 63 as int))")).alias("_bits")))
    rows = (rows.withColumn("_p", F.when(F.col("bytes") >= min_bytes, place)).withColumn("_word", F.shiftright("_p", 6))
            .join(F.broadcast(words), "_word", "left")
            .withColumn("_may", F.coalesce(F.expr("shiftright(_bits, cast(_p & 63 as int)) & 1L"), F.lit(0)) == 1)
            .drop("_word", "_bits", "_p"))
    alone = rows.where(~F.col("_may")).drop("_may").withColumn("refers_to", F.lit(None).cast(rows.schema["page_id"].dataType))
    # always by merge: a broadcast side would grow with the repeated payloads
    joined = (rows.where("_may").drop("_may").join(repeated.hint("merge"), "digest", "left")
              .withColumn("refers_to", F.when(F.col("page_id") < F.col("_first"), F.col("_first"))).drop("_first"))
    return alone.unionByName(joined)


def records(classified: DataFrame) -> DataFrame:
    """(record): the text of each WARC record, less the CR LF that the writer adds."""
    crlf = "\r\n"
    is_revisit = F.col("refers_to").isNotNull()
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit(crlf))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1" + crlf),
        F.lit("WARC-Type: "), F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response")), F.lit(crlf),
        F.lit("WARC-Record-ID: <urn:page:"), page, F.lit(">" + crlf),
        F.lit(f"WARC-Date: {DATE}{crlf}"),
        F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]+", " "), F.lit(crlf), digest,
        F.lit("X-Payload-Length: "), F.col("bytes").cast("string"), F.lit(crlf),
        F.when(is_revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + crlf),
                                    F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"),
                                    F.lit(">" + crlf))).otherwise(F.lit("")),
        F.lit("Content-Type: text/html" + crlf), F.lit("Content-Length: "),
        F.when(is_revisit, F.lit("0")).otherwise(F.col("bytes").cast("string")), F.lit(crlf + crlf))
    body = F.when(is_revisit, F.lit("")).otherwise(F.col("html"))
    return classified.select(F.concat(head, body, F.lit(crlf)).alias("record"))


def write_monolithic(classified: DataFrame, path: str, file_records: int = 0) -> None:
    """Write the records as files of at most ``file_records`` records (0: one a partition), each one gzip stream."""
    (records(classified).write.option("lineSep", "\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", file_records).text(path))


def parse_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records (head, body and closing CR LF CR LF) of an inflated WARC stream, one at a time."""
    held = bytearray()
    need = None
    for chunk in chunks:
        held += chunk
        while True:
            if need is None:
                at = held.find(b"\r\n\r\n")
                if at < 0:
                    break
                need = at + 8 + int(header(bytes(held[: at + 2]), b"Content-Length") or 0)
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError(f"{len(held)} bytes after the last whole record")


def header(head: bytes, name: bytes) -> bytes | None:
    """The value of a named field in a record's head."""
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.lower() == name.lower():
            return value.strip()
    return None


def inflate(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The content of a gzip file (one member or several), in pieces of bounded size."""
    view = memoryview(data)
    at = 0
    z = zlib.decompressobj(31)
    while at < len(view):
        out = z.decompress(view[at : at + step], step)
        at = min(at + step, len(view))
        while True:
            if out:
                yield out
            if z.eof:
                at -= len(z.unused_data)
                z = zlib.decompressobj(31)
                break
            if not z.unconsumed_tail:
                break
            out = z.decompress(z.unconsumed_tail, step)


def member(record: bytes) -> bytes:
    """The record as gzip; ends in a zero byte (an empty member follows a record of 16 MiB or more)."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = z.compress(record) + z.flush()
    if out[-1]:
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += z.compress(b"") + z.flush()
    return out


_SOURCE = r"part-(\d+)-.*?(c\d+)?\.txt\.gz$"


def normalise(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Rewrite every archive below ``path`` record by record into ``out``; return the sidecar index.

    The members of one source file go, in order, to one file below
    ``out/archive=NAME``; the task that inflates a stream also writes its
    file, so nothing is shuffled.  The index (archive, seq, offset, length) is
    written to ``out-index``.
    """
    ship_package(spark)
    names = ["source", "seq", "member"]

    def rewrite(batches):
        import pyarrow as pa

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
                                               pa.array([r[2][:-1] for r in rows], pa.binary())], names=names)

        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows, held = [], 0
                for seq, rec in enumerate(parse_records(inflate(content.as_buffer()))):
                    rows.append((name, seq, member(rec)))
                    held += len(rows[-1][2])
                    if held > 1 << 22:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    members = files.mapInArrow(rewrite, "source string, seq long, member binary")
    archive = F.concat_ws("-", F.regexp_extract("source", _SOURCE, 1), F.regexp_extract("source", _SOURCE, 2))
    (members.select(archive.alias("archive"), "seq", F.col("member").cast("string").alias("value"))
     .sortWithinPartitions("archive", "seq").drop("seq")
     .write.option("lineSep", "\u0000").partitionBy("archive").text(out))
    return write_index(spark, out)


def write_index(spark: SparkSession, out: str) -> DataFrame:
    """Walk the members of every archive below ``out`` and write the sidecar (archive, seq, offset, length)."""

    def walk(batches):
        import pyarrow as pa

        for b in batches:
            for archive, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                places = list(member_places(content.as_buffer()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([archive] * len(places), pa.string()), pa.array(range(len(places)), pa.int64()),
                     pa.array([p[0] for p in places], pa.int64()), pa.array([p[1] for p in places], pa.int64())],
                    names=["archive", "seq", "offset", "length"])

    index = archives(spark, out).mapInArrow(walk, "archive string, seq long, offset long, length long")
    index.write.parquet(out + "-index")
    return spark.read.schema(index.schema).parquet(out + "-index")


def archives(spark: SparkSession, out: str) -> DataFrame:
    """(archive, content) of every normalised archive."""
    return (spark.read.format("binaryFile").load(out)
            .select(F.regexp_extract("path", r"archive=([^/]+)/", 1).alias("archive"), "content"))


def member_places(data, step: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(offset, length) of every record of a normalised archive; an empty member belongs to the record before it."""
    view = memoryview(data)
    at = start = 0
    held = None
    z, size = zlib.decompressobj(31), 0
    while at < len(view):
        out = z.decompress(view[at : at + step], step)
        size += len(out)
        at = min(at + step, len(view))
        while not z.eof and z.unconsumed_tail:
            size += len(z.decompress(z.unconsumed_tail, step))
        if z.eof:
            at -= len(z.unused_data)
            if size == 0 and held:
                held = (held[0], at - held[0])
            else:
                if held:
                    yield held
                held = (start, at - start)
            z, size, start = zlib.decompressobj(31), 0, at
    if held:
        yield held


def read_records(spark: SparkSession, out: str, index: DataFrame) -> DataFrame:
    """Every record that the index lists, inflated from its own member.

    (page_id, record_type, refers_to, url, digest_field, length_field, payload)
    """
    files = archives(spark, out)
    # one row of offsets per archive, bounded by the records of one file
    places = index.groupBy("archive").agg(F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("places"))

    def enter(batches):
        import pyarrow as pa

        names = ["page_id", "record_type", "refers_to", "url", "digest_field", "length_field", "payload"]
        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

        for b in batches:
            for content, places in zip(b.column("content"), b.column("places"), strict=True):
                data, rows, held = memoryview(content.as_buffer()), [], 0
                for p in places.as_py():
                    rec = b"".join(inflate(bytes(data[p["offset"] : p["offset"] + p["length"]])))
                    head, _, rest = rec.partition(b"\r\n\r\n")
                    field = lambda name: (header(head, name) or b"").decode()
                    number = lambda name: int(x) if (x := field(name)[len("<urn:page:") : -1]) else None
                    rows.append((number(b"WARC-Record-ID"), field(b"WARC-Type"), number(b"WARC-Refers-To"),
                                 field(b"WARC-Target-URI"), field(b"WARC-Payload-Digest").removeprefix("sha1:"),
                                 int(field(b"X-Payload-Length")), rest[: int(field(b"Content-Length"))]))
                    held += len(rec)
                    if held > 1 << 22:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    return files.join(places.hint("merge"), "archive").mapInArrow(
        enter, "page_id long, record_type string, refers_to long, url string, digest_field string, length_field long, payload binary")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html",
               min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the pages, normalise the archives, and read every record back through the index.

    A response's digest and length come from the payload read back, a
    revisit's from its own fields.
    """
    spark = pages.sparkSession
    n, size = pages.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).first()
    if n == 0:
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, "
                                         "refers_to long, url string")
    raw, out = run_dir(spark, "warc-raw"), run_dir(spark, "warc")
    write_monolithic(classify(pages, id_col, url_col, text_col, min_bytes), raw, max(1, int(archive_bytes // max(1, size // n))))
    index = normalise(spark, raw, out)
    delete(spark, raw)                    # the normalised archives hold every record
    back = read_records(spark, out, index)
    own = F.col("record_type") == "response"
    return back.select(
        "page_id", F.when(own, F.length("payload")).otherwise(F.col("length_field")).cast("long").alias("payload_bytes"),
        F.when(own, F.sha1("payload")).otherwise(F.col("digest_field")).alias("payload_digest"), "record_type", "refers_to", "url")
