"""WARC archives: written as whole-file gzip, normalised to a member per record, read back.

Spark's text writer makes the first archives: a record is a header and a
payload in UTF-8, the text between records ends with the four bytes that end a
record, and each file is one gzip stream. The writer commits files whole and
reaches any file system that Spark does.

The normaliser takes such files, or any others of WARC records within one gzip
stream, one file a task. It inflates a file once from beginning to end, writes
each record as a gzip member of its own, and returns where each lies. That
index is written beside the archives. A record can then be read by seeking to
it. Memory is bounded by a record, not by a file. A task writes under a name of
its own attempt and renames it at the end, so a repeated task leaves the same
file.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightwater.llm.bitmaps import bitmap_of, bits_for, marked
from brightwater.llm.common import map_arrow, new_path, write_shared
from brightwater.llm.group_joins import join_groups

#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 100
#: Records in an archive.
RECORDS = 20_000
#: Bytes in a read, and a gap between members up to which they are read at once.
_READ = 1 << 20
_END = b"\r\n\r\n"

_PAGE = "urn:page:"


def with_record_types(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """Adds `payload_bytes`, `payload_digest`, `record_type` and `refers_to` to id and payload.

    Of records with equal payloads of at least `LEAST_BYTES` bytes the one with
    the smallest id is the response and others revisit it. Rows that repeat the
    smallest id are responses too. A null id is larger than any other; if all
    are null, all are responses. A null payload is empty. A very long payload
    is hashed and kept whole. `payload` is null for revisits.

    Ids and digests alone tell which records are revisits. Two bitmaps, of
    repeated digests and of the first ids of each, keep payloads where they are
    read: only the first of a repeated payload, and the few rows that share a
    bit with one, are compared exactly, and written once for that.
    """
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.coalesce(F.col(html), F.lit("")).alias("payload")
    ).select(
        "page_id", "payload", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest")
    )
    is_long = F.col("payload_bytes") >= LEAST_BYTES
    ids = write_shared(rows.where(is_long).select("page_id", "payload_bytes", "payload_digest", _of_first("page_id")), "payload-ids")
    groups = write_shared(ids.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")), "payload-groups")
    repeated = write_shared(groups.where("n > 1 AND first IS NOT NULL"), "payload-repeated")

    bits = bits_for(repeated.count())
    digests = bitmap_of(repeated, "payload_digest", bits)
    passing = marked(groups, "payload_digest", digests, bits, "repeats").where("repeats").select(_of_first("first"))
    passing = write_shared(passing, "payload-firsts")
    first_bits = bits_for(passing.count())
    firsts = bitmap_of(passing, "of_first", first_bits)

    def sorted_out(df: DataFrame) -> DataFrame:
        return marked(marked(df, "payload_digest", digests, bits, "repeats"), "of_first", firsts, first_bits, "may_be_first")

    # any group on a digest's bit gave its smallest id, so what is not on the bit of one is no response
    others = write_shared(sorted_out(ids).where("repeats AND NOT may_be_first").select("page_id", "payload_bytes", "payload_digest"), "revisits")
    others = join_groups(others, repeated, ["payload_digest"], "n").withColumn("payload", F.lit(None).cast("string"))
    placed = sorted_out(rows.withColumn("of_first", _of_first("page_id"))).withColumn("repeats", F.col("repeats") & is_long)
    single = placed.where("NOT repeats").select(*rows.columns, F.lit(None).cast(repeated.schema["first"].dataType).alias("first"))
    few = write_shared(placed.where("repeats AND may_be_first").select(*rows.columns), "responses")
    few = join_groups(few, repeated, ["payload_digest"], "n", "left")

    columns = [*rows.columns, "first"]
    joined = single.unionByName(few.select(*columns)).unionByName(others.select(*columns))
    revisits = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        "page_id", F.when(~revisits, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.when(revisits, F.col("first")).alias("refers_to"),
    )


def _of_first(page_id: str) -> Column:
    return F.xxhash64("payload_digest", page_id).alias("of_first")


def _record(date: str) -> Column:
    """A record without the four bytes that end it."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    name = lambda page: F.concat(F.lit(f"<{_PAGE}"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(">"))
    is_revisit = F.col("record_type") == "revisit"
    body = F.when(is_revisit, "").otherwise(F.col("payload"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", name(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(
            is_revisit,
            F.concat(
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                line("WARC-Refers-To", name(F.col("refers_to"))),
                line("X-Payload-Length", F.col("payload_bytes").cast("string")),
            ),
        ).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
        body,
    )


def write_archives(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", per_file: int = RECORDS) -> None:
    """Writes the rows of `with_record_types` to gzip files of at most `per_file` records."""
    (
        records.select(_record(date).alias("value"))
        .write.option("compression", "gzip")
        .option("lineSep", _END.decode())
        .option("maxRecordsPerFile", per_file)
        .text(path)
    )


def parse_header(header: bytes) -> dict[str, str]:
    lines = header.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError(f"no WARC record here: {lines[0][:40]!r}")
    fields = (line.partition(b":") for line in lines[1:] if line)
    return {name.decode().lower(): value.strip().decode() for name, _, value in fields}


def records_of(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and whole bytes of each record of a gzip file of one or more members."""
    pending = bytearray()
    inflater = zlib.decompressobj(31)
    ended = False

    def more() -> bool:
        nonlocal inflater, ended
        while not ended:
            if inflater.eof:
                rest = inflater.unused_data
                inflater = zlib.decompressobj(31)
            else:
                rest = inflater.unconsumed_tail
            rest = rest or stream.read(_READ)
            if not rest:
                ended = True
                return False
            pending.extend(inflater.decompress(rest, _READ))
            return True
        return False

    while True:
        while not pending.startswith(b"WARC/") and pending.startswith((b"\r", b"\n")):
            del pending[:1]
        at = 0
        while (end := pending.find(_END, at)) < 0:
            at = max(0, len(pending) - 3)
            if not more():
                if pending.strip():
                    raise ValueError("the archive ends within a header")
                return
        fields = parse_header(bytes(pending[:end]))
        size = end + len(_END) + int(fields["content-length"]) + len(_END)
        while len(pending) < size:
            if not more():
                raise ValueError("the archive ends within a record")
        yield fields, bytes(pending[:size])
        del pending[:size]


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


_INDEX = pa.schema(
    [("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string())]
)


def _normalise(target: str, level: int):
    def per_batch(batches):
        for batch in batches:
            for source, name in zip(batch.column("source").to_pylist(), batch.column("name").to_pylist()):
                system, path = _open(source)
                store, folder = _open(target)
                final = f"{folder}/{name}"
                attempt = f"{folder}/.{name}.{uuid.uuid4().hex}"
                rows, offset = {f.name: [] for f in _INDEX}, 0
                with system.open_input_stream(path, compression=None) as stream, store.open_output_stream(attempt, compression=None) as out:
                    for fields, record in records_of(stream):
                        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = packer.compress(record) + packer.flush()
                        out.write(member)
                        for key, value in zip(
                            rows, (f"{target}/{name}", offset, len(member), fields.get("warc-record-id"), fields.get("warc-type"))
                        ):
                            rows[key].append(value)
                        offset += len(member)
                        if len(rows["archive"]) == 10_000:
                            yield pa.RecordBatch.from_pydict(rows, schema=_INDEX)
                            rows = {f.name: [] for f in _INDEX}
                store.move(attempt, final)
                yield pa.RecordBatch.from_pydict(rows, schema=_INDEX)

    return per_batch


def normalise(spark: SparkSession, source: str, target: str, level: int = 6) -> DataFrame:
    """Rewrites all .gz archives of the folder `source` into `target`, a gzip member per record.

    Returns the index as it was written to `target`/index: `archive`, `offset`
    and `length` (of the member, in bytes), `record_id` and `record_type`.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")
    n = max(1, files.count())
    names = files.select(
        F.col("path").alias("source"),
        F.concat(F.lit("records-"), F.substring(F.sha2("path", 256), 1, 24), F.lit(".warc.gz")).alias("name"),
    ).repartition(n, "name")
    store, folder = _open(target)
    store.create_dir(folder, recursive=True)
    schema = "archive string, offset bigint, length bigint, record_id string, record_type string"
    map_arrow(names, _normalise(target, level), schema).write.parquet(f"{target}/index")
    return spark.read.schema(schema).parquet(f"{target}/index")


_READ_BACK = pa.schema(
    [("record_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())]
)


def _read_back(batches):
    """Seeks to each member of the index, inflates it and takes its facts from its own bytes."""
    opened: tuple[str, pa.NativeFile] | None = None
    try:
        for batch in batches:
            rows = {f.name: [] for f in _READ_BACK}
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length"))):
                if opened is None or opened[0] != archive:
                    if opened is not None:
                        opened[1].close()
                    system, path = _open(archive)
                    opened = archive, system.open_input_file(path)
                opened[1].seek(offset)
                record = zlib.decompress(opened[1].read(length), 31)
                header, _, rest = record.partition(_END)
                fields = parse_header(header)
                payload = rest[: int(fields["content-length"])]
                if fields["warc-type"] == "revisit":
                    size, digest = int(fields["x-payload-length"]), fields["warc-payload-digest"].removeprefix("sha256:")
                else:
                    size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    if fields["warc-payload-digest"] != f"sha256:{digest}":
                        raise ValueError(f"{fields['warc-record-id']} of {archive} is not what its digest says")
                for key, value in zip(rows, (fields["warc-record-id"], size, digest, fields["warc-type"], fields.get("warc-refers-to"))):
                    rows[key].append(value)
            yield pa.RecordBatch.from_pydict(rows, schema=_READ_BACK)
    finally:
        if opened is not None:
            opened[1].close()


def read_archives(index: DataFrame) -> DataFrame:
    """Columns `record_id`, `payload_bytes`, `payload_digest`, `record_type` and `refers_to` of all records in `index`.

    For a revisit, size and digest are those that its header gives of the
    payload it refers to. A payload that does not fit its digest is an error.
    """
    schema = "record_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string"
    return map_arrow(index.select("archive", "offset", "length"), _read_back, schema)


def archive_pages(pages: DataFrame, page_id: str = "page_id", html: str = "html", per_file: int = RECORDS) -> DataFrame:
    """Writes a record per row of `pages`, normalises the archives and reads them back.

    Columns `page_id`, `payload_bytes`, `payload_digest`, `record_type` and
    `refers_to`; one row per row of `pages`. For nulls and repeated ids see
    `with_record_types`. An empty table gives no rows; other columns are not
    read.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    write_archives(with_record_types(pages, page_id, html), f"{folder}/whole", per_file=per_file)
    index = normalise(spark, f"{folder}/whole", f"{folder}/records")
    kind = pages.schema[page_id].dataType

    def id_of(name: str) -> Column:
        return F.regexp_extract(name, f"^<{_PAGE}(.*)>$", 1).try_cast(kind)

    return read_archives(index).select(
        id_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", id_of("refers_to").alias("refers_to")
    )
