"""WARC archives: writing, and reading by boundary-chain verification.

Archives are written by the session's text writer, whose line end is the blank
lines that close a record; so files appear by Spark's commit protocol or not at all.
A page is a ``response`` record with an HTTP head and its payload, or a ``revisit``
without one that names the response it repeats.

Reading deals every file in byte ranges. A task scans its range for lines that
begin like a record and, for each candidate, reads the head and has the offset of
its successor, which may lie beyond the range; so ranges are scanned independently.
A payload may hold such a line, so a candidate is only kept if it lies on the chain
that starts at the file's start. Within a range the chains are followed at once to
where they leave it, and of each candidate its offset and this exit are emitted;
across ranges, pointers are jumped (each round doubles the reach) until every range
knows whether it is entered and where. Then the records of a range are read from its
entry on, their payloads digested as they pass and not kept. A file whose chain does
not end at its last byte is damaged or cut and raises an error: no record is left out
in silence.

Defined results: null html is an empty payload; a null url has no target line, line
breaks and blanks in a url are percent-encoded; a null page id is written as an
empty value and read as null; of equal ids that hold the largest id each is a
response; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import scratch_path, ship_code, staged

#: Bytes from which equal payloads are written once.
REVISIT_BYTES = 1_000
#: Bytes of a range that one task scans.
RANGE_BYTES = 16 << 20
#: Bytes that are read at once.
READ_BYTES = 4 << 20
#: Repeated payloads that every task is told of, at most.
SEND_ROWS = 500_000
#: Bytes of a record's head that are read first; each further piece is as long as all before.
HEAD_BYTES = 4 << 10

#: Bytes of a file that are read at once, at least.
WINDOW_BYTES = 1 << 20

LENGTH = re.compile(r"[0-9]{1,18}")
MAGIC = re.compile(rb"(?:^|\n)(?=WARC/1\.[01]\r\n)")
HEAD_END = b"\r\n\r\n"


def with_roles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(``page_id``, ``url``, ``html``, ``digest``, ``bytes``, ``keeper``): what each page's record is.

    ``keeper`` is the largest id with the same payload of at least ``REVISIT_BYTES``
    if that payload occurs more than once.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8"))).withColumn("bytes", F.octet_length("html").cast("long"))
    large = rows.filter(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
    repeated = staged(large.filter("n > 1").select("digest", "keeper"), "warc-repeated")
    # Up to SEND_ROWS rows of some 60 bytes go to every task; beyond, the join shuffles the pages.
    return rows.join(F.broadcast(repeated) if repeated.count() <= SEND_ROWS else repeated, "digest", "left")


def records(roles: DataFrame) -> DataFrame:
    """(``value``): each record without its closing blank lines."""
    end = "\r\n"
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), " ", "%20")
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{end}Content-Type: text/html; charset=utf-8{end}Content-Length: "), F.col("bytes").cast("string"), F.lit(end * 2))
    block = F.when(revisit, F.lit("")).otherwise(F.concat(http, F.col("html")))
    head = F.concat(
        F.lit(f"WARC/1.1{end}WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{end}WARC-Record-ID: <urn:uuid:"), F.uuid(), F.lit(f">{end}WARC-Date: 1970-01-01T00:00:00Z"),
        F.coalesce(F.concat(F.lit(f"{end}WARC-Target-URI: "), url), F.lit("")),
        F.lit(f"{end}WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit(f"{end}X-Payload-Length: "), F.col("bytes").cast("string"),
        F.lit(f"{end}X-Page-ID: "), page,
        F.when(revisit, F.concat(F.lit(f"{end}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{end}X-Refers-To-Page-ID: "), F.col("keeper").cast("string"))).otherwise(F.lit("")),
        F.lit(f"{end}Content-Type: application/http;msgtype=response{end}Content-Length: "), F.octet_length(block).cast("string"), F.lit(end * 2),
    )
    return roles.select(F.concat(head, block).alias("value"))


def write(pages: DataFrame, path: str, **columns: str) -> None:
    """Writes the pages' records as archives under ``path``."""
    records(with_roles(pages, **columns)).write.option("lineSep", HEAD_END.decode()).text(path)


def parse_head(head: bytes) -> dict[str, str] | None:
    """The fields of a record's head, by lower-case name; None if it is none."""
    lines = head.split(b"\r\n")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return fields if number(fields.get("content-length")) is not None else None


def number(text: str | None) -> int | None:
    """A field's whole number of at most 18 ASCII digits; None if it is none."""
    return int(text) if text and LENGTH.fullmatch(text) else None


def _payload(file, start: int, stop: int, is_http: bool) -> tuple[int, str]:
    """Length and SHA-1 of the payload in a block: what follows an HTTP head, or all of it."""
    digest, size = hashlib.sha1(), 0
    whole = hashlib.sha1()  # the payload's, if the block turns out to have no HTTP head
    file.seek(start)
    left, waiting = stop - start, is_http
    held = b""
    while left:
        data = file.read(min(left, READ_BYTES))
        if not data:
            break
        left -= len(data)
        if waiting:
            whole.update(data)
            seen = held + data
            at = seen.find(HEAD_END)
            if at < 0:
                held = seen[-3:]
                continue
            data, waiting = seen[at + 4 :], False
        digest.update(data)
        size += len(data)
    return (stop - start - left, whole.hexdigest()) if waiting else (size, digest.hexdigest())


def read_head(file, at: int, size: int) -> bytes | None:
    """The head of the record at ``at``, of any length, without its end; None if there is none.

    Beyond the first piece it's read on only while its lines look like fields, so
    that many false candidates in one payload don't each read all of it.
    """
    file.seek(at)
    head, looked = file.read(min(HEAD_BYTES, size - at)), 0
    while (cut := head.find(HEAD_END, max(0, looked - 3))) < 0:
        # Complete lines from the last that was looked at; the first is the magic.
        begin, end = head.rfind(b"\r\n", 0, looked) + 2 if looked else head.find(b"\r\n") + 2, head.rfind(b"\r\n")
        if end > begin and not all(b":" in line and not MAGIC.search(line + b"\r\n", 1) for line in head[begin:end].split(b"\r\n")):
            return None
        looked = len(head)
        more = file.read(min(looked, size - at - looked))
        if not more:
            return None
        head += more
    return head[:cut]


def scan_range(file, start: int, stop: int, size: int) -> Iterator[tuple[int, int, bytes]]:
    """The candidates whose first byte lies in [start, stop) and that end within the file: offset, successor, head."""
    low = start
    while low < stop:
        # One byte before, to see the line end; some after, to see the magic.
        begin = max(0, low - 1)
        file.seek(begin)
        data = file.read(min(READ_BYTES, stop - low) + (low - begin) + 16)
        high = min(low + READ_BYTES, stop)
        for m in MAGIC.finditer(data):
            at = begin + m.end()
            if low <= at < high and (m.end() > m.start() or begin + m.start() == 0) and (found := record_at(file, at, size)):
                yield at, found[1], found[0]
        low = high


def record_at(file, at: int, size: int) -> tuple[bytes, int] | None:
    """Head and successor of the record at ``at``; None if there is none that ends within the file."""
    head = read_head(file, at, size)
    fields = parse_head(head) if head is not None else None
    if fields is None:
        return None
    after = at + len(head) + 4 + number(fields["content-length"])
    if after + 4 > size:
        return None
    file.seek(after)
    return (head, after + 4) if file.read(4) == HEAD_END else None


class Window:
    """A file that is read in larger pieces; small reads close to one another are served from the last one."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.begin, self.held = file, size, 0, 0, b""

    def seek(self, at: int) -> None:
        self.at = at

    def read(self, n: int) -> bytes:
        n = max(0, min(n, self.size - self.at))
        if not self.begin <= self.at <= self.at + n <= self.begin + len(self.held):
            self.file.seek(self.at)
            self.begin, self.held = self.at, self.file.read(max(n, WINDOW_BYTES))
        low = self.at - self.begin
        self.at += n
        return self.held[low : low + n]


def _opened(name: str, size: int):
    """The file as a window, and what is to be closed."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", name))
    file = system.open_input_file(inner)
    return Window(file, size), file


def ranges_of(spark: SparkSession, path: str, range_bytes: int) -> DataFrame:
    """(``path``, ``size``, ``file``, ``range``) of the archives under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"))
    # Pointers name a file by 64 bits of its path: a path in every row would dwarf them.
    files = files.filter("size > 0").withColumn("file", F.xxhash64("path"))
    return files.withColumn("range", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / range_bytes))))


def exits(ranges: DataFrame, range_bytes: int) -> DataFrame:
    """(``file``, ``offset``, ``leave``): every candidate, and where its chain leaves the candidate's range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size, file_key, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                window, file = _opened(name, size)
                with file:  # at most as many candidates as a range has lines
                    own = {at: after for at, after, _ in scan_range(window, part * range_bytes, min(size, (part + 1) * range_bytes), size)}
                leave: dict[int, int] = {}
                for at in sorted(own, reverse=True):  # successors lie behind
                    leave[at] = leave.get(own[at], own[at])
                yield pa.RecordBatch.from_arrays([pa.array([file_key] * len(leave), pa.int64()), pa.array(list(leave), pa.int64()), pa.array(list(leave.values()), pa.int64())], ["file", "offset", "leave"])

    return ranges.select("path", "size", "file", "range").mapInArrow(run, "file long, offset long, leave long")


def entries(ranges: DataFrame, range_bytes: int) -> DataFrame:
    """(``file``, ``range``, ``entry``): where the chain from each file's start enters its ranges, by pointer jumping."""
    jumps = staged(exits(ranges, range_bytes), "warc-exits")
    # Only files' starts and where chains leave to can be entries.
    targets = jumps.select("file", F.col("leave").alias("offset")).distinct()
    nodes = staged(jumps.filter("offset = 0").union(jumps.filter("offset > 0").join(targets, ["file", "offset"], "left_semi")), "warc-nodes")
    reached = nodes.filter("offset = 0").select("file", "offset")
    known = nodes.select("file", F.col("offset").alias("to"))
    hop = nodes.select("file", "offset", F.col("leave").alias("to"))
    n = reached.count()
    while True:
        onward = reached.join(hop, ["file", "offset"]).join(known, ["file", "to"], "left_semi").select("file", F.col("to").alias("offset"))
        more = staged(reached.union(onward).distinct(), "warc-reached")
        if (now := more.count()) == n:
            break
        reached, n = more, now
        further = hop.select("file", F.col("offset").alias("to"), F.col("to").alias("far"))
        hop = staged(hop.join(further, ["file", "to"], "left").select("file", "offset", F.coalesce("far", "to").alias("to")), "warc-hops")
    ends = nodes.join(reached, ["file", "offset"], "left_semi").groupBy("file").agg(F.max("leave").alias("end"))
    broken = ranges.filter("range = 0").join(ends, "file", "left").filter("end is null or end <> size").select("path", "size", "end").first()
    if broken:
        raise ValueError(f"{broken['path']}: the chain of records ends at byte {broken['end'] or 0} of {broken['size']}")
    return reached.withColumn("range", F.floor(F.col("offset") / range_bytes)).groupBy("file", "range").agg(F.min("offset").alias("entry"))


def follow(dealt: DataFrame, range_bytes: int) -> DataFrame:
    """The records of ranges (``path``, ``size``, ``range``, ``entry``), each read from its entry on."""
    schema = "type string, page string, refers string, uri string, stated_digest string, stated_bytes long, digest string, bytes long"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [*[pa.string()] * 5, pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size, part, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                window, file = _opened(name, size)
                out: list[tuple] = []
                with file:
                    while at < min(size, (part + 1) * range_bytes):
                        head, after = record_at(window, at, size)
                        fields = parse_head(head)
                        length, digest = _payload(window, at + len(head) + 4, after - 4, "application/http" in fields.get("content-type", ""))
                        out.append((fields.get("warc-type"), fields.get("x-page-id"), fields.get("x-refers-to-page-id"), fields.get("warc-target-uri"), fields.get("warc-payload-digest", "").removeprefix("sha1:"), number(fields.get("x-payload-length")), digest, length))
                        at = after
                        if len(out) == 1_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                            out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return dealt.select("path", "size", "range", "entry").mapInArrow(run, schema)


def verified(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records on the chain from their file's start, of all archives under ``path``."""
    ship_code(spark)
    ranges = ranges_of(spark, path, range_bytes)
    n = max(1, min(ranges.count(), 4 * spark.sparkContext.defaultParallelism * 64))
    ranges = staged(ranges.repartition(n, "path", "range"), "warc-ranges").repartition(n, "file", "range")
    return follow(ranges.join(entries(ranges, range_bytes), ["file", "range"]).repartition(n, "file", "range"), range_bytes)


def read(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of the archives under ``path``.

    ``page_id``, ``url``, ``record_type``, ``refers_to``, ``payload_bytes`` and
    ``payload_digest`` (of the payload as read; a revisit states those of the payload
    that it repeats) and ``intact`` (a response whose digest is as stated).
    """
    kept = verified(spark, path, range_bytes)
    response = F.col("type") == "response"
    return kept.select(
        F.expr("try_cast(page AS BIGINT)").alias("page_id"),
        F.col("uri").alias("url"),
        F.col("type").alias("record_type"),
        F.expr("try_cast(refers AS BIGINT)").alias("refers_to"),
        F.when(response, F.col("bytes")).otherwise(F.col("stated_bytes")).alias("payload_bytes"),
        F.when(response, F.col("digest")).otherwise(F.col("stated_digest")).alias("payload_digest"),
        F.when(response, F.col("digest") == F.col("stated_digest")).alias("intact"),
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages as archives in the shared folder and reads them back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(pages, path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")
