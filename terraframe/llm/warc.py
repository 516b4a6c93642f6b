"""WARC archives: writing, reading and transaction assembly.

A capture is written as a request, a response (or, for a payload that another
capture holds already, a revisit) and a metadata record, tied together by
WARC-Concurrent-To. Each record is a gzip member of its own. Reading parses the
members of whole files; assembly resolves concurrent-to identifiers and emits
one nested row for each capture.

Plan: payload digests and their leaders are found on slim rows; payloads are
shuffled once, on the way to the archives, and files are written by the tasks
into the shared folder under names that depend on the rows alone, so a retried
task overwrites what its lost forerunner wrote.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import pa_schema, shared_dir, shuffle_partitions, table, utf8, written

#: Smaller payloads are never revisits.
REVISIT_BYTES = 1000
#: A file is closed when it has so many bytes.
FILE_BYTES = 1 << 22
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

#: Records that are captures.
CAPTURES = ("response", "revisit", "resource")
RECORD = "record_id string, type string, concurrent_to array<string>, target_uri string, refers_to string, payload_digest string, payload_bytes long, fields map<string,string>, payload binary"


def record_id(seed: str, part: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{seed}/{part}')}>"


def base32_sha1(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def serialise(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(head.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def _clean(value: str) -> str:
    """A header's value: no line ends, no controls."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def transaction(seed: str, uri: str | None, payload: bytes, refers: str | None, fields: dict[str, str]) -> bytes:
    """The members of one capture; ``refers`` names the response that holds the payload if it is a revisit."""
    response, at = record_id(seed, "response"), [("WARC-Target-URI", _clean(uri))] if uri else []
    kind = "revisit" if refers else "response"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [("WARC-Type", kind), ("WARC-Record-ID", response), ("WARC-Date", DATE), *at, ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", base32_sha1(payload))]
    if refers:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", refers)]
    host = re.match(r"\w+://([^/?#]*)(.*)", _clean(uri or ""))
    ask = f"GET {(host and host[2]) or '/'} HTTP/1.1\r\nHost: {host[1] if host else ''}\r\n\r\n".encode()
    meta = "".join(f"{k}: {_clean(v)}\r\n" for k, v in fields.items()).encode()
    return b"".join(
        (
            serialise([("WARC-Type", "request"), ("WARC-Record-ID", record_id(seed, "request")), ("WARC-Date", DATE), *at, ("WARC-Concurrent-To", response), ("Content-Type", "application/http; msgtype=request")], ask),
            serialise(head, http if refers else http + payload),
            serialise([("WARC-Type", "metadata"), ("WARC-Record-ID", record_id(seed, "metadata")), ("WARC-Date", DATE), *at, ("WARC-Concurrent-To", response), ("Content-Type", "application/warc-fields")], meta),
        )
    )


def parse(archive: bytes, payloads: bool = True):
    """The records of an archive, compressed by members or plain, as tuples of RECORD. Damaged ends raise ValueError."""
    stream = io.BytesIO(_inflate(archive))
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers: dict[str, list[str]] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.decode("utf-8", "replace").partition(":")
            headers.setdefault(k.strip().lower(), []).append(v.strip())
        size = int(headers.get("content-length", ["0"])[0])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record ends early")
        yield _row(headers, block, payloads)


def _inflate(data: bytes) -> bytes:
    if data[:2] != b"\x1f\x8b":
        return data
    out, at = [], 0
    while at < len(data):
        z = zlib.decompressobj(31)
        # fed bit by bit: what lies behind a member would be copied for each one
        while not z.eof:
            part = data[at : at + 4096]
            if not part:
                raise ValueError("a member ends early")
            out.append(z.decompress(part))
            at += len(part) - len(z.unused_data)
    return b"".join(out)


def _row(headers: dict[str, list[str]], block: bytes, payloads: bool):
    one = lambda k: headers.get(k, [None])[0]
    kind, fields = one("warc-type"), {}
    payload = block
    if (one("content-type") or "").startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    elif one("content-type") == "application/warc-fields":
        fields = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").splitlines()) if k.strip()}
    # a revisit's payload is elsewhere; its header holds the digest
    if kind == "revisit":
        d = (one("warc-payload-digest") or "").partition(":")[2]
        digest, size, payload = base64.b32decode(d).hex() if d else None, None, None
    else:
        digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
    return one("warc-record-id"), kind, headers.get("warc-concurrent-to", []), one("warc-target-uri"), one("warc-refers-to"), digest, size, list(fields.items()), payload if payloads else None


def leaders(rows: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """``rows`` has ``key`` (orderable), ``digest``, ``size``; one row for each payload that several rows share: ``digest, size, leader``."""
    many = rows.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("key").alias("leader"), F.count("*").alias("n"))
    return many.where("n > 1").drop("n")


def write(captures: DataFrame, refers: DataFrame, folder: str) -> DataFrame:
    """``captures`` has ``seed`` (unique), ``uri``, ``payload``, ``fields``; ``refers`` says by ``seed`` and ``refers_seed`` which of them are revisits.

    An action on the result writes ``*.warc.gz`` under ``folder``, a path that all executors see, and gives one
    row for each task: ``files, records, bytes``. Payloads are shuffled once, by seed.
    """
    n = shuffle_partitions(captures.sparkSession)
    # in order by seed: whatever task writes a partition, and however often, the files are the same
    rows = captures.select("seed", "uri", "payload", "fields").repartition(n, "seed").join(refers.repartition(n, "seed"), "seed", "left")
    rows = rows.withColumn("_part", F.spark_partition_id()).sortWithinPartitions("seed")

    def run(batches):
        out = _Files(folder)
        for b in batches:
            for seed, uri, payload, refers, fields, part in zip(*(b.column(c).to_pylist() for c in ("seed", "uri", "payload", "refers_seed", "fields", "_part")), strict=True):
                out.add(part, transaction(seed, uri, payload or b"", record_id(refers, "response") if refers else None, dict(fields or [])))
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (out.files, out.records, out.bytes)], names=["files", "records", "bytes"])

    return rows.mapInArrow(run, "files long, records long, bytes long")


class _Files:
    def __init__(self, folder: str):
        from pyarrow import fs

        self.fs, self.path = fs.FileSystem.from_uri(folder)
        self.held, self.size, self.part = [], 0, 0
        self.files = self.records = self.bytes = 0

    def add(self, part: int, members: bytes) -> None:
        self.part = part
        self.held.append(members)
        self.size += len(members)
        self.records += 3
        if self.size >= FILE_BYTES:
            self.close()

    def close(self) -> None:
        if self.held:
            self.fs.create_dir(self.path, recursive=True)
            # under another name until it is whole; then one rename
            tmp = f"{self.path}/.{uuid.uuid4().hex}"
            with self.fs.open_output_stream(tmp) as f:
                f.write(b"".join(self.held))
            self.fs.move(tmp, f"{self.path}/{self.part:06d}-{self.files:06d}.warc.gz")
            self.files += 1
            self.bytes += self.size
            self.held, self.size = [], 0


def read(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """The records (RECORD) of every archive under ``folder``; ``payloads`` says whether bodies are handed on."""
    schema = pa_schema(spark, RECORD)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").schema("path string, modificationTime timestamp, length long, content binary").load(folder)

    def run(batches):
        for b in batches:
            for content in b.column("content"):
                got = list(parse(content.as_py(), payloads))
                for i in range(0, len(got), 1024):
                    cols = list(zip(*got[i : i + 1024], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], names=schema.names)

    return files.select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: ``capture_id, response, requests, metadata``.

    A response, revisit or resource record is a capture; other records belong to the capture that they are
    concurrent to, directly or through one that names it, or that names them. Records tied to no
    capture are left out; records with the same identifier count as one. A revisit's ``response.payload_bytes`` comes
    from the record that it refers to, null if that isn't there.
    """
    main = F.col("type").isin(*CAPTURES)
    heads, rest = records.where(main), records.where(~main)
    members = heads.select(F.col("record_id").alias("capture_id"), _nested()).unionByName(rest.select(F.explode("concurrent_to").alias("capture_id"), _nested()))
    # a capture has a handful of records; one shuffle brings them together
    groups = written(members.groupBy("capture_id").agg(F.collect_list("rec").alias("all")))
    is_head = lambda x: x["type"].isin(*CAPTURES)
    stray = groups.where(~F.exists("all", is_head)).select(F.col("capture_id").alias("via"), F.explode("all").alias("rec"))
    named = heads.select(F.explode("concurrent_to").alias("own"), F.col("record_id").alias("capture_id"))
    whole = groups.where(F.exists("all", is_head))
    if not stray.isEmpty() or not named.isEmpty():
        # ties through a sibling, and those written on the capture's side only
        ties = rest.select(F.col("record_id").alias("own"), F.explode("concurrent_to").alias("capture_id")).unionByName(named)
        late = stray.join(ties, F.col("via") == F.col("own")).select("capture_id", "rec").unionByName(rest.join(named, F.col("record_id") == F.col("own")).select("capture_id", _nested()))
        every = whole.select("capture_id", F.explode("all").alias("rec")).unionByName(late)
        whole = every.groupBy("capture_id").agg(F.collect_list("rec").alias("all")).where(F.exists("all", is_head))
    # records with equal identifiers count once
    ids = F.transform("all", lambda x: x["record_id"])
    once = whole.withColumn("all", F.filter("all", lambda x, i: F.array_position(ids, x["record_id"]) == i + 1))
    of = lambda *kinds: F.filter("all", lambda x: x["type"].isin(*kinds))
    return once.select("capture_id", F.element_at(of(*CAPTURES), 1).alias("response"), F.array_sort(of("request")).alias("requests"), F.array_sort(of("metadata")).alias("metadata"))


def _nested() -> Column:
    return F.struct("record_id", "type", "target_uri", "refers_to", "payload_digest", "payload_bytes", F.map_entries("fields").alias("fields"), "payload").alias("rec")


def archive_pages(pages: DataFrame, folder: str, least: int = REVISIT_BYTES) -> DataFrame:
    """Writes a capture for each row of ``pages`` (page_id, url, html): revisits refer to the row with the largest page_id among equal payloads.

    Of rows with equal ids and payloads one is the response. A null page_id comes before all others and leaves
    its field out; a null html is an empty payload.
    """
    key = F.struct(F.col("page_id").cast("long").alias("id"), F.monotonically_increasing_id().alias("row"))
    full = pages.select(key.alias("key"), F.col("url"), utf8("html").alias("payload")).withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    slim = full.select("key", "digest", "size")
    seed = lambda k: F.concat_ws(":", k["row"], F.coalesce(k["id"].cast("string"), F.lit("")))
    again = slim.join(leaders(slim, least), ["digest", "size"]).where(F.col("leader") != F.col("key"))
    refers = again.select(seed(F.col("key")).alias("seed"), seed(F.col("leader")).alias("refers_seed"))
    fields = F.map_filter(F.create_map(F.lit("page-id"), F.col("key.id").cast("string")), lambda _, v: v.isNotNull())
    return write(full.select(seed(F.col("key")).alias("seed"), F.col("url").alias("uri"), "payload", fields.alias("fields")), refers, folder)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder = shared_dir(spark)
    if not archive_pages(pages, folder).agg(F.sum("records")).first()[0]:
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")
    # parsed once; assembly joins the records several times
    captures = assemble(written(read(spark, folder).drop("payload").withColumn("payload", F.lit(None).cast("binary")), f"{folder}-records"))
    page = F.try_element_at(F.map_from_entries(F.try_element_at("metadata", F.lit(1))["fields"]), F.lit("page-id")).cast("long")
    rows = captures.select("capture_id", page.alias("page_id"), "response.payload_bytes", "response.payload_digest", F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("ref"), F.col("response.target_uri").alias("url"))
    held = rows.where("record_type = 'response'").select(F.col("capture_id").alias("_ref"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("_bytes"))
    found = rows.join(held, F.col("ref") == F.col("_ref"), "left")
    return found.select("page_id", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "url")


QUERIES = {"op1_warc": op1_warc}
ORACLE = {
    "op1_warc": f"""
WITH p AS (
  SELECT page_id, url, sha1(coalesce(html, '')) AS digest, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages
), l AS (
  SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS leader FROM p
)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= {REVISIT_BYTES} AND leader <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {REVISIT_BYTES} AND leader <> page_id THEN leader END AS refers_to, url
FROM l
""",
}
