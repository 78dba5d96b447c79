"""WARC archives as a Python data source of Spark, for reading and writing.

Reading plans one partition for a bundle of files, takes filters on the record type and on
other header columns, parses a record's header first, and steps over the payload of a record
that no filter wants; with the option `payload` set to false it steps over all of them. A
payload that is read is checked against the digest in the header.

Each task writes files of its own, and the commit lists those of the tasks that succeeded in
one manifest, so files of lost or repeated tasks are never read. Paths may be local or URIs
that pyarrow opens (file, hdfs, s3, …).
"""

import base64
import gzip
import hashlib
import io
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    WriterCommitMessage,
)

from partatlas.llm.common import written
from partatlas.operators.skew import attach_by_key

FILE_BYTES = 64 << 20
BUNDLE_BYTES = 32 << 20
BATCH_BYTES = 4 << 20
SUFFIXES = (".warc", ".warc.gz")
DATE = "2000-01-01T00:00:00Z"  # records carry no time of their own, so that a rerun writes the same bytes
_ID = "urn:x-page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_COLUMNS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "content_type": "Content-Type",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
}
READ_SCHEMA = ", ".join(f"{c} string" for c in _COLUMNS) + ", payload_bytes long, payload binary"


def _opened(path):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(value) -> str:
    return " ".join(str(value).split())


def record_bytes(headers: dict, block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {_one_line(v)}" for k, v in headers.items() if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id, url, payload: bytes, digest: str, refers_to=None, refers_uri=None) -> bytes:
    """A response record of a page, or a revisit record if it refers to another page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<{_ID}{'null' if page_id is None else page_id}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": url,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Profile": None if refers_to is None else _PROFILE,
        "WARC-Refers-To": None if refers_to is None else f"<{_ID}{refers_to}>",
        "Content-Type": "application/http; msgtype=response",
    }
    return record_bytes(headers, http + payload if refers_to is None else http)


def read_header(stream):
    """Headers (names in lower case) of the next record, None at the end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    headers, name = {}, None
    for line in iter(stream.readline, b""):
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if not text:
            return headers
        if text[0] in " \t" and name:
            headers[name] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        name = name.strip().lower()
        headers[name] = value.strip()
    raise ValueError("a WARC record ends in its header")


def _http_head(read, length):
    """(the length that the HTTP header states or None, bytes of the header) of a block of `length` bytes.

    Reads on to the blank line that ends the header, however long that is; without one, the whole
    block is payload.
    """
    held, seen = bytearray(), 0
    while (end := held.find(b"\r\n\r\n", seen)) < 0 and len(held) < length:
        seen = max(0, len(held) - 3)
        held += read(min(4096, length - len(held)))
    if end < 0:
        return None, 0, held
    for line in held[:end].split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            return int(value), end + 4, held
    return None, end + 4, held


class _Exact:
    """A stream whose reads and skips fail where the file ends too early. `size` is None if it cannot be known."""

    def __init__(self, stream, size):
        self.stream, self.size = stream, size

    def read(self, n):
        data = self.stream.read(n)
        if len(data) < n:
            raise ValueError("a WARC record is cut short")
        return data

    def skip(self, n):
        if self.size is None:  # compressed: what is skipped has to be inflated
            for begin in range(0, n, 1 << 20):
                self.read(min(1 << 20, n - begin))
        elif self.stream.seek(n, io.SEEK_CUR) > self.size:
            raise ValueError("a WARC record is cut short")


def _plain(name, value):
    if value is None:
        return None
    if name in ("record_id", "refers_to"):
        return value.strip("<>")
    return value.removeprefix("sha1:") if name == "payload_digest" else value


def records(stream, wanted, with_payload=True, seekable=True):
    """Rows of READ_SCHEMA of the records whose header meets `wanted` ({column: values or None for any}).

    `payload_bytes` is the length of the payload in the record; of a revisit, which has none,
    the length that its HTTP header states. A record that is cut short raises an error, whether
    its payload is wanted or not.
    """
    size = None
    if seekable:
        begin = stream.tell()
        size = stream.seek(0, io.SEEK_END)
        stream.seek(begin)
    exact = _Exact(stream, size)
    while (headers := read_header(stream)) is not None:
        length = int(headers.get("content-length", 0))
        row = {c: _plain(c, headers.get(h.lower())) for c, h in _COLUMNS.items()}
        if any(row[c] is None or (v is not None and row[c] not in v) for c, v in wanted.items()):
            exact.skip(length)
            continue
        http = "application/http" in (row["content_type"] or "")
        n_bytes, payload = length, None
        if http:
            stated, begin, held = _http_head(exact.read, length)
            n_bytes = length - begin
            if row["record_type"] == "revisit":
                n_bytes = stated if stated is not None else n_bytes
                exact.skip(length - len(held))
            elif with_payload:
                payload = bytes(held[begin:]) + exact.read(length - len(held))
            else:
                exact.skip(length - len(held))
        elif with_payload:
            payload = exact.read(length)
        else:
            exact.skip(length)
        if payload is not None and row["record_type"] == "response" and row["payload_digest"] not in (None, payload_digest(payload)):
            raise ValueError(f"the payload of {row['record_id']} does not match its digest")
        yield (*row.values(), n_bytes, payload)


def _batches(rows):
    """Arrow batches of rows of READ_SCHEMA, of some megabytes each."""
    import pyarrow as pa

    kinds = [*[pa.string()] * len(_COLUMNS), pa.int64(), pa.binary()]
    names = [*_COLUMNS, "payload_bytes", "payload"]

    def batch(held):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 500 + len(row[-1] or b"")
        if size >= BATCH_BYTES:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)


class Files(InputPartition):
    def __init__(self, paths):
        super().__init__(paths)
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.with_payload = str(options.get("payload", "true")).lower() == "true"
        self.wanted = {}

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if name in _COLUMNS and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                before = self.wanted.get(name)
                self.wanted[name] = values if before is None else before & values
            elif name in _COLUMNS and isinstance(f, IsNotNull):
                self.wanted.setdefault(name)
            else:
                yield f

    def partitions(self):
        """Files bundled to about 32 MB; of a folder that a job here wrote, those its manifests list."""
        from pyarrow import fs

        system, path = _opened(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == fs.FileType.File:
            return [Files([path])]
        found = system.get_file_info(fs.FileSelector(path, recursive=True))
        found = [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(".")]
        listed = set()
        manifests = [f for f in found if f.base_name.startswith("_manifest-")]
        for f in manifests:
            with system.open_input_stream(f.path) as stream:
                listed |= set(json.loads(stream.read()))
        files = [f for f in found if not f.base_name.startswith("_")]
        if foreign := [f.path for f in files if not f.base_name.endswith(SUFFIXES)]:
            raise ValueError(f"not a WARC file: {foreign[0]}")
        files = [f for f in files if not manifests or f.base_name in listed]
        bundles, held = [], BUNDLE_BYTES
        for f in sorted(files, key=lambda f: f.path):
            if held >= BUNDLE_BYTES:
                bundles.append([])
                held = 0
            bundles[-1].append(f.path)
            held += f.size
        return [Files(b) for b in bundles] or [Files([])]

    def read(self, partition):
        system, _ = _opened(self.path)
        for path in partition.paths:
            with system.open_input_file(path) as file, io.BufferedReader(file, 1 << 20) as stream:
                if path.endswith(".gz"):  # a member for each record, one after the other
                    with gzip.GzipFile(fileobj=stream) as inflated, io.BufferedReader(inflated, 1 << 20) as plain:
                        yield from _batches(records(plain, self.wanted, self.with_payload, seekable=False))
                else:
                    yield from _batches(records(stream, self.wanted, self.with_payload))


class Written(WriterCommitMessage):
    def __init__(self, names):
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    """Writes rows (page_id, url, payload, refers_to, …); `refers_to` makes a revisit record."""

    def __init__(self, options):
        self.path = options["path"]

    def write(self, iterator):
        system, folder = _opened(self.path)
        system.create_dir(folder, recursive=True)
        names, stream, size = [], None, 0
        try:
            for batch in iterator:
                columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to"))
                for page_id, url, payload, refers_to in zip(*columns):
                    if stream is None or size >= FILE_BYTES:
                        if stream is not None:
                            stream.close()
                        names.append(f"part-{uuid.uuid4().hex}.warc")
                        stream, size = system.open_output_stream(f"{folder}/{names[-1]}", buffer_size=1 << 20), 0
                    payload = payload or b""
                    data = page_record(page_id, url, payload, payload_digest(payload), refers_to)
                    stream.write(data)
                    size += len(data)
        finally:
            if stream is not None:
                stream.close()
        return Written(names)

    def commit(self, messages):
        system, folder = _opened(self.path)
        system.create_dir(folder, recursive=True)
        names = [n for m in messages if m is not None for n in m.names]
        with system.open_output_stream(f"{folder}/_manifest-{uuid.uuid4().hex}.json") as stream:
            stream.write(json.dumps(names).encode())

    def abort(self, messages):
        system, folder = _opened(self.path)
        for m in messages:
            for name in m.names if m is not None else []:
                system.delete_file(f"{folder}/{name}")


class WarcSource(DataSource):
    """Format `warc`; options: path, payload (false skips all payloads)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return READ_SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make the format `warc` known and let its filters be pushed down."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def deduplicated(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to): which pages revisit an equal payload of a later page.

    Of equal payloads of at least `least_bytes`, the page with the largest id is kept as a
    response and the others refer to it; smaller payloads are all responses. A null html is an
    empty payload. Rows that repeat the largest id are all responses, and a row without an id
    refers to the largest id of its payload, or is a response if there is none.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    keyed = rows.withColumn("digest", F.concat_ws("-", F.sha1("payload"), F.octet_length("payload")))
    groups = written(
        keyed.select("digest", "page_id", F.octet_length("payload").alias("bytes"))
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("copies"), F.max("page_id").alias("latest"), F.first("bytes").alias("bytes"))
        .where((F.col("copies") > 1) & (F.col("bytes") >= least_bytes))
        .select("digest", "copies", "latest")
    )
    joined = attach_by_key(keyed, groups, "digest", "copies", ["page_id"], how="left")
    same = F.col("page_id").eqNullSafe(F.col("latest"))
    return joined.select("page_id", "url", "payload", F.when(F.col("latest").isNotNull() & ~same, F.col("latest")).alias("refers_to"))


def write_archive(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write a record for every row of `pages` (page_id, url, html) to WARC files under `path`.

    A null url leaves the target out, a null html is an empty payload; other columns are not
    looked at, and an empty table writes no record.
    """
    register(pages.sparkSession)
    deduplicated(pages, least_bytes).write.format("warc").mode("append").save(path)


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of the WARC files under `path` with the columns of READ_SCHEMA.

    Files end in .warc or .warc.gz; a folder is read with all folders in it, and a file of another
    name in it is an error, but for names that begin with a dot or an underscore. An empty folder
    has no records. A header field that a record lacks is null.
    """
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def page_number(record_id):
    """The page id in a record id, null for pages without one."""
    return F.expr(f"try_cast(substring({record_id}, {len(_ID) + 1}) AS BIGINT)")
