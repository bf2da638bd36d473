"""WARC archives as a PySpark data source (``format("warc")``).

Writing: rows of (record_type, record_id, target_uri, refers_to, payload_digest,
payload_length, payload) become WARC/1.1 records. Each task writes files of its own name, a
file is closed at ``max_file_bytes``, and the commit lists the files of the tasks that
counted in a manifest, so retried and lost tasks leave nothing a reader sees. Each record is
a gzip member whose extra field ``sl`` (the WARC format's annex on compression) holds its
compressed and full length. Every commit adds a manifest of its own, so ``append`` keeps what
was there; ``overwrite`` names the manifests it replaces, which readers then leave out.

Reading: partitions are sets of whole files of about ``partition_bytes``. A record's headers
are decoded first; predicates on record type, ids, URI, digest and length are pushed down
and decided on headers alone (``spark.sql.python.filterPushdown.enabled``). The payload of a
record that is rejected, or of any record with ``payload=false``, is never decoded: the
reader jumps to the next member by its stored length (or inflates without keeping, for
archives of others without that field).

Paths are opened by pyarrow.fs (file, hdfs, s3, gs), so archives may be in any shared store.

Edge cases: null payloads are empty; null fields are absent headers and read back as null,
but for record ids, which the format demands: a row without one gets a random one; values
with line breaks or white space at an end are percent-encoded, ids without angle brackets
get them, and a further header (``FORMS``) says so, so every value reads back as it was and
those of other archives as they are; a very long payload is one record, held once by its
task; repeated rows are records each; a damaged file raises; an empty table makes an empty
archive; a folder without a manifest is read by its ``*.warc`` and ``*.warc.gz`` files.
Further columns of a written table are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timezone
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, WriterCommitMessage

HEADER_COLUMNS = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_length long"
#: Header fields of WARC/1.1 (and one extension) by column.
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "payload_length": "X-Payload-Length"}
#: Fixed value: what WARC/1.1 calls revisits of equal payloads.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Header (an extension) that lists columns whose values were brought into another form.
FORMS = "X-Value-Forms"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MANIFEST = "_manifest"


def filesystem(path: str) -> tuple["pa.fs.FileSystem", str]:
    from pyarrow import fs

    if "://" not in path and path.startswith("file:"):
        path = "file://" + path[5:]
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def record(row: dict, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record, uncompressed."""
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    block = b"" if revisit else _HTTP + payload
    lines, forms = ["WARC/1.1"], []
    for column, name in HEADERS.items():
        value = row[column]
        if value is None and column == "record_id":
            value = f"<urn:uuid:{uuid.uuid4()}>"
        if value is None:
            continue
        value = str(value)
        if value != value.strip() or "\r" in value or "\n" in value:
            value = re.sub(r"[%\s]", lambda m: quote(m[0], safe=""), value)
            forms.append(f"{column}=escaped")
        if column in ("record_id", "refers_to") and not (value.startswith("<") and value.endswith(">")):
            value = f"<{value}>"
            forms.append(f"{column}=bare")
        lines.append(f"{name}: {value}")
    if forms:
        lines.append(f"{FORMS}: {','.join(forms)}")
    if revisit:
        lines.append(f"WARC-Profile: {PROFILE}")
    else:
        lines.append("Content-Type: application/http; msgtype=response")
    lines += [f"WARC-Date: {date}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member of one record, its lengths in the extra field."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def parse_headers(head: bytes) -> dict:
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields


class Records:
    """Records of one file: headers first, payloads only where they are wanted."""

    def __init__(self, file, compressed: bool, chunk: int = 64 << 10) -> None:
        self.file, self.compressed, self.chunk = file, compressed, chunk
        self.decoded = 0  # bytes inflated or read, for tests and tuning

    def __iter__(self) -> Iterator[tuple[dict, Callable[[], bytes]]]:
        at, size = 0, self.file.size()
        while at < size:
            at = yield from (self._member(at) if self.compressed else self._plain(at))

    def _plain(self, at: int) -> Iterator:
        self.file.seek(at)
        head = b""
        while b"\r\n\r\n" not in head:
            more = self.file.read(4096)
            if not more:
                raise ValueError("a WARC record ends within its headers")
            head += more
        end = head.index(b"\r\n\r\n") + 4
        fields = parse_headers(head[: end - 4])
        length = int(fields["content-length"])

        def block() -> bytes:
            self.file.seek(at + end)
            data = self.file.read(length)
            self.decoded += len(data)
            if len(data) < length:
                raise ValueError("a WARC record ends within its block")
            return data

        yield fields, block
        return at + end + length + 4

    def _member(self, at: int) -> Iterator:
        self.file.seek(at)
        raw = self.file.read(self.chunk)
        if raw[:2] != b"\x1f\x8b":
            raise ValueError(f"no gzip member at {at}")
        jump = None
        if raw[3] & 4:
            extra = raw[12 : 12 + struct.unpack("<H", raw[10:12])[0]]
            while len(extra) >= 4:
                n = struct.unpack("<H", extra[2:4])[0]
                if extra[:2] == b"sl" and n == 8:
                    jump = struct.unpack("<I", extra[4:8])[0]
                extra = extra[4 + n :]
        inflate = zlib.decompressobj(31)
        taken, rest = len(raw), raw
        head = b""
        while b"\r\n\r\n" not in head:
            piece = inflate.decompress(rest, 2048)
            rest = inflate.unconsumed_tail
            head += piece
            self.decoded += len(piece)
            if b"\r\n\r\n" not in head and not rest:
                if inflate.eof or not (rest := self.file.read(self.chunk)):
                    raise ValueError("a WARC record ends within its headers")
                taken += len(rest)
        end = head.index(b"\r\n\r\n") + 4
        fields = parse_headers(head[: end - 4])
        length = int(fields["content-length"])
        position = [at + taken]

        def inflated(keep: bool) -> bytes:
            nonlocal rest
            self.file.seek(position[0])
            parts, n = ([head[end:]] if keep else []), len(head) - end
            while not inflate.eof:
                piece = inflate.decompress(rest, 1 << 20)
                rest = inflate.unconsumed_tail
                n += len(piece)
                self.decoded += len(piece)
                if keep:
                    parts.append(piece)
                if not piece and not rest and not inflate.eof:
                    rest = self.file.read(self.chunk)
                    position[0] += len(rest)
                    if not rest:
                        raise ValueError("a gzip member is cut short")
            if n < length:
                raise ValueError("a WARC record ends within its block")
            return b"".join(parts)[:length] if keep else b""

        used = []

        def block() -> bytes:
            used.append(True)
            return inflated(True)

        yield fields, block
        if jump:
            return at + jump
        if not used:
            inflated(False)
        return position[0] - len(inflate.unused_data)


def payload_of(fields: dict, block: bytes) -> bytes:
    """A response's payload is what follows its HTTP headers."""
    if fields.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def row_of(fields: dict) -> dict:
    out = {column: fields.get(name.lower()) for column, name in HEADERS.items()}
    for form in reversed(fields.get(FORMS.lower(), "").split(",")):
        column, _, how = form.partition("=")
        if out.get(column) is not None:
            out[column] = unquote(out[column]) if how == "escaped" else out[column][1:-1]
    length = out["payload_length"]
    out["payload_length"] = int(length) if length is not None else None
    return out


def manifests(store, root: str) -> dict[str, dict]:
    """The manifests of an archive by name, without those that others replace."""
    from pyarrow import fs

    found = {}
    for x in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if x.type == fs.FileType.File and x.base_name.startswith(MANIFEST) and x.base_name.endswith(".json"):
            with store.open_input_stream(x.path) as f:
                found[x.base_name] = json.loads(f.read())
    gone = {name for m in found.values() for name in m["replaces"]}
    return {name: m for name, m in found.items() if name not in gone}


class Files(InputPartition):
    def __init__(self, files: Sequence[str]) -> None:
        self.files = list(files)


#: What a pushed predicate asks of a header's value.
_TESTS = {EqualTo: lambda v, x: v is not None and v == x, In: lambda v, x: v is not None and v in x, GreaterThan: lambda v, x: v is not None and v > x, GreaterThanOrEqual: lambda v, x: v is not None and v >= x, LessThan: lambda v, x: v is not None and v < x, LessThanOrEqual: lambda v, x: v is not None and v <= x}


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, with_payload: bool) -> None:
        self.path, self.with_payload = options["path"], with_payload
        self.partition_bytes = int(options.get("partition_bytes", 64 << 20))
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and (type(f) in _TESTS or isinstance(f, (IsNotNull, IsNull))):
                self.tests.append((column, type(f), getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = filesystem(self.path)
        listed = manifests(store, root)
        sizes = {name: size for m in listed.values() for name, size in m["files"].items()}
        if not listed:
            found = store.get_file_info(fs.FileSelector(root, recursive=True)) if store.get_file_info(root).type == fs.FileType.Directory else [store.get_file_info(root)]
            sizes = {x.path.removeprefix(root).lstrip("/"): x.size for x in found if x.type == fs.FileType.File and x.path.endswith((".warc", ".warc.gz"))}
        out, held, size = [], [], 0
        for name in sorted(sizes):
            if held and size + sizes[name] > self.partition_bytes:
                out.append(Files(held))
                held, size = [], 0
            held.append(f"{root}/{name}".rstrip("/"))
            size += sizes[name]
        return [*out, Files(held)] if held or not out else out

    def wanted(self, row: dict) -> bool:
        for column, kind, value in self.tests:
            if kind is IsNull or kind is IsNotNull:
                if (row[column] is None) != (kind is IsNull):
                    return False
            elif not _TESTS[kind](row[column], value):
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(self.path)
        kinds = {c: pa.int64() if c == "payload_length" else pa.string() for c in HEADERS} | ({"payload": pa.binary()} if self.with_payload else {})
        rows: list[dict] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in kinds.items()], names=list(kinds))

        for name in partition.files:
            with store.open_input_file(name) as file:
                for fields, block in Records(file, name.endswith(".gz")):
                    row = row_of(fields)
                    if not self.wanted(row):
                        continue
                    if self.with_payload:
                        row["payload"] = payload_of(fields, block()) if row["record_type"] != "revisit" else b""
                        held += len(row["payload"])
                    rows.append(row)
                    if len(rows) >= 2000 or held >= 8 << 20:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()


class Written(WriterCommitMessage):
    def __init__(self, files: dict[str, int]) -> None:
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool = False) -> None:
        self.path, self.overwrite = options["path"], overwrite
        self.date = options.get("date") or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        self.max_file_bytes = int(options.get("max_file_bytes", 64 << 20))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = filesystem(self.path)
        store.create_dir(root, recursive=True)
        files: dict[str, int] = {}
        out, name = None, ""
        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, files[name] = store.open_output_stream(f"{root}/{name}", compression=None), 0
                data = member(record({n: batch.column(k)[i].as_py() for k, n in enumerate(names)}, self.date))
                out.write(data)
                files[name] += len(data)
                if files[name] >= self.max_file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = filesystem(self.path)
        store.create_dir(root, recursive=True)
        before = manifests(store, root) if self.overwrite else {}
        files = {k: v for m in messages if m for k, v in m.files.items()}
        # One file decides: a reader sees the whole commit or nothing of it.
        with store.open_output_stream(f"{root}/{MANIFEST}-{uuid.uuid4().hex}.json", compression=None) as f:
            f.write(json.dumps({"files": files, "replaces": sorted(before)}).encode())
        for m in before.values():
            for name in m["files"]:
                store.delete_file(f"{root}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        store, root = filesystem(self.path)
        for m in messages:
            for name in m.files if m else ():
                store.delete_file(f"{root}/{name}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def _with_payload(self) -> bool:
        return str(self.options.get("payload", "true")).lower() != "false"

    def schema(self) -> str:
        return HEADER_COLUMNS + (", payload binary" if self._with_payload() else "")

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options), self._with_payload())

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
