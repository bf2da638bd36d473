"""Arrow IPC files of encoded batches, read and written by executors.

A store is a folder of files and, for each commit, a manifest with the rows of every record
batch. Writing: each task writes its batches in the format's wire types (sizes as unsigned
32-bit integers, checked) with the metadata key on the schema; one manifest file makes a whole
commit visible. Reading: a partition is a record batch; ``columns`` and ``rows`` (from, to) are
options of the source, so a batch outside the range isn't opened and a column that isn't asked
for isn't read. Nothing passes through the driver but manifests.

Folders without manifests (files of other producers) are read by file: a partition each, its
batches one after another; row ranges then need the footers of the files before.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema

from .. import __version__
from ..errors import SizeOutOfRange
from ..functions.arrays import decode_batches, encode_batches
from ..functions.schema import METADATA_KEY, NAMES, SIZES, VALUES, check_nd, marked, nd_columns
from .arrow import converted, spark_type

#: What manifests are called; rows given to Spark at once.
MANIFEST, ROWS = "_manifest", 4096


def _store(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _manifests(store: pa.fs.FileSystem, root: str) -> dict[str, list[int]]:
    """Rows of each record batch, by file, of all commits in force."""
    found, replaced = {}, set()
    for info in store.get_file_info(pa.fs.FileSelector(root, allow_not_found=True)):
        if info.base_name.startswith(MANIFEST):
            with store.open_input_stream(info.path) as f:
                told = json.loads(f.read())
            found[info.base_name] = told["files"]
            replaced |= set(told["replaces"])
    return {name: rows for m, files in sorted(found.items()) if m not in replaced for name, rows in sorted(files.items())}


def _manifest_names(store: pa.fs.FileSystem, root: str) -> list[str]:
    return sorted(i.base_name for i in store.get_file_info(pa.fs.FileSelector(root, allow_not_found=True)) if i.base_name.startswith(MANIFEST))


def _files(store: pa.fs.FileSystem, root: str) -> dict[str, list[int] | None]:
    told = _manifests(store, root)
    if told or _manifest_names(store, root):
        return told
    return {i.base_name: None for i in sorted(store.get_file_info(pa.fs.FileSelector(root)), key=lambda i: i.base_name) if i.is_file and not i.base_name.startswith(("_", "."))}


def wire(array: pa.Array) -> pa.Array:
    """An encoded array in wire types; sizes that don't fit 32 bits are an error."""
    if not (pa.types.is_struct(array.type) and {NAMES, SIZES, VALUES} <= {f.name for f in array.type}):
        return array
    sizes = array.field(SIZES)
    ends = pc.min_max(sizes.flatten())
    if ends["max"].as_py() is not None and not (0 <= ends["min"].as_py() and ends["max"].as_py() < 2**32):
        raise SizeOutOfRange(f"{SizeOutOfRange.code}: dimension sizes are unsigned 32-bit integers in Arrow")
    fields = [array.field(NAMES), sizes.cast(pa.list_(pa.uint32())), array.field(VALUES)]
    return pa.StructArray.from_arrays(fields, names=[NAMES, SIZES, VALUES], mask=pc.is_null(array))


class Batches(InputPartition):
    """Record batches of one file: one of them, or (None) all; and the rows wanted of them."""

    def __init__(self, file: str, batch: int | None, first: int, last: int | None) -> None:
        self.file, self.batch, self.first, self.last = file, batch, first, last


class Written(WriterCommitMessage):
    def __init__(self, files: dict[str, list[int]]) -> None:
        self.files = files


class ArrowFilesReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.path, self.names = options["path"], schema.fieldNames()
        rows = options.get("rows")
        self.rows = tuple(json.loads(rows)) if rows else None

    def partitions(self) -> list[InputPartition]:
        store, root = _store(self.path)
        out, at = [], 0
        low, high = self.rows or (0, None)
        for name, batches in _files(store, root).items():
            if batches is None and self.rows is None:
                out.append(Batches(name, None, 0, None))
                continue
            if batches is None:
                with pa.ipc.open_file(store.open_input_file(f"{root}/{name}")) as f:
                    batches = [f.get_batch(i).num_rows for i in range(f.num_record_batches)]
            for i, n in enumerate(batches):
                first, last = max(low - at, 0), n if high is None else min(high - at, n)
                if first < last:
                    out.append(Batches(name, i, first, last))
                at += n
        return out or [Batches("", None, 0, 0)]

    def read(self, partition: Batches) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        store, root = _store(self.path)
        with store.open_input_file(f"{root}/{partition.file}") as source:
            fields = pa.ipc.open_file(source).schema.names
            options = pa.ipc.IpcReadOptions(included_fields=sorted(fields.index(c) for c in self.names))
            file = pa.ipc.open_file(source, options=options)
            for i in range(file.num_record_batches) if partition.batch is None else [partition.batch]:
                batch = file.get_batch(i)
                if partition.last is not None:
                    batch = batch.slice(partition.first, partition.last - partition.first)
                columns = [batch.column(batch.schema.get_field_index(c)) for c in self.names]
                made = pa.RecordBatch.from_arrays([converted(c, spark_type(c.type)) for c in columns], names=self.names)
                for at in range(0, made.num_rows, ROWS):
                    yield made.slice(at, ROWS)


class ArrowFilesWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite, self.key = options["path"], overwrite, options.get("key", METADATA_KEY)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        name, out, rows = f"{uuid.uuid4().hex}.arrow", None, []
        sink = None
        for batch in batches:
            columns = [wire(c) for c in batch.columns]
            made = pa.RecordBatch.from_arrays(columns, schema=pa.schema([pa.field(n, c.type) for n, c in zip(batch.schema.names, columns, strict=True)], {self.key: __version__}))
            if out is None:
                sink = store.open_output_stream(f"{root}/{name}", compression=None)
                out = pa.ipc.new_file(sink, made.schema)
            out.write_batch(made)
            rows.append(made.num_rows)
        if out is None:
            return Written({})
        out.close()
        sink.close()
        return Written({name: rows})

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        before = _manifest_names(store, root) if self.overwrite else []
        gone = _manifests(store, root) if self.overwrite else {}
        files = {k: v for m in messages if m for k, v in m.files.items()}
        with store.open_output_stream(f"{root}/{MANIFEST}-{uuid.uuid4().hex}.json", compression=None) as f:
            f.write(json.dumps({"files": files, "replaces": before}).encode())
        for name in gone:
            store.delete_file(f"{root}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        for m in messages:
            for name in m.files if m else ():
                store.delete_file(f"{root}/{name}")


class ArrowFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "nd_arrow"

    def schema(self) -> T.StructType:
        store, root = _store(self.options["path"])
        wanted = json.loads(self.options["columns"]) if self.options.get("columns") else None
        fields = [f for f in _schema(store, root) if wanted is None or f.name in wanted]
        return from_arrow_schema(pa.schema([pa.field(f.name, spark_type(f.type), True) for f in fields]), prefer_timestamp_ntz=True)

    def reader(self, schema: T.StructType) -> ArrowFilesReader:
        return ArrowFilesReader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> ArrowFilesWriter:
        return ArrowFilesWriter(dict(self.options), overwrite)


def _schema(store: pa.fs.FileSystem, root: str) -> pa.Schema:
    """Of the first file; its footer alone is read."""
    for name in _files(store, root):
        with store.open_input_file(f"{root}/{name}") as source:
            return pa.ipc.open_file(source).schema
    raise FileNotFoundError(f"no Arrow file in {root}")


def write_arrow(df: DataFrame, path: str, columns: Sequence[str] | None = None, mode: str = "append", key: str = METADATA_KEY) -> None:
    """Validated batches to Arrow files. ``append`` adds a commit, ``overwrite`` replaces all."""
    df.sparkSession.dataSource.register(ArrowFiles)
    encode_batches(df, columns, key).write.format("nd_arrow").option("key", key).mode(mode).save(path)


def read_arrow(spark: SparkSession, path: str, columns: Sequence[str] | None = None, rows: tuple[int, int] | None = None, need_metadata: bool = True, key: str = METADATA_KEY) -> DataFrame:
    """Encoded batches of Arrow files: of ``columns`` only, of the rows from, to only (in the
    order of the files). What the schema has under ``key`` becomes the columns' metadata;
    columns that hold no encoded arrays are passed on as they are."""
    spark.dataSource.register(ArrowFiles)
    reader = spark.read.format("nd_arrow")
    if columns is not None:
        reader = reader.option("columns", json.dumps(list(columns)))
    if rows is not None:
        reader = reader.option("rows", json.dumps(list(rows)))
    df = reader.load(path)
    arrays = nd_columns(df)
    version = (_schema(*_store(path)).metadata or {}).get(key.encode())
    if version is not None:
        df = marked(df, arrays, key, version.decode())
    for c in arrays:
        check_nd(df.schema[c].dataType, c)
    return decode_batches(df, arrays, need_metadata=need_metadata, key=key)
