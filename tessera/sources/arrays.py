"""Sources for files that Spark has none for: arrays of vectors (.npy, .npz) and Parquet tables inside ZIP archives.

Register them with register(spark), then spark.read.format("npy").load(folder), df.write.format("npy").save(folder) and
spark.read.format("zipped").option("member", "train.parquet").load(archive). Tasks open files by PyArrow's file systems,
so a path must lead to a folder that all executors reach.
"""

from __future__ import annotations

import ast
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

MANIFEST = "_manifest.json"
#: Files that a writer makes begin so. They count only if a manifest names them: tasks that failed leave some behind.
WRITTEN = "written-"
#: Bytes that one task reads of an array, and rows of one batch inside a task.
SPLIT, BATCH = 64 << 20, 8192
#: Rows of one written file; a task holds no more of them.
FILE_ROWS = 65_536


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


@dataclass(frozen=True)
class Array:
    """Where an array lies: from which byte of which file, or in which compressed member (then offset is None)."""

    path: str
    member: str | None
    offset: int | None
    shape: tuple[int, ...]
    dtype: str


def _header(f, path: str) -> tuple[tuple[int, ...], np.dtype, int]:
    """(shape, type, bytes) of an array's header. Arrays of objects and columns first are refused."""
    magic = f.read(8)
    if magic[:6] != b"\x93NUMPY":
        raise ValueError(f"{path}: no array")
    size, kind = (2, "<H") if magic[6] == 1 else (4, "<I")
    (n,) = struct.unpack(kind, f.read(size))
    said = ast.literal_eval(f.read(n).decode("latin1"))
    dtype = np.dtype(said["descr"])
    if dtype.hasobject or (said["fortran_order"] and len(said["shape"]) > 1):
        raise ValueError(f"{path}: arrays of objects, and arrays by column, aren't read")
    return tuple(said["shape"]), dtype, 8 + size + n


def describe(path: str) -> list[Array]:
    """The arrays of a .npy or .npz file, from their headers."""
    fs, at = _open(path)
    with fs.open_input_file(at) as f:
        if not path.endswith(".npz"):
            shape, dtype, n = _header(f, path)
            return [Array(path, None, n, shape, dtype.str)]
        out = []
        with zipfile.ZipFile(f) as z:
            for i in z.infolist():
                with z.open(i) as m:
                    shape, dtype, n = _header(m, f"{path}:{i.filename}")
                start = None
                if i.compress_type == zipfile.ZIP_STORED:
                    f.seek(i.header_offset + 26)
                    start = i.header_offset + 30 + sum(struct.unpack("<HH", f.read(4))) + n
                out.append(Array(path, i.filename.removesuffix(".npy"), start, shape, dtype.str))
        return out


def _rows(a: Array, start: int, stop: int) -> Iterator[np.ndarray]:
    """Rows start to stop in batches, by byte range where the array isn't compressed."""
    dtype, width = np.dtype(a.dtype), int(np.prod(a.shape[1:], dtype=np.int64))
    size = dtype.itemsize * width
    fs, at = _open(a.path)
    with fs.open_input_file(at) as f:
        z = None
        if a.offset is None:
            z = zipfile.ZipFile(f).open(f"{a.member}.npy")
            _header(z, a.path)
            left = start * size
            while left:  # a compressed member is read from its beginning
                left -= len(z.read(min(left, 1 << 20)) or b"") or left
        else:
            f.seek(a.offset + start * size)
        for i in range(start, stop, BATCH):
            n = min(BATCH, stop - i)
            data = (z or f).read(n * size)
            if len(data) != n * size:
                raise ValueError(f"{a.path}: ends before row {i + n}")
            yield np.frombuffer(data, dtype).reshape(n, *a.shape[1:])


@dataclass
class Span(InputPartition):
    vectors: Array
    ids: Array | None
    start: int
    stop: int


class NpyReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Span]:
        out = []
        for vectors, ids in _pairs(self.path):
            n, size = vectors.shape[0], int(np.prod(vectors.shape[1:])) * np.dtype(vectors.dtype).itemsize
            step = max(1, self.split // max(1, size)) if vectors.offset is not None and (ids is None or ids.offset is not None) else max(1, n)
            out += [Span(vectors, ids, i, min(n, i + step)) for i in range(0, n, step)]
        return out

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no rows at all
            return
        at, vectors = partition.start, _rows(partition.vectors, partition.start, partition.stop)
        ids = _rows(partition.ids, partition.start, partition.stop) if partition.ids else None
        for v in vectors:
            n, dim = v.shape
            kind = pa.float64() if v.dtype.itemsize > 4 else pa.float32()
            flat = pa.array(np.ascontiguousarray(v, v.dtype.newbyteorder("=")).reshape(-1).astype(kind.to_pandas_dtype()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * dim, dim or 1, dtype=np.int32)[: n + 1]), flat) if dim else pa.array([[]] * n, pa.list_(kind))
            if ids is None:
                key, name = pa.array(np.arange(at, at + n, dtype=np.int64)), "row"
            else:
                k, name = next(ids), "id"
                key = pa.array(k.tolist(), pa.string()) if k.dtype.kind == "U" else pa.array(k.astype(np.int64))
            file = pa.array([PurePosixPath(partition.vectors.path).name] * n, pa.string())
            yield pa.RecordBatch.from_arrays([file, key, lists], names=["file", name, "vector"])
            at += n


def _files(path: str) -> list[str]:
    """The files of a written folder's manifest; of another folder, all arrays in it that no writer made; or the file itself."""
    fs, at = _open(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise ValueError(f"{path}: nothing there")
    if info.type == pafs.FileType.File:
        return [path]
    root = path.rstrip("/")
    if fs.get_file_info(f"{at}/{MANIFEST}").type == pafs.FileType.File:
        with fs.open_input_stream(f"{at}/{MANIFEST}") as f:
            return [f"{root}/{n}" for n in json.loads(f.read())["files"]]
    return sorted(f"{root}/{i.base_name}" for i in fs.get_file_info(pafs.FileSelector(at)) if i.base_name.endswith((".npy", ".npz")) and not i.base_name.startswith(WRITTEN))


def _pairs(path: str) -> list[tuple[Array, Array | None]]:
    """(vectors, ids) of each file. Vectors are the array of two dimensions, ids one of one dimension and as many rows."""
    out = []
    for f in _files(path):
        every = describe(f)
        two, one = [a for a in every if len(a.shape) == 2], [a for a in every if len(a.shape) == 1]
        if len(two) != 1 or len(one) > 1 or np.dtype(two[0].dtype).kind not in "fiu":
            raise ValueError(f"{f}: not one array of vectors, with one of ids at most")
        if one and (one[0].shape[0] != two[0].shape[0] or np.dtype(one[0].dtype).kind not in "iuU"):
            raise ValueError(f"{f}: {one[0].shape[0]} ids of type {one[0].dtype} for {two[0].shape[0]} vectors")
        out.append((two[0], one[0] if one else None))
    return out


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    rows: int


class NpyWriter(DataSourceArrowWriter):
    """Each task writes .npz files of bounded size; they count once the manifest, written last, names them."""

    def __init__(self, path: str, names: list[str], overwrite: bool):
        self.path, self.names, self.overwrite = path.rstrip("/"), names, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task, files, total = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}", [], 0
        fs, at = _open(self.path)
        fs.create_dir(at, recursive=True)
        held: list[pa.RecordBatch] = []

        def flush() -> None:
            t = pa.Table.from_batches(held)
            held.clear()
            vectors, ids = t.column(1).combine_chunks(), t.column(0)
            if t.column(0).null_count or vectors.null_count:
                raise ValueError("ids and vectors must not be null")
            sizes = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten()
            if flat.null_count or len(set(sizes.tolist())) > 1:
                raise ValueError("vectors must be of one length and hold no nulls")
            keys = np.asarray(ids.to_pylist(), str) if pa.types.is_string(ids.type) else ids.to_numpy()
            name, buffer = f"{WRITTEN}{task}-{len(files):04d}.npz", io.BytesIO()
            np.savez(buffer, ids=keys, vectors=flat.to_numpy().reshape(len(sizes), -1))
            with fs.open_output_stream(f"{at}/{name}") as f:
                f.write(buffer.getbuffer())
            files.append(name)

        for b in iterator:
            for i in range(0, b.num_rows, FILE_ROWS):
                piece = b.slice(i, FILE_ROWS)
                if held and sum(x.num_rows for x in held) + piece.num_rows > FILE_ROWS:
                    flush()
                held.append(piece)
                total += piece.num_rows
        if sum(x.num_rows for x in held):
            flush()
        return Written(files, total)

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = _open(self.path)
        fs.create_dir(at, recursive=True)
        # Without a manifest the folder's own arrays count, as they do when it is read.
        before = [f.rsplit("/", 1)[-1] for f in _files(self.path)]
        new = [f for m in messages if m for f in m.files]
        with fs.open_output_stream(f"{at}/{MANIFEST}") as f:
            f.write(json.dumps({"files": new if self.overwrite else before + new}).encode())
        if self.overwrite:
            self._remove(before)

    def abort(self, messages: list[Written | None]) -> None:
        self._remove([f for m in messages if m for f in m.files])

    def _remove(self, names: list[str]) -> None:
        fs, at = _open(self.path)
        for n in names:
            if fs.get_file_info(f"{at}/{n}").type == pafs.FileType.File:
                fs.delete_file(f"{at}/{n}")


class NpySource(DataSource):
    """Reads (file, row or id, vector) of .npy and .npz files, by byte range; writes a table of an id and a vector.

    Options: split, the bytes that a task reads (64 MB). Rows of a bare .npy are numbered from 0 in their file. Files of
    one folder must be of one kind. An empty table is written as a manifest of no files, which needs a schema to be read.
    """

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        found = _pairs(self.options["path"])
        if not found:
            raise ValueError(f"{self.options['path']}: no arrays; give a schema")
        kinds = {(i is None or np.dtype(i.dtype).kind, np.dtype(v.dtype).itemsize > 4) for v, i in found}
        if len({(k if k is True or k == "U" else "i", w) for k, w in kinds}) > 1:
            raise ValueError(f"{self.options['path']}: arrays of several kinds")
        ids, wide = found[0][1], np.dtype(found[0][0].dtype).itemsize > 4
        key = "row bigint" if ids is None else "id string" if np.dtype(ids.dtype).kind == "U" else "id bigint"
        return f"file string, {key}, vector array<{'double' if wide else 'float'}>"

    def reader(self, schema: StructType) -> NpyReader:
        return NpyReader(self.options["path"], int(self.options.get("split", SPLIT)))

    def writer(self, schema: StructType, overwrite: bool) -> NpyWriter:
        kinds = [f.dataType.simpleString() for f in schema.fields]
        if len(kinds) != 2 or kinds[0] not in ("bigint", "int", "string") or kinds[1] not in ("array<float>", "array<double>"):
            raise ValueError("a table of an id (whole number or text) and a vector (array of float or double) can be written")
        return NpyWriter(self.options["path"], [f.name for f in schema.fields], overwrite)


@dataclass
class Group(InputPartition):
    """Row groups of a member, inside archives that lie inside one another."""

    archive: str
    inside: tuple[str, ...]
    groups: tuple[int, ...]


def _find(z: zipfile.ZipFile, member: str, nested: str, archive: str) -> list[tuple[tuple[str, ...], bool]]:
    """Paths to the member, and whether any step of them is compressed. A name found twice is an error; nested archives
    are looked into only where the outer one doesn't have the name."""
    base = lambda n: PurePosixPath(n).name
    hits = [i for i in z.infolist() if base(i.filename) == member]
    if len(hits) > 1:
        raise ValueError(f"{archive}: {member} is there {len(hits)} times")
    if hits:
        return [((hits[0].filename,), hits[0].compress_type != zipfile.ZIP_STORED)]
    inner = [i for i in z.infolist() if nested and base(i.filename) == nested]
    if len(inner) > 1:
        raise ValueError(f"{archive}: {nested} is there {len(inner)} times")
    out = []
    for i in inner:
        with z.open(i) as f, zipfile.ZipFile(f) as y:
            out += [((i.filename, *p), packed or i.compress_type != zipfile.ZIP_STORED) for p, packed in _find(y, member, "", f"{archive}:{nested}")]
    return out


class _Member:
    """The opened member, and what has to be closed after it."""

    def __init__(self, archive: str, inside: tuple[str, ...]):
        fs, at = _open(archive)
        self.open = [fs.open_input_file(at)]
        for name in inside:
            self.open.append(zipfile.ZipFile(self.open[-1]))
            self.open.append(self.open[-1].open(name))

    def __enter__(self):
        return self.open[-1]

    def __exit__(self, *_):
        for f in reversed(self.open):
            f.close()


class ZippedReader(DataSourceReader):
    def __init__(self, path: str, member: str, nested: str, names: list[str]):
        self.path, self.member, self.nested, self.names = path, member, nested, names

    def partitions(self) -> list[Group]:
        inside, packed, table = locate(self.path, self.member, self.nested)
        every = tuple(range(table.num_row_groups))
        # Reaching a row group of a compressed member takes all before it, so one task reads that member once.
        return [Group(self.path, inside, every)] if packed else [Group(self.path, inside, (i,)) for i in every]

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        if partition is None or not partition.groups:
            return
        with _Member(partition.archive, partition.inside) as f:
            yield from pq.ParquetFile(f).iter_batches(BATCH, row_groups=list(partition.groups), columns=self.names)


def locate(path: str, member: str, nested: str) -> tuple[tuple[str, ...], bool, pq.FileMetaData]:
    fs, at = _open(path)
    with fs.open_input_file(at) as f, zipfile.ZipFile(f) as z:
        found = _find(z, member, nested, path)
    if not found:
        raise ValueError(f"{path}: no {member}")
    (inside, packed), = found
    with _Member(path, inside) as f:
        return inside, packed, pq.ParquetFile(f).metadata


class ZippedSource(DataSource):
    """The Parquet table `member` (a base name) of a ZIP archive, or of one archive named by `nested` (dataset.zip) in it.

    Names that are missing or found twice are errors. Row groups are partitions where nothing on the way is compressed.
    """

    @classmethod
    def name(cls) -> str:
        return "zipped"

    def _where(self) -> tuple[str, str, str]:
        return self.options["path"], self.options["member"], self.options.get("nested", "dataset.zip")

    def schema(self) -> StructType:
        return from_arrow_schema(locate(*self._where())[2].schema.to_arrow_schema())

    def reader(self, schema: StructType) -> ZippedReader:
        return ZippedReader(*self._where(), schema.names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpySource)
    spark.dataSource.register(ZippedSource)
