"""Terrain files, decal files and archives as Spark formats: ``register(spark)``, then ``format("terrain")``, ``format("decals")`` and ``format("archive")``.

Readers cut a file into bands of pixels or records, or an archive into its
entries, and a task reads its part alone.  Writers write each file in one task
under a hidden folder and move it to its place when the job commits, so a
failed task or job leaves no file in its place; what a task that is killed late
leaves in the hidden folder, readers pass over.  Paths are local or of a file system that
pyarrow opens (``s3://``, ``hdfs://``, ...); ``files.read_terrain`` and
``files.zip_entries`` read by way of Spark's own readers instead.
"""

from __future__ import annotations

import io
import posixpath
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from geomill.sources.files import HOLE, TERRAIN_VERSION

#: Pixels, or records, of a partition at most unless the option ``part_rows`` says otherwise, and of a batch.
PART_ROWS, BATCH_ROWS = 1 << 22, 1 << 16
#: Version of decal files and the layout of a record.
DECAL_VERSION = 5
DECAL = np.dtype([("name", "u1"), ("position", "<f4", 3), ("normal", "<f4", 3), ("tangent", "<f4", 3), ("rect", "<u4"), ("size", "<f4"), ("priority", "u1")])
#: Code page of archive names that are neither marked nor valid as UTF-8.
OLD_NAMES = "cp850"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _files(path: str, ending: str) -> list[str]:
    """Files under ``path``, or itself, that end in ``ending``; hidden ones are left out."""
    fs, root = _open(path)
    info = fs.get_file_info(root)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True))
    names = sorted(f.path for f in found if f.type == pafs.FileType.File and f.path.lower().endswith(ending))
    return [n for n in names if not any(part.startswith(("_", ".")) for part in n[len(root) :].split("/"))]


@dataclass
class Part(InputPartition):
    """Rows ``low`` to ``high`` of a file, or an entry of an archive; ``names`` by which records are called."""

    file: str
    low: int = 0
    high: int = 0
    entry: str = ""
    name: str = ""


def _string(f) -> str:
    return f.read(f.read(1)[0]).decode("utf-8")


def _names(f) -> list[str]:
    return [_string(f) for _ in range(struct.unpack("<I", f.read(4))[0])]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.path = options, options["path"]
        self.part_rows = int(options.get("part_rows", PART_ROWS))

    def fs(self) -> pafs.FileSystem:
        return _open(self.path)[0]


class _TerrainReader(_Reader):
    def partitions(self) -> list[Part]:
        parts, fs = [], self.fs()
        for file in _files(self.path, ".ter"):
            with fs.open_input_file(file) as f:
                version, size = struct.unpack("<BI", f.read(5))
            if version != TERRAIN_VERSION:
                raise ValueError(f"{file}: terrain version {version}, not {TERRAIN_VERSION}")
            rows = max(1, self.part_rows // max(1, size))
            parts += [Part(file, low, min(size, low + rows)) for low in range(0, size, rows)]
        return parts

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        most = float(self.options.get("max_height", "2048"))
        with self.fs().open_input_file(part.file) as f:
            size = struct.unpack("<BI", f.read(5))[1]
            n, low, many = size * size, part.low * size, (part.high - part.low) * size
            f.seek(5 + 3 * n)
            names = np.array([*_names(f), None], object)
            f.seek(5 + 2 * low)
            raw = np.frombuffer(f.read(2 * many), "<u2")
            f.seek(5 + 2 * n + low)
            material = np.frombuffer(f.read(many), np.uint8)
        for at in range(0, many, BATCH_ROWS):
            i, m = np.arange(at, min(many, at + BATCH_ROWS)), material[at : at + BATCH_ROWS]
            hole = m == HOLE
            name = names[np.where(m < len(names) - 1, m, len(names) - 1)]
            columns = [pa.array([part.file] * len(i)), pa.array((low + i) % size), pa.array((low + i) // size), pa.array(raw[at : at + BATCH_ROWS] / 65535.0 * most), pa.array(np.where(hole, 0, m).astype(np.int64)), pa.array(hole), pa.array(np.where(hole, None, name), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["file", "x", "y", "height", "material", "is_hole", "name"])


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceArrowWriter):
    """Writes the files of a task under a folder of the job's own."""

    ending = ""

    def __init__(self, options: dict, overwrite: bool):
        self.options, self.path, self.overwrite = options, options["path"], overwrite
        self.hidden = f"_writing-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _open(self.path)
        folder, done = f"{root}/{self.hidden}/{uuid.uuid4().hex}", []
        for file, rows in self._by_file(batches):
            name = file if file.lower().endswith(self.ending) else file + self.ending
            if name.startswith("/") or ".." in name.split("/"):
                raise ValueError(f"{file} is no name of a file under the path")
            fs.create_dir(posixpath.dirname(f"{folder}/{name}"))
            with fs.open_output_stream(f"{folder}/{name}") as out:
                self.put(out, file, rows)
            done.append(f"{folder[len(root) + 1:]}/{name}")
        return Written(done)

    def _by_file(self, batches: Iterator[pa.RecordBatch]):
        """(file, batches) of runs of one file; a file may come in one run only."""
        state = {"batch": None, "seen": set()}
        batches = (b for b in batches if b.num_rows)

        def run(file):
            while (b := state["batch"]) is not None:
                names = b.column("file")
                stop = next((i for i in range(b.num_rows) if names[i].as_py() != file), b.num_rows) if names[-1].as_py() != file or names[0].as_py() != file else b.num_rows
                if not stop:
                    return
                state["batch"] = b.slice(stop) if stop < b.num_rows else next(batches, None)
                yield b.slice(0, stop)

        state["batch"] = next(batches, None)
        while state["batch"] is not None:
            file = state["batch"].column("file")[0].as_py()
            if file in state["seen"]:
                raise ValueError(f"the rows of {file} do not follow each other; sort by file")
            state["seen"].add(file)
            rows = run(file)
            yield file, rows
            for _ in rows:  # what the file did not need
                pass

    def commit(self, messages: list[Written]) -> None:
        fs, root = _open(self.path)
        files = [f for m in messages if m for f in m.files]
        names = [f.split("/", 2)[2] for f in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two tasks wrote one file; bring the rows of a file together")
        if self.overwrite and fs.get_file_info(root).type == pafs.FileType.Directory:
            for old in fs.get_file_info(pafs.FileSelector(root, recursive=True)):
                if old.type == pafs.FileType.File and old.path.lower().endswith(self.ending) and f"/{self.hidden}/" not in old.path:
                    fs.delete_file(old.path)
        for file, name in zip(files, names):
            fs.create_dir(posixpath.dirname(f"{root}/{name}"))
            fs.move(f"{root}/{file}", f"{root}/{name}")
        self._clear()

    def abort(self, messages: list[Written]) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, root = _open(self.path)
        if fs.get_file_info(f"{root}/{self.hidden}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.hidden}")


class _TerrainWriter(_Writer):
    ending = ".ter"

    def put(self, out, file: str, rows: Iterator[pa.RecordBatch]) -> None:
        """Rows in the order of y, then x; heights are clamped and cut to 16 bits."""
        most = float(self.options.get("max_height", "2048"))
        heights, materials, places, names, n = [], [], [], {}, 0
        for b in rows:
            x, y = (b.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
            hole = b.column("is_hole").to_numpy(zero_copy_only=False).astype(bool)
            material = np.where(hole, HOLE, b.column("material").to_numpy(zero_copy_only=False)).astype(np.uint8)
            heights.append(np.clip(b.column("height").to_numpy(zero_copy_only=False) / most * 65535, 0, 65535).astype("<u2"))
            materials.append(material)
            if "name" in b.schema.names:
                first = np.unique(material, return_index=True)[1]
                names.update({int(material[i]): b.column("name")[int(i)].as_py() or "" for i in first if material[i] != HOLE and not names.get(int(material[i]))})
            places.append(y * (1 << 32) + x)
            n += b.num_rows
        size = int(round(n**0.5))
        if size * size != n or (np.concatenate(places) != (np.arange(n) // size << 32) + np.arange(n) % size).any():
            raise ValueError(f"{file} has {n} pixels that are no square in the order of y and x")
        out.write(struct.pack("<BI", TERRAIN_VERSION, size))
        for part in (*heights, *materials):
            out.write(part.tobytes())
        many = max(names, default=-1) + 1
        out.write(struct.pack("<I", many))
        for i in range(many):
            name = names.get(i, "").encode()
            out.write(bytes([len(name)]) + name)


class TerrainSource(DataSource):
    """(file, x, y, height, material, is_hole, name) of version 9 terrain files; option ``max_height`` in metres, 2048 unless given."""

    @classmethod
    def name(cls) -> str:
        return "terrain"

    def schema(self) -> str:
        return "file string, x long, y long, height double, material long, is_hole boolean, name string"

    def reader(self, schema) -> DataSourceReader:
        return _TerrainReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _TerrainWriter(dict(self.options), overwrite)


class _DecalReader(_Reader):
    def _head(self, f) -> tuple[list[str], int, int]:
        f.read(4)
        (version,) = f.read(1)
        if version != DECAL_VERSION:
            raise ValueError(f"decal version {version}, not {DECAL_VERSION}")
        names = _names(f)
        return names, struct.unpack("<I", f.read(4))[0], f.tell()

    def partitions(self) -> list[Part]:
        parts, fs = [], self.fs()
        for file in _files(self.path, ".decals"):
            with fs.open_input_file(file) as f:
                many = self._head(f)[1]
            parts += [Part(file, low, min(many, low + self.part_rows)) for low in range(0, many, self.part_rows)]
        return parts

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        with self.fs().open_input_file(part.file) as f:
            names, _, start = self._head(f)
            for low in range(part.low, part.high, BATCH_ROWS):
                many = min(part.high, low + BATCH_ROWS) - low
                f.seek(start + low * DECAL.itemsize)
                rows = np.frombuffer(f.read(many * DECAL.itemsize), DECAL)
                lists = [pa.array(list(rows[c].astype(np.float64)), pa.list_(pa.float64())) for c in ("position", "normal", "tangent")]
                columns = [pa.array([part.file] * many), pa.array(np.arange(low, low + many)), pa.array([names[i] for i in rows["name"]]), pa.array(rows["rect"].astype(np.int64)), pa.array(rows["size"].astype(np.float64)), pa.array(rows["priority"].astype(np.int64)), *lists]
                yield pa.RecordBatch.from_arrays(columns, ["file", "uid", "name", "rect", "size", "priority", "position", "normal", "tangent"])


class DecalSource(DataSource):
    """(file, uid, name, rect, size, priority, position, normal, tangent) of version 5 decal files; ``levels.decal_groups`` groups them."""

    @classmethod
    def name(cls) -> str:
        return "decals"

    def schema(self) -> str:
        return "file string, uid long, name string, rect long, size double, priority long, position array<double>, normal array<double>, tangent array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _DecalReader(dict(self.options))


def entry_name(info: zipfile.ZipInfo) -> str:
    """An entry's name: UTF-8 where it is marked so or valid as such, else of the code page ``OLD_NAMES``."""
    if info.flag_bits & 0x800:
        return info.filename
    raw = info.filename.encode("cp437")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode(OLD_NAMES)


class _ArchiveReader(_Reader):
    def partitions(self) -> list[Part]:
        """A partition for each entry that ends in one of the option ``endings``; only the directories of archives are read here."""
        wanted = tuple(e for e in self.options.get("endings", "").lower().split(",") if e)
        parts, fs = [], self.fs()
        for file in _files(self.path, ".zip"):
            with fs.open_input_file(file) as f, zipfile.ZipFile(f) as z:
                for info in z.infolist():
                    name = entry_name(info)
                    if not info.is_dir() and (not wanted or name.lower().endswith(wanted)):
                        parts.append(Part(file, entry=info.filename, name=name))
        return parts

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        with self.fs().open_input_file(part.file) as f, zipfile.ZipFile(f) as z:
            yield pa.RecordBatch.from_arrays([pa.array([part.file]), pa.array([part.name]), pa.array([z.read(part.entry)], pa.binary())], ["file", "entry", "content"])


class _ArchiveWriter(_Writer):
    ending = ".zip"

    def put(self, out, file: str, rows: Iterator[pa.RecordBatch]) -> None:
        whole = io.BytesIO()
        with zipfile.ZipFile(whole, "w", zipfile.ZIP_DEFLATED) as z:
            for b in rows:
                for entry, content in zip(b.column("entry").to_pylist(), b.column("content").to_pylist()):
                    z.writestr(zipfile.ZipInfo(entry), content or b"", zipfile.ZIP_DEFLATED)
        out.write(whole.getvalue())


class ArchiveSource(DataSource):
    """(file, entry, content) of the files in archives; option ``endings``, comma-separated, reads only entries so named."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return "file string, entry string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _ArchiveReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _ArchiveWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the formats of this module known to the session."""
    for source in (TerrainSource, DecalSource, ArchiveSource):
        spark.dataSource.register(source)


def write_terrain(pixels: DataFrame, path: str, most: float = 2048.0, mode: str = "overwrite") -> None:
    """Terrain files of pixels (file, x, y, height, material, is_hole and, where known, name), one file in one task."""
    register(pixels.sparkSession)
    names = ["name"] if "name" in pixels.columns else []
    own = pixels.select("file", "x", "y", "height", "material", "is_hole", *names)
    own.repartition("file").sortWithinPartitions("file", "y", "x").write.format("terrain").option("max_height", str(most)).mode(mode).save(path)


def write_archives(entries: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Archives of entries (file, entry, content), one archive in one task, entries by name."""
    register(entries.sparkSession)
    entries.select("file", "entry", "content").repartition("file").sortWithinPartitions("file", "entry").write.format("archive").mode(mode).save(path)
