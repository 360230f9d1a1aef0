"""A data source of document files: partitions by size, types by the first bytes, whole files only to parse them.

``spark.read.format("document_files")`` lists a folder once (names and sizes) and packs the files into partitions of about
``partitionBytes``; a larger file is a partition of its own.  Each file is opened where its partition runs.  Its type
comes from its first ``HEAD_BYTES``; of a zip file the directory is read besides, not the file.  Only files that have a
parser, and are to be parsed, are read whole, one at a time.

Options: ``path``; ``blocks`` (default true): a row per block, else one per file, without reading whole files.  Files
that are broken, empty, unknown or gone by the time they are opened are one row of kind 'error'; others are not touched.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docloom.operators import chunking as ck
from docloom.operators import structure as st
from docloom.sources import files as fl

HEAD_BYTES = 8192
PARTITION_BYTES = 64 << 20
#: What opening a file costs, in bytes of reading.
OPEN_BYTES = 1 << 20
FILE = "path string, size long, file_type string"
BLOCK = f"{FILE}, pos int, kind string, level int, text string, rows array<array<string>>, page int"
_BY_NAME = {"pdf": "pdf", "docx": "docx", "doc": "doc", "html": "html", "htm": "html", "txt": "txt", "md": "txt"}


def type_of(name: str, head: bytes, source) -> str | None:
    """By first bytes, then by extension; ``source`` is the open file, of which a zip's directory may be read."""
    if head.startswith(b"%PDF"):
        return "pdf"
    if head.startswith(b"PK\x03\x04"):
        try:
            return "docx" if "word/document.xml" in zipfile.ZipFile(source).namelist() else None
        except (zipfile.BadZipFile, OSError, ValueError):
            return None
    if head.startswith(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"):
        return "doc"
    kind = _BY_NAME.get(name.rpartition(".")[2].lower()) if "." in name else None
    return None if kind == "txt" and not _is_text(head) else kind


def _is_text(head: bytes) -> bool:
    if b"\0" in head:
        return False
    try:
        head.decode("utf-8")
    except UnicodeDecodeError as e:
        return len(head) >= HEAD_BYTES and e.start >= len(head) - 3  # a character cut off at the end of the head
    return True


@dataclass
class _Part(InputPartition):
    files: list[tuple[str, int]]


def packed(files: list[tuple[str, int]], most: int) -> list[list[tuple[str, int]]]:
    """Files in parts of about ``most`` bytes, largest first, so that the last parts to start are small."""
    parts: list[list[tuple[str, int]]] = []
    size = most + 1
    for name, n in sorted(files, key=lambda f: (-f[1], f[0])):
        if size + n + OPEN_BYTES > most or not parts:
            parts.append([])
            size = 0
        parts[-1].append((name, n))
        size += n + OPEN_BYTES
    return parts


class DocumentFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "document_files"

    def _blocks(self) -> bool:
        return self.options.get("blocks", "true").lower() == "true"

    def schema(self) -> str:
        return BLOCK if self._blocks() else FILE

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self._blocks(), int(self.options.get("partitionbytes", PARTITION_BYTES)))


class _Reader(DataSourceReader):
    def __init__(self, path: str, blocks: bool, most: int):
        self.path, self.blocks, self.most = path, blocks, most

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        return [_Part(p) for p in packed([(f.path, f.size) for f in found if f.is_file and not f.base_name.startswith((".", "_"))], self.most)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.path)
        for name, size in partition.files:
            kind, raw, lost = None, None, None
            try:
                with system.open_input_file(name) as source:
                    head = source.read(HEAD_BYTES)
                    kind = type_of(name, head, source)
                    if self.blocks and kind in fl.PARSERS:
                        source.seek(0)
                        raw = source.read()
            except OSError as e:
                lost = [("error", None, f"{type(e).__name__}: {e}", None)]
            if not self.blocks:
                yield name, size, kind
                continue
            for pos, (what, level, text, rows) in enumerate(lost or fl.blocks_of(kind, raw)):
                yield name, size, kind, pos, what, level, text, rows, 0


def read_documents(spark: SparkSession, path: str, blocks: bool = True, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    spark.dataSource.register(DocumentFiles)
    return spark.read.format("document_files").option("blocks", str(blocks).lower()).option("partitionBytes", partition_bytes).load(path)


def files_to_chunks(spark: SparkSession, path: str, max_chars: int = ck.MAX_CHARS, overlap: int = ck.OVERLAP) -> tuple[DataFrame, DataFrame]:
    """(chunks, errors) of all files of a folder: blocks, the sections they belong to, and their chunks by path."""
    blocks = read_documents(spark, path)
    errors = blocks.filter("kind = 'error'").select("path", "file_type", F.col("text").alias("error"))
    good = blocks.filter("kind <> 'error'").withColumn("document_id", F.col("path"))
    chunks = ck.document_chunks(st.assign_sections(good), max_chars, overlap)
    return chunks.withColumnRenamed("document_id", "path"), errors


def put_files(rows: DataFrame, folder: str) -> int:
    """Write rows(name, content) as files into a folder that all executors share; how many.

    A task that is run again writes the same files again.
    """

    def put(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_output_stream(f"{root}/{name}") as out:
                    out.write(io.BytesIO(content or b"").getbuffer())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return rows.select("name", F.col("content").cast("binary")).mapInArrow(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
