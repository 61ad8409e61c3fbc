"""FASTQ as a Spark data source, four lines a record, read as a stream.

Plain files are cut into ranges of ``SPLIT`` bytes, a partition each; a record belongs to the range that its first byte lies
in. A range finds its first record by the shape of the lines: quality lines may begin with ``@`` too, but no sequence, which
then stands two lines below, begins with ``+``. Compressed files stay whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Records of a batch.
BATCH = 4096


#: Bytes of a range.
SPLIT = 64 << 20
#: Names of files that are compressed as a whole.
WHOLE = (".gz", ".bz2", ".zst", ".lz4", ".br")
SCHEMA = ["file", "range", "seq_idx", "header", "sequence"]


class FastqRange(InputPartition):
    """Bytes of a file, by its URI or absolute path; without an end, all of it."""

    def __init__(self, uri: str, start: int = 0, end: int | None = None) -> None:
        super().__init__(uri)
        self.uri, self.start, self.end = uri, start, end


def files_of(path: str) -> list[str]:
    """The file at a path, or the files right below a folder, without those whose names hide them."""
    store, at = fs.FileSystem.from_uri(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    return sorted(f"{path.rstrip('/')}/{x.base_name}" for x in store.get_file_info(fs.FileSelector(at)) if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")))


def ranges_of(paths: list[str], split: int = SPLIT) -> list[FastqRange]:
    """The ranges of all files of paths."""
    out = []
    for uri in (uri for path in paths for uri in files_of(path)):
        store, at = fs.FileSystem.from_uri(uri)
        size = 0 if uri.endswith(WHOLE) else store.get_file_info(at).size or 0
        out += [FastqRange(uri)] if size <= split else [FastqRange(uri, a, min(a + split, size)) for a in range(0, size, split)]
    return out


def lines_of(stream: pa.NativeFile, at: int = 0, size: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """The lines of a stream without their ends, each with its place; ``at``: that of the first."""
    rest = b""
    while data := stream.read(size):
        *whole, rest = (rest + data).split(b"\n")
        for line in whole:
            yield at, line
            at += len(line) + 1
    if rest:
        yield at, rest


def begins_record(lot: list[tuple[int, bytes]], i: int) -> bool:
    """Whether a record begins at line ``i`` of some lines."""
    text = [x.rstrip() for _, x in lot[i : i + 4]]
    return len(text) == 4 and text[0].startswith(b"@") and text[2].startswith(b"+") and len(text[1]) == len(text[3])


def lines_from_record(stream: pa.NativeFile, start: int, uri: str) -> Iterator[tuple[int, bytes]]:
    """Lines from the beginning of a record on, the first one at ``start`` or behind it if that can be told there.

    Near the end of a file the lines left may be too few to tell; then from a record further ahead.
    """
    back = 1  # with the byte before, so that a line that begins at the start is whole
    while True:
        at = max(start - back, 0)
        stream.seek(at)
        lines = lines_of(stream, at)
        if not at:
            return lines
        ahead = list(itertools.islice(lines, 8))  # the rest of a line, then lines of two records at most
        first = next((i for i in range(1, min(len(ahead), 5)) if begins_record(ahead, i)), None)
        if first is not None:
            return itertools.chain(ahead[first:], lines)
        if len(ahead) == 8:
            raise ValueError(f"incomplete FASTQ record after byte {at} of {uri}")
        back = max(4096, 16 * back)


def records(lines: Iterator[tuple[int, bytes]], of: FastqRange) -> Iterator[tuple[str, str]]:
    """(header, sequence) of the records that begin in a range; an empty line at the end is none."""
    while lot := list(itertools.islice(lines, 4)):
        if lot[0][0] < of.start:
            continue
        if of.end is not None and lot[0][0] >= of.end:
            return
        text = [x.rstrip() for _, x in lot]
        if len(lot) < 4 or (of.end is not None and not text[0].startswith(b"@")):
            if b"".join(text):
                raise ValueError(f"incomplete FASTQ record in {of.uri}")
            return
        yield text[0].decode("utf-8", "replace").removeprefix("@"), text[1].decode("utf-8", "replace")


class FastqReader(DataSourceReader):
    """Reads files of the option ``paths`` (one a line), compressed ones by their name."""

    def __init__(self, paths: list[str], split: int) -> None:
        self.paths, self.split = paths, split

    def partitions(self) -> list[InputPartition]:
        """One for each range."""
        return ranges_of(self.paths, self.split) or [FastqRange("")]

    def read(self, partition: FastqRange) -> Iterator[pa.RecordBatch]:
        """Batches of a range's records, numbered from 0 in it."""
        if not partition.uri:
            return
        store, at = fs.FileSystem.from_uri(partition.uri)
        number = 0
        with store.open_input_stream(at, compression="detect") if partition.end is None else store.open_input_file(at) as stream:
            lines = lines_from_record(stream, partition.start, partition.uri) if partition.start else lines_of(stream)
            found = records(lines, partition)
            while lot := list(itertools.islice(found, BATCH)):
                headers, sequences = zip(*lot, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([partition.uri] * len(lot)), pa.array([partition.start] * len(lot), pa.int64()), pa.array(range(number, number + len(lot)), pa.int64()), pa.array(headers), pa.array(sequences)], SCHEMA)
                number += len(lot)


class FastqSource(DataSource):
    """``spark.read.format("fastq").option("paths", ...)``: file, range (its first byte), seq_idx (in the range), header, sequence."""

    @classmethod
    def name(cls) -> str:
        """Its format."""
        return "fastq"

    def schema(self) -> str:
        """Columns of a record."""
        return "file string, range bigint, seq_idx bigint, header string, sequence string"

    def reader(self, schema) -> DataSourceReader:
        """The reader of the paths."""
        return FastqReader([p for p in self.options["paths"].split("\n") if p], int(self.options.get("splitBytes", SPLIT)))
