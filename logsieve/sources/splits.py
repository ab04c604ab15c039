"""Parts of log files that tasks read on their own.

A file is planned as ranges of its compressed bytes, by its size alone. The task of a range finds the gzip members
that begin in it: a member's three first bytes may also occur within another, so the first one found is
decompressed to its checksum before it is believed. Lines belong to the range in whose text they begin: a range
passes over what comes before its first line end and goes on, into members of the ranges behind it, to the end of
the line that begins at its own end. Of a Parquet file a range has the row groups that begin in it; a task
reads the footer once, as it grows with the file.

Whether ranges cover a file without a gap shows when each tells where its first member begins and its last one ends
(``Extent``): the end of one has to be the beginning of the next. A file for which that doesn't hold is damaged or
has one member only, and is read unsplit.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

READ_BYTES = 256 << 10
#: Decompressed bytes handed on at a time, and text that is handed on as one block of lines.
PIECE_BYTES, BLOCK_BYTES = 1 << 20, 1 << 20
BATCH_ROWS = 2000
_SIGNATURE = b"\x1f\x8b\x08"
#: A member cut off by the file's end is believed if so much of it could be decompressed.
_BELIEVED = 1 << 10


@dataclass(frozen=True)
class Part:
    """A range of a file's bytes; a whole file is one part."""

    file_id: int
    path: str
    size: int
    number: int = 0
    start: int = 0
    stop: int = 1 << 62


@dataclass
class Extent:
    """Where the members of a part begin and end, and how many records it holds."""

    begin: int = -1
    end: int = -1
    records: int = 0


def parts_of(file_id: int, path: str, size: int, split_bytes: int) -> list[Part]:
    """The file as parts of ``split_bytes``; one part if it isn't larger than that, or 0 is given."""
    if not split_bytes or size <= split_bytes:
        return [Part(file_id, path, size)]
    n = -(-size // split_bytes)
    return [Part(file_id, path, size, k, k * split_bytes, (k + 1) * split_bytes if k < n - 1 else 1 << 62) for k in range(n)]


def packed(parts: list[Part], most_bytes: int, open_bytes: int = 1 << 20) -> list[list[Part]]:
    """Parts in tasks of ``most_bytes`` or so; opening a file counts as ``open_bytes``, once for its parts in a row."""
    out: list[list[Part]] = []
    held = most_bytes
    for p in parts:
        own = min(p.stop, p.size) - p.start
        cost = own if out and out[-1][-1].path == p.path else open_bytes + own
        if held + cost > most_bytes:
            out.append([])
            held, cost = 0, open_bytes + own
        out[-1].append(p)
        held += cost
    return out


def verified(extents: list[tuple[Part, Extent]]) -> bool:
    """Whether the parts of one file, in order, have its members without gap or overlap."""
    expected = 0
    for part, found in extents:
        if found.begin >= 0:
            if found.begin != expected:
                return False
            expected = found.end
        elif expected < min(part.stop, part.size):
            return False
    return expected >= extents[-1][0].size


# gzip ------------------------------------------------------------------------------------------------


def _signatures(file: BinaryIO, start: int, stop: int) -> Iterator[int]:
    """Places in [start, stop) where a member may begin."""
    at, held = start, b""
    while at - len(held) < stop:
        file.seek(at)  # whoever takes a place reads elsewhere
        data = file.read(READ_BYTES)
        if not data:
            return
        base, data, at = at - len(held), held + data, at + len(data)
        found = -1
        while (found := data.find(_SIGNATURE, found + 1)) >= 0 and found + 3 < len(data):
            if base + found >= stop:
                return
            if data[found + 3] < 32:  # the upper bits of its flags are reserved
                yield base + found
        held = data[-3:]


def _whole_member(file: BinaryIO, at: int) -> bool:
    """Whether a member begins there: its checksum fits, or only the file's end cuts it off."""
    file.seek(at)
    unzip, made = zlib.decompressobj(31), 0
    try:
        while data := file.read(READ_BYTES):
            while data:
                made += len(unzip.decompress(data, PIECE_BYTES))
                if unzip.eof:
                    return True
                data = unzip.unconsumed_tail
    except zlib.error:
        return False
    return made >= _BELIEVED


def first_member(file: BinaryIO, part: Part) -> int:
    """Where the first member of the part begins, or -1."""
    return 0 if part.start == 0 else next((at for at in _signatures(file, part.start, min(part.stop, part.size)) if _whole_member(file, at)), -1)


def _sound(unzip, chunk: bytes) -> bytes:
    """What of a chunk can be decompressed before the damage in it."""
    out = []
    try:
        for at in range(len(chunk)):
            out.append(unzip.decompress(chunk[at : at + 1]))
    except zlib.error:
        pass
    return b"".join(out)


def member_pieces(file: BinaryIO, begin: int, stop: int, extent: Extent) -> Iterator[tuple[bytes, bool]]:
    """(decompressed piece, whether its member begins at ``stop`` or later) from the member at ``begin`` on.

    ``extent.end`` becomes the end of the last member that begins before ``stop``. Raises zlib.error or EOFError where the stream is damaged.
    """
    file.seek(begin)
    unzip, late, read = None, False, begin
    while chunk := file.read(READ_BYTES):
        read += len(chunk)
        while chunk:
            if unzip is None:
                if not chunk.strip(b"\0"):
                    break  # padding
                late = read - len(chunk) >= stop
                unzip = zlib.decompressobj(31)
            before = unzip.copy()
            try:
                data = unzip.decompress(chunk, PIECE_BYTES)
            except zlib.error:
                yield _sound(before, chunk), late
                raise
            ended = unzip.eof
            chunk = unzip.unused_data if ended else unzip.unconsumed_tail
            if ended:
                unzip = None
                if not late:
                    extent.end = read - len(chunk)
            if data:
                yield data, late
    if unzip is not None:
        raise EOFError("the compressed stream ends too early")


def _texts(data: bytes) -> list[str]:
    return [x for line in data.decode("utf-8", "replace").split("\n") if (x := line.rstrip("\r"))]


def line_blocks(file: BinaryIO, part: Part, extent: Extent | None = None) -> Iterator[list[str]]:
    """The lines of a part in blocks, without empty ones and without their ends.

    What was read before damage comes out before the error. Time and memory are in proportion to the longest line.
    """
    extent = extent if extent is not None else Extent()
    extent.begin = begin = first_member(file, part)
    if begin < 0:
        return
    held: list[bytes] = []  # of the lines not handed on yet; only the last one is open
    size, skipping = 0, begin > 0
    pieces = member_pieces(file, begin, part.stop, extent)
    while True:
        try:
            data, late = next(pieces)
        except StopIteration:
            break
        except (zlib.error, EOFError):
            if not skipping and (block := _texts(b"".join(held).rpartition(b"\n")[0])):
                yield block
            raise
        if late:
            if skipping:
                return
            cut = data.find(b"\n")
            held.append(data if cut < 0 else data[:cut])
            if cut >= 0:
                break
            continue
        if skipping:
            if (cut := data.find(b"\n")) < 0:
                continue
            skipping, data = False, data[cut + 1 :]
        if size + len(data) >= BLOCK_BYTES and (cut := data.rfind(b"\n")) >= 0:
            if block := _texts(b"".join([*held, data[:cut]])):
                yield block
            held, size, data = [], 0, data[cut + 1 :]
        held.append(data)
        size += len(data)
    if not skipping and held and (block := _texts(b"".join(held))):
        yield block


def text_pieces(file: BinaryIO) -> Iterator[str]:
    """The text of all members of a file, as far as it can be decompressed."""
    import codecs

    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    for data, _ in member_pieces(file, 0, 1 << 62, Extent()):
        if text := decoder.decode(data):
            yield text


# Parquet ---------------------------------------------------------------------------------------------


class Footer:
    """What the footer of a Parquet file tells: where its row groups begin, and how many rows they have."""

    def __init__(self, file: BinaryIO):
        import pyarrow.parquet as pq

        self.metadata = pq.read_metadata(file)
        self.rows: list[int] = []
        begins = []
        for k in range(self.metadata.num_row_groups):
            group = self.metadata.row_group(k)
            column = group.column(0)
            begins.append((column.dictionary_page_offset if column.has_dictionary_page else column.data_page_offset, k))
            self.rows.append(group.num_rows)
        self.order = sorted(begins)

    def groups(self, part: Part) -> list[int]:
        """The row groups that begin in the part."""
        first, last = (bisect_left(self.order, (at, -1)) for at in (part.start, part.stop))
        return sorted(k for _, k in self.order[first:last])


class Footers:
    """The footer of the file that a task reads parts of: the last one is kept, so parts of a file in a row share it."""

    def __init__(self) -> None:
        self.path: str | None = None
        self.footer: Footer | None = None

    def of(self, file: BinaryIO, path: str) -> Footer:
        if self.footer is None or self.path != path:
            self.path, self.footer = path, Footer(file)
        return self.footer


def parquet_blocks(file: BinaryIO, part: Part, footers: Footers | None = None, parsed: bool = False) -> Iterator[list]:
    """Rows of the part's row groups as JSON lines; with ``parsed`` as records, where JSON would give back the same."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    footer = (footers or Footers()).of(file, part.path)
    if not (groups := footer.groups(part)):
        return
    table = pq.ParquetFile(file, metadata=footer.metadata)
    names, kinds = table.schema_arrow.names, table.schema_arrow.types
    texts = [pa.types.is_string(k) or pa.types.is_large_string(k) for k in kinds]
    parsed = parsed and all(text or pa.types.is_integer(k) or pa.types.is_boolean(k) or pa.types.is_null(k) for text, k in zip(texts, kinds, strict=True))
    for batch in table.iter_batches(BATCH_ROWS, row_groups=groups):
        columns = [c.to_numpy(zero_copy_only=False).tolist() if text else c.to_pylist() for c, text in zip(batch.columns, texts, strict=True)]
        rows = [dict(zip(names, values, strict=True)) for values in zip(*columns, strict=True)]
        yield rows if parsed else [json.dumps(row, default=str, separators=(",", ":"), ensure_ascii=False) for row in rows]


def extent_of(file: BinaryIO, part: Part, parquet: bool, footers: Footers | None = None) -> Extent:
    """Counts the lines of a part without looking into them; of Parquet the footer tells."""
    found = Extent()
    if parquet:
        footer = (footers or Footers()).of(file, part.path)
        found.records = sum(footer.rows[k] for k in footer.groups(part))
        found.begin, found.end = part.start, min(part.stop, part.size)
        return found
    for block in line_blocks(file, part, found):
        found.records += len(block)
    return found
