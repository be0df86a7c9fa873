"""What Parquet files say about themselves: footer statistics per column chunk and complete dictionaries.

Footers give exact null counts and, where written, exact extrema (which leave out NaN). A dictionary lists every distinct value
of a chunk when all its data pages are dictionary-encoded; the footer's counts of pages by encoding say whether they are, or where a
writer left these out, the page headers, a few bytes per page, without reading the data. Files are read where the tasks run, one
file per row of a DataFrame of paths.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the Parquet format: page types and encodings.
DATA_PAGE, DICTIONARY_PAGE, DATA_PAGE_V2 = 0, 2, 3
DICTIONARY_ENCODINGS = (2, 8)
HEADER_BYTES = 4096

CHUNK_SCHEMA = "path string, row_group int, rows bigint, key_low string, key_high string, key_nulls bigint, column_name string, nulls bigint, low string, high string, entries array<string>"


class _Compact:
    """Reads structures of Thrift's compact protocol into {field id: value}."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def varint(self) -> int:
        value = shift = 0
        while True:
            byte = self.data[self.at]
            self.at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    def zigzag(self) -> int:
        n = self.varint()
        return (n >> 1) ^ -(n & 1)

    def value(self, kind: int):
        if kind in (1, 2):
            return kind == 1
        if kind == 3:
            self.at += 1
            return self.data[self.at - 1]
        if kind in (4, 5, 6):
            return self.zigzag()
        if kind == 7:
            self.at += 8
            return None
        if kind == 8:
            size = self.varint()
            self.at += size
            return None
        if kind in (9, 10):
            head = self.data[self.at]
            self.at += 1
            size = head >> 4 if head >> 4 != 15 else self.varint()
            return [self.value(head & 15) for _ in range(size)]
        if kind == 12:
            return self.struct()
        raise ValueError(f"compact type {kind}")

    def struct(self) -> dict:
        out, field = {}, 0
        while True:
            head = self.data[self.at]
            self.at += 1
            if head == 0:
                return out
            field = field + (head >> 4) if head >> 4 else self.zigzag()
            out[field] = self.value(head & 15)


def page_encodings(source, size: int) -> list[list[list[tuple[int, int]] | None]]:
    """Per row group and column chunk of the footer: (page type, encoding) of its pages, or None where the writer does not say."""
    length = int.from_bytes(source.read_at(8, size - 8)[:4], "little")
    try:
        footer = _Compact(source.read_at(length, size - 8 - length)).struct()
        # Fields of the format: 4 row groups, 1 columns, 3 metadata, 13 encoding statistics (1 page type, 2 encoding).
        return [[[(e[1], e[2]) for e in c[3][13]] if 13 in c.get(3, {}) else None for c in g[1]] for g in footer[4]]
    except (IndexError, KeyError, ValueError):
        return []


def _dictionary(source, column, physical: str, pages: list[tuple[int, int]] | None = None) -> list[str] | None:
    """The distinct values of a chunk as strings, or None where its dictionary is missing or doesn't cover it."""
    import pyarrow as pa

    if not column.has_dictionary_page:
        return None
    if pages is not None and any(kind != DICTIONARY_PAGE and encoding not in DICTIONARY_ENCODINGS for kind, encoding in pages):
        return None
    at = column.dictionary_page_offset if column.dictionary_page_offset is not None else column.data_page_offset
    end, entries, seen = at + column.total_compressed_size, None, 0
    while at < end and seen < column.num_values:
        reader = _Compact(source.read_at(min(HEADER_BYTES, end - at), at))
        try:
            header = reader.struct()
        except IndexError:  # a header longer than HEADER_BYTES: its statistics hold long values
            reader = _Compact(source.read_at(end - at, at))
            header = reader.struct()
        body, kind = at + reader.at, header[1]
        if kind == DICTIONARY_PAGE:
            page = source.read_at(header[3], body)
            if column.compression != "UNCOMPRESSED":
                page = pa.decompress(page, decompressed_size=header[2], codec=column.compression.lower(), asbytes=True)
            entries = _plain(page, header[7][1], physical)
            if pages is not None:
                return entries
        elif kind in (DATA_PAGE, DATA_PAGE_V2):
            page = header[5] if kind == DATA_PAGE else header[8]
            seen += page[1]
            if page[2 if kind == DATA_PAGE else 4] not in DICTIONARY_ENCODINGS:
                return None
        at = body + header[3]
    return entries


def _plain(page: bytes, count: int, physical: str) -> list[str]:
    """Values of a page in plain encoding."""
    if physical == "BYTE_ARRAY":
        out, at = [], 0
        for _ in range(count):
            size = int.from_bytes(page[at : at + 4], "little")
            out.append(page[at + 4 : at + 4 + size].decode("utf-8", "replace"))
            at += 4 + size
        return out
    code = {"DOUBLE": "d", "FLOAT": "f", "INT32": "i", "INT64": "q"}[physical]
    return [str(v) for v in struct.unpack(f"<{count}{code}", page[: count * struct.calcsize(code)])]


def chunk_facts(spark: SparkSession, files: list[str], key: str, columns: list[str], dictionaries: list[str]) -> DataFrame:
    """One row per file, row group and column: rows, extrema of the key, exact nulls, extrema, and where complete the dictionary.

    nulls, low and high are null where the footer does not give them. Extrema are written as strings; for strings they are left
    out, as writers may cut them. A column that a file lacks is all null there. dictionaries: the columns whose dictionaries are
    decoded, in row groups that hold one key only.
    """

    def facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as fs
        import pyarrow.parquet as pq

        for pdf in batches:
            for path in pdf["path"]:
                url = urlparse(path)
                system, inside = (fs.LocalFileSystem(), unquote(url.path)) if url.scheme in ("", "file") else fs.FileSystem.from_uri(path)
                rows = []
                with system.open_input_file(inside) as source:
                    meta = pq.ParquetFile(source).metadata
                    encodings = page_encodings(source, source.size()) if dictionaries else []
                    for g in range(meta.num_row_groups):
                        group = meta.row_group(g)
                        order = {group.column(i).path_in_schema: i for i in range(group.num_columns)}
                        chunks = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
                        known = chunks[key].statistics if key in chunks else None
                        bounds = (str(known.min), str(known.max)) if known is not None and known.has_min_max else (None, None)
                        key_nulls = known.null_count if known is not None and known.has_null_count else None
                        for name in columns:
                            chunk = chunks.get(name)
                            if chunk is None:
                                rows.append((path, g, group.num_rows, *bounds, key_nulls, name, group.num_rows, None, None, []))
                                continue
                            stats = chunk.statistics
                            nulls = stats.null_count if stats is not None and stats.has_null_count else None
                            has = stats is not None and stats.has_min_max and chunk.physical_type != "BYTE_ARRAY"
                            pages = encodings[g][order[name]] if g < len(encodings) else None
                            one = not key_nulls and bounds[0] is not None and bounds[0] == bounds[1]
                            entries = _dictionary(source, chunk, chunk.physical_type, pages) if one and name in dictionaries else None
                            rows.append((path, g, group.num_rows, *bounds, key_nulls, name, nulls, str(stats.min) if has else None, str(stats.max) if has else None, entries))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHUNK_SCHEMA.split(", ")])

    if not files:
        return spark.createDataFrame([], CHUNK_SCHEMA)
    paths = spark.createDataFrame(pd.DataFrame({"path": sorted(files)}), "path string")
    tasks = min(len(files), 4 * spark.sparkContext.defaultParallelism)
    return paths.repartition(max(1, tasks), F.xxhash64("path")).mapInPandas(facts, CHUNK_SCHEMA)

