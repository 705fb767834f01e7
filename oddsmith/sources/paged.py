"""A data source of stored pages: numbered folders, read by pages in parallel, or as a stream that goes on after the last page seen."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "page long, page_id long, url string, html string"


def _listed(path: str) -> list[int]:
    """Numbers of the pages under a path, in order: folders named page=N with a finished file."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    if store.get_file_info(base).type != fs.FileType.Directory:
        return []
    names = [x.base_name for x in store.get_file_info(fs.FileSelector(base)) if x.type == fs.FileType.Directory]
    return sorted(int(n[5:]) for n in names if n.startswith("page=") and n[5:].isdigit())


def _read(path: str, page: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of one page, file by file; columns that a file lacks are null."""
    from pyarrow import fs, json

    store, base = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    for x in sorted(store.get_file_info(fs.FileSelector(f"{base}/page={page}")), key=lambda x: x.path):
        if x.type != fs.FileType.File or not x.base_name.endswith(".json") or x.base_name.startswith(("_", ".")) or not x.size:
            continue
        own = pa.schema([f for f in schema if f.name != "page"])
        with store.open_input_stream(x.path) as f:
            table = json.read_json(f, json.ReadOptions(block_size=max(1 << 20, x.size + 1)), json.ParseOptions(explicit_schema=own, unexpected_field_behavior="ignore"))
        table = table.add_column(0, "page", pa.array([page] * len(table), pa.int64()))
        yield from table.select(schema.names).cast(schema).to_batches(max_chunksize=1000)


class Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


def _arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


class PagesReader(DataSourceReader):
    def __init__(self, path: str, schema):
        self.path, self.schema = path, _arrow(schema)

    def partitions(self):
        return [Page(n) for n in _listed(self.path)] or [Page(-1)]

    def read(self, partition):
        return iter(()) if partition.number < 0 else _read(self.path, partition.number, self.schema)


class PagesStream(DataSourceStreamReader):
    """Offsets are page numbers: a batch holds the pages after the last one of the batch before. Pages must come in the order of their numbers."""

    def __init__(self, path: str, schema):
        self.path, self.schema = path, _arrow(schema)

    def initialOffset(self) -> dict:
        return {"page": -1}

    def latestOffset(self) -> dict:
        pages = _listed(self.path)
        return {"page": pages[-1] if pages else -1}

    def partitions(self, start: dict, end: dict):
        return [Page(n) for n in _listed(self.path) if start["page"] < n <= end["page"]]

    def read(self, partition):
        return _read(self.path, partition.number, self.schema)


class StoredPages(DataSource):
    """Option `path`: where page=0, page=1, ... lie, each with JSON lines, as write.partitionBy("page").json() leaves them."""

    @classmethod
    def name(cls) -> str:
        return "stored_pages"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return PagesReader(self.options["path"], schema)

    def streamReader(self, schema):
        return PagesStream(self.options["path"], schema)


def register(spark: SparkSession) -> str:
    """Makes the source known to a session; its name."""
    spark.dataSource.register(StoredPages)
    return StoredPages.name()
