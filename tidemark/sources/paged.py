"""A source of stored pages: one partition a window, each walked along its pages to the end, a cutoff or a guard."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "window string, page int, place int, date string, item string, complete boolean"


@dataclass
class Window(InputPartition):
    name: str


class Walk(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.windows = options["root"].rstrip("/"), [w for w in options["windows"].split(",") if w]
        self.items, self.dates = options.get("items", "items"), options.get("date", "date")
        self.guard, self.cutoff, self.size = int(options.get("guard", 60)), options.get("cutoff", ""), int(options.get("size", 0))

    def partitions(self) -> list[Window]:
        return [Window(w) for w in self.windows]

    def read(self, partition: Window) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(self.root)
        at, page, complete = f"{partition.name}/1.json", 0, False
        while at and page < self.guard:
            try:
                with fs.open_input_stream(f"{root}/{at}") as f:
                    body = json.loads(f.read())
            except (FileNotFoundError, ValueError):
                # numbered pages end where there is none; a link that leads nowhere is broken
                complete = bool(self.size) and page > 0
                break
            page += 1
            found = body.get(self.items) or []
            dates = [str(x.get(self.dates) or "")[:10] for x in found]
            wanted = [i for i, d in enumerate(dates) if not (self.cutoff and d and d < self.cutoff)]
            yield self._rows(partition.name, page, wanted, [dates[i] for i in wanted], [json.dumps(found[i]) for i in wanted])
            if self.size:
                at, complete = (f"{partition.name}/{page + 1}.json", False) if len(found) == self.size else ("", True)
            else:
                at = (body.get("links") or {}).get("next") or ""
                complete = not at
            if len(wanted) < len(found) or not found:
                at, complete = "", True
        # what the walk says of itself; at the guard it is not complete
        yield pa.RecordBatch.from_pydict({"window": [partition.name], "page": [page], "place": [-1], "date": [None], "item": [None], "complete": [complete]}, schema=self._schema())

    def _schema(self) -> pa.Schema:
        return pa.schema([("window", pa.string()), ("page", pa.int32()), ("place", pa.int32()), ("date", pa.string()), ("item", pa.string()), ("complete", pa.bool_())])

    def _rows(self, window: str, page: int, place: list[int], dates: list[str], items: list[str]) -> pa.RecordBatch:
        n = len(items)
        return pa.RecordBatch.from_pydict({"window": [window] * n, "page": [page] * n, "place": place, "date": dates, "item": items, "complete": [None] * n}, schema=self._schema())


class StoredPages(DataSource):
    """Options: root, windows (names, by commas), items and date (names in a page's JSON), guard (most pages), cutoff (a date), and size for numbered pages."""

    @classmethod
    def name(cls) -> str:
        return "stored_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Walk:
        return Walk(dict(self.options))


def walked(spark: SparkSession, root: str, windows: list[str], schema: str, **options) -> tuple[DataFrame, DataFrame]:
    """(items, status) of stored pages below root/window/1.json and on.

    A page states its items and, in links.next, the path of the next one; with ``size`` pages are numbered, and one
    with fewer items, or a missing one after the first, is the last. Items before ``cutoff`` are left out, and
    the walk ends with the page that has the first of them. items: (window, page, place, item by ``schema``); status: (window, pages, complete), a
    row for each window, also for one without pages. A walk that stops at a broken link or at ``guard`` pages is not complete.
    """
    spark.dataSource.register(StoredPages)
    rows = spark.read.format("stored_pages").options(root=root, windows=",".join(windows), **options).load()
    items = rows.where("place >= 0").select("window", "page", "place", F.from_json("item", schema).alias("item"))
    return items, rows.where("place < 0").select("window", F.col("page").alias("pages"), "complete")


def write_files(files: DataFrame, path: str) -> None:
    """Writes (name, content) as files below ``path``, from the tasks that hold the rows; a task that runs again writes the same files."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                fs.create_dir(f"{root}/{name}".rpartition("/")[0], recursive=True)
                with fs.open_output_stream(f"{root}/{name}") as f:
                    f.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    files.select("name", "content").mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()
