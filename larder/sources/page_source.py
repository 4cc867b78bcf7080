"""The paginated source as a Spark data source: executors ask for pages. Up to SPREAD pages each is a partition of its own; of more, a
partition is a run of pages, RUN at most, so that a long window doesn't cost a task, and a file behind it, for every page.

`register(spark)` makes it known as format "pages". Options: url; transport, "module:function" of a `pages.Transport` that
executors can import; run_id; records_per_page; tries; and, for a batch, first and pages, the window. Busy answers are tried again
as `pages.ask` does; a page beyond the end of the data gives no row.

As a stream its offset is the next page: what the source reports as its number of products says how many pages there are, a batch is
`pages` of them at most, and the query's checkpoint is the resume state: a page that is in a finished batch isn't asked for
again, and a batch that failed asks for the same window.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from datetime import datetime, timezone
from importlib import import_module
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from larder.sources.pages import Response, Transport, ask
from larder.sources.schemas import EXTRA_FIELDS, PAGE, PRODUCT_FIELDS

FORMAT = "pages"

#: Partitions that a window is spread over before they get more than a page, and pages that a partition has at most.
SPREAD, RUN = 64, 100


class Pages(InputPartition):
    """Pages from first to before end."""

    def __init__(self, first: int, end: int) -> None:
        super().__init__((first, end))
        self.first, self.end = first, end


def runs(first: int, end: int) -> list[Pages]:
    """The window's pages in even runs."""
    size = max(1, min(RUN, (end - first) // SPREAD))
    return [Pages(p, min(p + size, end)) for p in range(first, end, size)]


class Client:
    """The options, and how one page is asked for."""

    def __init__(self, options) -> None:
        given = dict(options)
        self.url = given["url"]
        self.transport = given["transport"]
        self.run_id = given.get("run_id", "")
        self.size = int(given.get("records_per_page", 100))
        self.tries = int(given.get("tries", 5))
        self.first = int(given.get("first", 1))
        self.pages = int(given.get("pages", 100))
        if min(self.size, self.tries, self.first, self.pages) < 1:
            raise ValueError("records_per_page, tries, first and pages count from 1")

    def _answer(self, page: int) -> dict:
        module, _, name = self.transport.partition(":")
        transport: Transport = getattr(import_module(module), name)
        params = {"page": page, "page_size": self.size, "fields": ",".join(PRODUCT_FIELDS + EXTRA_FIELDS), "sort_by": "last_modified_t", "json": 1}
        return dict(ask(transport, self.url, params, self.tries))

    def last_page(self) -> int:
        """How many pages there are now, by what the source reports."""
        return math.ceil(int(self._answer(self.first).get("count") or 0) / self.size)

    def rows(self, pages: Pages) -> Iterator[tuple]:
        """The pages' envelopes as rows of PAGE, one after the other."""
        for page in range(pages.first, pages.end):
            yield from self._row(page)

    def _row(self, page: int) -> Iterator[tuple]:
        """The page's envelope, if it has products."""
        body = self._answer(page)
        products = body.get("products") or []
        if products:
            yield (self.run_id, page, page, len(products), datetime.now(timezone.utc).isoformat(), self.url, int(body.get("count") or 0), json.dumps(products, ensure_ascii=False))


class PageReader(DataSourceReader):
    def __init__(self, client: Client) -> None:
        self.client = client

    def partitions(self) -> list[Pages]:
        return runs(self.client.first, self.client.first + self.client.pages)

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.client.rows(partition)


class PageStreamReader(DataSourceStreamReader):
    """Offsets name the first page that isn't covered."""

    def __init__(self, client: Client) -> None:
        self.client, self.reached = client, client.first

    def initialOffset(self) -> dict:
        return {"next_page": self.client.first}

    def latestOffset(self) -> dict:
        self.reached = max(self.reached, self.client.last_page() + 1)
        return {"next_page": self.reached}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return runs(start["next_page"], end["next_page"])

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.client.rows(partition)

    def commit(self, end: dict) -> None:
        pass  # the query's checkpoint holds it


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self):
        return PAGE

    def reader(self, schema) -> PageReader:
        return PageReader(Client(self.options))

    def streamReader(self, schema) -> PageStreamReader:
        return PageStreamReader(Client(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageSource)


def mounted(url: str, params) -> Response:
    """A transport for pages that have been landed in a mounted folder as page=N/*.json, one body a page: what a source's
    mirror or a test offers. The number of products is in a file beside them."""
    folder = Path(url.removeprefix("file://"))
    found = sorted(folder.glob(f"page={params['page']}/part-*"))
    products = [json.loads(line) for f in found for line in f.read_text(encoding="utf-8").splitlines()]
    counts = [int(line) for f in folder.glob("count/part-*") for line in f.read_text(encoding="utf-8").splitlines()]
    return Response(200, {"count": sum(counts), "products": products})
