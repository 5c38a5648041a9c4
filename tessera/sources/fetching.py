"""A data source that fetches pages: partitions by host, a second client where the first fails, a time limit, a status each.

    spark.dataSource.register(FetchedPages)
    spark.read.format("fetched_pages").options(requests=path, clients="package.module:first,package.module:second").load()

``requests`` is a Parquet table with a column ``url``. A client is a function of a request (a dict of the columns named in
``columns``) and of the seconds that it may take; it returns the page's text or raises. All requests of a host are in one
partition, one after another, so a host is never asked from two tasks at once, and ``partitions`` bounds how many calls
run at a time. A task reads the column of addresses once and the other columns only of row groups with hosts of its own.

A request whose clients all fail gives a row without content: its status is ``timeout``, ``ssl_error`` or ``error:`` with the
kind of the last failure. So one host that fails ends nothing. Null and empty addresses have the status ``error:no address``.
"""

from __future__ import annotations

import importlib
import re
import ssl
import urllib.request
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Client = Callable[[dict, float], str]
SCHEMA = "url string, host string, content string, client string, status string, size long"
#: Rows that are fetched before they are handed on.
ROWS = 64


def host_of(url: str | None) -> str:
    """The host in lower case, without a port; empty where there is none."""
    found = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", url or "")
    return found[1].lower() if found else ""


def status_of(failure: BaseException) -> str:
    told = str(failure).lower()
    if isinstance(failure, TimeoutError) or "timeout" in type(failure).__name__.lower() or "timed out" in told:
        return "timeout"
    if isinstance(failure, ssl.SSLError) or "ssl" in told or "certificate" in told:
        return "ssl_error"
    return f"error:{type(failure).__name__}"


def _asked(agent: str) -> Client:
    def ask(request: dict, seconds: float) -> str:
        with urllib.request.urlopen(urllib.request.Request(request["url"], headers={"User-Agent": agent}), timeout=seconds) as page:
            return page.read().decode(page.headers.get_content_charset() or "utf-8", "replace")

    return ask


#: The clients where none are named: first as a browser, then under a name of our own.
browser, plain = _asked("Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/124 Safari/537.36"), _asked("tessera")


class Limited:
    """Calls with a time limit, also of clients that don't keep it: a call that takes too long is left behind."""

    def __init__(self, seconds: float):
        self.seconds, self.threads = seconds, ThreadPoolExecutor(1)

    def __call__(self, client: Client, request: dict) -> str:
        try:
            return self.threads.submit(client, request, self.seconds).result(self.seconds)
        except TimeoutError:
            self.threads.shutdown(wait=False)
            self.threads = ThreadPoolExecutor(1)
            raise


def fetch(request: dict, clients: dict[str, Client], limited: Limited) -> tuple[str | None, str | None, str]:
    """Content, the client that it is of, and the status."""
    if not host_of(request.get("url")):
        return None, None, "error:no address"
    status = "error:no client"
    for name, client in clients.items():
        try:
            return limited(client, request), name, "ok"
        except Exception as failure:  # whatever a client raises is the request's status
            status = status_of(failure)
    return None, None, status


@dataclass
class Hosts(InputPartition):
    """The hosts whose hash leaves ``share`` modulo ``shares``."""

    share: int
    shares: int


class FetchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.requests = options["requests"]
        self.clients = [c.strip() for c in options.get("clients", f"{__name__}:browser,{__name__}:plain").split(",")]
        self.columns = [c.strip() for c in options.get("columns", "").split(",") if c.strip()]
        self.seconds, self.shares = float(options.get("seconds", "30")), int(options.get("partitions", "5"))

    def partitions(self) -> list[InputPartition]:
        return [Hosts(k, self.shares) for k in range(self.shares)]

    def _own(self, part: Hosts) -> Iterator[dict]:
        """The requests of the partition's hosts."""
        for fragment in pyarrow.dataset.dataset(self.requests, format="parquet").get_fragments():
            for group in fragment.split_by_row_group():
                urls = group.to_table(columns=["url"]).column("url").to_pylist()
                own = [k for k, url in enumerate(urls) if zlib.crc32(host_of(url).encode()) % part.shares == part.share]
                if own:
                    at = 0
                    for batch in group.to_batches(columns=["url", *self.columns], batch_size=ROWS):
                        mine = [k - at for k in own if at <= k < at + len(batch)]
                        yield from batch.take(pa.array(mine, pa.int64())).to_pylist()
                        at += len(batch)

    def read(self, partition: Hosts) -> Iterator[pa.RecordBatch]:
        clients = {}
        for named in self.clients:
            module, _, name = named.partition(":")
            clients[name] = getattr(importlib.import_module(module), name)
        limited, rows = Limited(self.seconds), []
        for request in self._own(partition):
            content, client, status = fetch(request, clients, limited)
            rows.append((request["url"], host_of(request["url"]), content, client, status, len(content) if content is not None else None))
            if len(rows) == ROWS:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        names = ["url", "host", "content", "client", "status", "size"]
        kinds = [pa.string()] * 5 + [pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


class FetchedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fetched_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FetchReader:
        return FetchReader(self.options)
