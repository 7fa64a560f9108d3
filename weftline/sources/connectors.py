"""Connectors as Python data sources: paged JSON over any URL, and frames of a feed as a stream that goes on where it was.

Both are read in parallel: a URL, or a range of a feed's bytes, for each task. Requests that fail are tried again, after a wait that doubles
each time; the API's own error text is raised. :class:`AnswerCache` keeps answers for a time.
"""

from __future__ import annotations

import json
import os
import random
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

RETRIED = {429, 500, 502, 503, 504}


def wait_seconds(attempt: int, base: float = 1.0, most: float = 60.0, draw: Callable[[], float] = random.random) -> float:
    """base * 2^attempt, at most ``most``, spread by a quarter either way."""
    return min(most, base * 2**attempt) * (0.75 + 0.5 * draw())


def fetch(url: str, tries: int = 5, base: float = 1.0, opener: Callable = urllib.request.urlopen) -> bytes:
    for k in range(tries):
        try:
            with opener(url) as r:
                return r.read()
        except urllib.error.HTTPError as e:
            if e.code not in RETRIED or k == tries - 1:
                raise
        except urllib.error.URLError:
            if k == tries - 1:
                raise
        time.sleep(wait_seconds(k, base))
    raise AssertionError("unreachable")


def records_of(document, path: str) -> list:
    """The records at a dotted path of an answer; an answer whose status isn't 'ok' raises its message."""
    if isinstance(document, dict) and str(document.get("status", "ok")) not in ("ok", "200"):
        raise ValueError(str(document.get("messages") or document.get("message") or document["status"]))
    for step in filter(None, path.split(".")):
        document = document.get(step) if isinstance(document, dict) else None
    return document if isinstance(document, list) else [] if document is None else [document]


def id_batches(ids: list[int], most: int = 100) -> list[str]:
    """Comma lists of at most ``most`` ids: what one request asks for."""
    return [",".join(map(str, ids[k : k + most])) for k in range(0, len(ids), most)]


class _Url(InputPartition):
    def __init__(self, url: str):
        self.url = url


class PagedJson(DataSource):
    """``format("paged_json")``: options ``urls`` (a JSON list) and ``records`` (dotted path); the schema is given by the reader."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PagedReader(schema, dict(self.options))


class _PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.options = schema.names, options

    def partitions(self) -> list[InputPartition]:
        return [_Url(u) for u in json.loads(self.options["urls"])]

    def read(self, partition: _Url) -> Iterator[tuple]:
        for r in records_of(json.loads(fetch(partition.url)), self.options.get("records", "")):
            if self.names == ["value"]:
                yield (json.dumps(r, sort_keys=True),)
            else:
                yield tuple(r.get(n) if isinstance(r, dict) else None for n in self.names)


class AnswerCache:
    """Answers by URL, for ``seconds`` each; at most ``most``, the oldest going first."""

    def __init__(self, seconds: float = 1800, most: int = 256, now: Callable[[], float] = time.monotonic):
        self.seconds, self.most, self.now, self.held = seconds, most, now, {}

    def get(self, url: str, ask: Callable[[str], bytes] = fetch) -> bytes:
        hit = self.held.get(url)
        if hit is not None and self.now() - hit[0] < self.seconds:
            return hit[1]
        answer = ask(url)
        self.held.pop(url, None)
        self.held[url] = (self.now(), answer)
        while len(self.held) > self.most:
            self.held.pop(next(iter(self.held)))
        return answer


def newest_day(names: list[str], prefix: str = "") -> str | None:
    """The name with the latest YYYYMMDD among those that begin with a prefix."""
    dated = [(m.group(0), n) for n in names if n.startswith(prefix) and (m := re.search(r"\d{8}", n))]
    return max(dated)[1] if dated else None


def feed_size(url: str) -> int:
    """Bytes of a feed so far."""
    if url.startswith("file://"):
        return os.path.getsize(url.removeprefix("file://"))
    with urllib.request.urlopen(urllib.request.Request(url, method="HEAD")) as r:
        return int(r.headers["Content-Length"])


def feed_bytes(url: str, a: int, b: int) -> bytes:
    """Bytes from a up to b of a feed; only these are fetched."""
    if b <= a:
        return b""
    if url.startswith("file://"):
        with open(url.removeprefix("file://"), "rb") as f:
            f.seek(a)
            return f.read(b - a)
    return fetch(urllib.request.Request(url, headers={"Range": f"bytes={a}-{b - 1}"}))


class FrameFeed(DataSource):
    """``format("frame_feed")``: the lines of ``url`` as a stream of frames; ``number`` is the byte at which a frame begins.

    The offset is the number of bytes read, up to the end of the last whole line. A batch is cut into ranges of ``rangeBytes``, one for each task, which
    fetches its own range only; a frame belongs to the range in which it begins.
    """

    @classmethod
    def name(cls) -> str:
        return "frame_feed"

    def schema(self) -> str:
        return "number long, frame string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _FrameReader(dict(self.options))


class _Range(InputPartition):
    def __init__(self, a: int, b: int, end: int):
        self.a, self.b, self.end = a, b, end


class _FrameReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.url, self.range = options["url"], int(options.get("rangeBytes", options.get("rangebytes", 8 << 20)))

    def initialOffset(self) -> dict:
        return {"n": 0}

    def latestOffset(self) -> dict:
        """The end of the last whole line: looked for from the feed's end backwards."""
        size, step = feed_size(self.url), 1 << 16
        at = size
        while at > 0:
            a = max(0, at - step)
            cut = feed_bytes(self.url, a, at).rfind(b"\n")
            if cut >= 0:
                return {"n": a + cut + 1}
            at = a
        return {"n": 0}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        a, b = start["n"], end["n"]
        return [_Range(x, min(x + self.range, b), b) for x in range(a, b, self.range)]

    def read(self, part: _Range) -> Iterator[tuple]:
        # the byte before tells whether a frame begins here; the last frame is read to its end
        data = feed_bytes(self.url, max(part.a - 1, 0), part.b)
        at = part.a
        if part.a > 0:
            cut = data.find(b"\n")
            if cut < 0:
                return
            at, data = part.a + cut, data[cut + 1 :]
        more = part.b
        while data and not data.endswith(b"\n") and more < part.end:
            tail = feed_bytes(self.url, more, min(more + (1 << 16), part.end))
            cut = tail.find(b"\n")
            data += tail if cut < 0 else tail[: cut + 1]
            more += len(tail)
            if cut >= 0:
                break
        for line in data.split(b"\n")[:-1]:
            if at < part.b:
                yield at, line.decode("utf-8", "replace").rstrip("\r")
            at += len(line) + 1

    def commit(self, end: dict) -> None:
        """Nothing is held."""


def register(spark) -> None:
    spark.dataSource.register(PagedJson)
    spark.dataSource.register(FrameFeed)
