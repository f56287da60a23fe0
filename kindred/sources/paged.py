"""A paged source of category members and a batched lookup, over any transport."""

from __future__ import annotations

import json
import os
import time
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Members of a page, titles of a lookup, tries of a request and the pause that grows with them.
PAGE, BATCH, TRIES, PAUSE_S = 500, 50, 4, 2.0


#: What requests say of themselves, and what a lookup asks for.
AGENT = "kindred/1.0"
PROPERTIES = {"prop": "imageinfo|categories", "iiprop": "url|size|mime|extmetadata", "cllimit": "500"}


def post(url: str, params: dict, tries: int = TRIES, pause: float = PAUSE_S) -> dict:
    for n in range(tries):
        try:
            request = urllib.request.Request(url, urllib.parse.urlencode(params).encode(), {"User-Agent": AGENT})
            with urllib.request.urlopen(request, timeout=60) as r:
                return json.load(r)
        except Exception:  # a failed connection as well as a broken answer
            if n == tries - 1:
                raise
            time.sleep(pause * (n + 1))
    raise AssertionError


def pages(fetch: Callable[[dict], dict], params: dict) -> Iterator[dict]:
    """Answers until one has no continuation."""
    more: dict = {}
    while True:
        got = fetch(params | more)
        yield got
        more = got.get("continue") or {}
        if not more:
            return


def members(fetch: Callable[[dict], dict], category: str, kind: str) -> Iterator[str]:
    ask = {"action": "query", "format": "json", "list": "categorymembers", "cmtitle": category, "cmtype": kind, "cmlimit": PAGE}
    for got in pages(fetch, ask):
        for x in got.get("query", {}).get("categorymembers", []):
            yield x["title"]


class _Part(InputPartition):
    def __init__(self, category: str):
        self.category = category


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [_Part(c) for c in self.options["categories"].split("|")]

    def read(self, partition):
        url = self.options["url"]
        for title in members(lambda p: post(url, p), partition.category, self.options.get("kind", "file")):
            yield (partition.category, title)


class CategoryMembers(DataSource):
    """spark.read.format('category_members') with options url, categories (split at '|'), kind: a task per category."""

    @classmethod
    def name(cls):
        return "category_members"

    def schema(self):
        return "category string, title string"

    def reader(self, schema):
        return _Reader(dict(self.options))


def _get(url: str) -> bytes:
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": AGENT}), timeout=60) as r:
        return r.read()


def download(files: DataFrame, fetch: Callable[[str], bytes] = _get, tries: int = 3, least: int = 10_000, pause: float = PAUSE_S) -> DataFrame:
    """files (url, file) with column done. Files of more than `least` bytes are there already and aren't fetched; others are tried `tries` times.

    file is a path that every executor mounts. A file appears whole or not at all, so a task may run again.
    """

    def one(url: str, file: str) -> bool:
        if os.path.exists(file) and os.path.getsize(file) > least:
            return True
        for n in range(tries):
            try:
                data = fetch(url)
                part = f"{file}.{uuid.uuid4().hex}"
                with open(part, "wb") as f:
                    f.write(data)
                os.replace(part, file)
                return True
            except Exception:  # whatever a transport raises
                time.sleep(pause * (n + 1) if n < tries - 1 else 0)
        return False

    def run(parts):
        for pdf in parts:
            yield pdf.assign(done=[one(u, f) for u, f in zip(pdf["url"], pdf["file"], strict=True)])

    return files.select("url", "file").mapInPandas(run, "url string, file string, done boolean")


def lookup(titles: DataFrame, fetch: Callable[[dict], dict], batch: int = BATCH, properties: dict[str, str] | None = None) -> DataFrame:
    """titles (column title) with column info, a JSON string, asked for in batches on the executors.

    An answer that continues adds its categories to those that came before; of other fields the last value counts.
    """
    asked = PROPERTIES if properties is None else properties

    def run(parts):
        for pdf in parts:
            for low in range(0, len(pdf), batch):
                part = pdf.iloc[low : low + batch].copy()
                found: dict[str, dict] = {}
                for got in pages(fetch, {"action": "query", "format": "json", "titles": "|".join(part["title"]), **asked}):
                    for p in got.get("query", {}).get("pages", {}).values():
                        known = found.setdefault(p["title"], {})
                        categories = known.get("categories", []) + p.get("categories", [])
                        known |= p | ({"categories": categories} if categories else {})
                part["info"] = [json.dumps(found[t]) if t in found else None for t in part["title"]]
                yield part[["title", "info"]]

    return titles.select("title").mapInPandas(run, "title string, info string")
