"""Where entities go: files in two framings, and a context broker."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def extension(framing: str, context: bool) -> str:
    return {("array", True): "jsonld", ("array", False): "json", ("line-delimited", True): "ndjsonld", ("line-delimited", False): "jsonl"}[framing, context]


def write_files(entities: DataFrame, directory: str, framing: str = "line-delimited") -> None:
    """entities(type, entity): a folder per type. Each part file is whole by itself: lines, or one array. An array's rows
    are numbered and sorted by type and number, which is the order that the writer asks for, so that it sorts no further
    and brackets stay where they belong whatever is spilled."""
    if framing == "line-delimited":
        entities.select("type", "entity").write.partitionBy("type").mode("overwrite").text(directory)
        return

    def arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened: set[str] = set()
        n = 0
        for pdf in batches:
            out = []
            for n, (kind, e) in enumerate(zip(pdf["type"], pdf["entity"], strict=True), n + 1):
                out.append((kind, ("," if kind in opened else "[") + e, n))
                opened.add(kind)
            yield pd.DataFrame(out, columns=["type", "entity", "n"])
        yield pd.DataFrame([(kind, "]", n + 1) for kind in sorted(opened)], columns=["type", "entity", "n"])

    framed(entities, arrays).write.partitionBy("type").mode("overwrite").text(directory)


def framed(entities: DataFrame, arrays: Callable) -> DataFrame:
    """Rows that arrays made, in its order within each type."""
    made = entities.select("type", "entity").mapInPandas(arrays, "type string, entity string, n long")
    # A type that can't be null keeps its column, and with it the order, through the writer's own projection.
    return made.withColumn("type", F.coalesce("type", F.lit(""))).sortWithinPartitions("type", "n").select("type", "entity")


#: Where operations are posted.
ROUTES = {"upsert": "/ngsi-ld/v1/entityOperations/upsert", "create": "/ngsi-ld/v1/entityOperations/create", "update": "/ngsi-ld/v1/entityOperations/update", "merge": "/ngsi-ld/v1/entityOperations/merge", "temporal": "/ngsi-ld/v1/temporal/entities"}


@dataclass
class Tuning:
    """Additive increase, multiplicative decrease of a batch's bytes, by latency."""

    target: int = 128 * 1024
    least: int = 16 * 1024
    most: int = 512 * 1024
    low_ms: float = 500
    high_ms: float = 5000
    latency: float | None = None
    limit: int | None = None

    def succeeded(self, ms: float) -> None:
        self.latency = ms if self.latency is None else 0.7 * self.latency + 0.3 * ms
        if self.latency < self.low_ms:
            self.target = min(self.most, self.limit or self.most, self.target + 16 * 1024)
        elif self.latency > self.high_ms:
            self.target = max(self.least, self.target // 2)

    def refused(self, size: int) -> None:
        """Too large: never send that much again."""
        self.limit = max(self.least, size // 2)
        self.target = min(self.target, self.limit)


@dataclass
class Broker:
    url: str
    operation: str = "upsert"
    tenant: str | None = None
    headers: dict[str, str] = field(default_factory=dict)
    attempts: int = 3
    backoff: float = 1.0
    #: post(url, body, headers) -> (status, body); replaced in tests.
    post: Callable[[str, bytes, dict], tuple[int, str]] | None = None

    def send(self, url: str, body: bytes) -> tuple[int, str]:
        headers = {"Content-Type": "application/ld+json", **self.headers, **({"NGSILD-Tenant": self.tenant} if self.tenant else {})}
        if self.post:
            return self.post(url, body, headers)
        import urllib.error
        import urllib.request

        try:
            with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=30) as r:
                return r.status, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode(errors="replace")

    def deliver(self, entities: list[str], tuning: Tuning | None = None) -> tuple[int, list[tuple[str, str]]]:
        """How many were written, and (id, reason) of the rest. A batch that fails is split in half until the faulty
        entity stands alone; an answer of 207 tells which failed."""
        tuning = tuning or Tuning()
        if not entities:
            return 0, []
        body = ("[" + ",".join(entities) + "]").encode()
        if tuning.limit and len(body) > tuning.limit and len(entities) > 1:
            return self._halves(entities, tuning)
        status, text = 0, ""
        for k in range(self.attempts):
            began = time.monotonic()
            try:
                status, text = self.send(self.url.rstrip("/") + ROUTES[self.operation], body)
            except OSError as e:
                status, text = 599, str(e)
            if status < 500 and status != 429:
                break
            if k + 1 < self.attempts:
                time.sleep(min(30.0, self.backoff * 2**k))
        if status == 207:
            failed = {e["entityId"]: str(e.get("error", "failed")) for e in json.loads(text or "{}").get("errors", [])}
            bad = [(i, failed[i]) for i in (json.loads(e)["id"] for e in entities) if i in failed]
            return len(entities) - len(bad), bad
        if status < 300:
            tuning.succeeded((time.monotonic() - began) * 1000)
            return len(entities), []
        if status == 413:
            tuning.refused(len(body))
        if len(entities) > 1 and status < 500:
            return self._halves(entities, tuning)
        return 0, [(json.loads(e)["id"], f"{status} {text[:200]}") for e in entities]

    def _halves(self, entities, tuning):
        k = len(entities) // 2
        a, b = self.deliver(entities[:k], tuning), self.deliver(entities[k:], tuning)
        return a[0] + b[0], a[1] + b[1]


def to_broker(entities: DataFrame, broker: Broker, partitions: int = 8) -> DataFrame:
    """Sends each partition in batches of tuned size; returns per partition written and failed (with reasons). At most
    ``partitions`` connections are open at a time. Upserts may repeat after a lost executor."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tuning, written, failed, batch, size = Tuning(), 0, [], [], 0
        for pdf in batches:
            for e in pdf["entity"]:
                if batch and size + len(e) > tuning.target:
                    n, bad = broker.deliver(batch, tuning)
                    written, failed, batch, size = written + n, failed + bad, [], 0
                batch.append(e)
                size += len(e)
        n, bad = broker.deliver(batch, tuning)
        failed += bad
        yield pd.DataFrame({"written": [written + n], "failed": [len(failed)], "reasons": [json.dumps(failed[:10])]})

    return entities.select("entity").coalesce(partitions).mapInPandas(send, "written long, failed long, reasons string")


def masked(url: str) -> str:
    """A URL without its credentials and query, for messages."""
    import re

    return re.sub(r"\?.*$", "?…", re.sub(r"//[^/@]*@", "//…@", url))


def with_context(entity: Column, context: str) -> Column:
    return F.regexp_replace(entity, r"^\{", '{"@context":' + context.replace("\\", "\\\\").replace("$", "\\$") + ",")
