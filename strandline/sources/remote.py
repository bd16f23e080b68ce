"""Clients of the htsget (1.3) and refget (2.0) protocols.

The driver resolves a ticket; its blocks are one row each and fetched by tasks, so data never passes through
the driver. A response is the concatenation of its blocks in order.
"""

from __future__ import annotations

import base64
import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strandline.functions.regions import Region

#: Formats by kind of data, the first is the default.
FORMATS = {"reads": ("BAM", "CRAM"), "variants": ("VCF", "BCF")}
TIMEOUT = 60


class RemoteError(Exception):
    """An error that a server reports: its name and message."""

    def __init__(self, error: str, message: str) -> None:
        super().__init__(f"{error}: {message}")
        self.error, self.message = error, message


def _join(base: str, path: str) -> str:
    return urllib.parse.urljoin(base if base.endswith("/") else f"{base}/", path)


def _send(request: urllib.request.Request | str) -> bytes:
    with urllib.request.urlopen(request, timeout=TIMEOUT) as r:
        return r.read()


@dataclass
class Block:
    url: str
    headers: dict[str, str] = field(default_factory=dict)

    def fetch(self) -> bytes:
        if self.url.startswith("data:"):
            _, mark, data = self.url.partition(";base64,")
            if not mark:
                raise ValueError("a data block must be in base64")
            return base64.b64decode(urllib.parse.unquote(data), validate=True)
        return _send(urllib.request.Request(self.url, headers=self.headers))


@dataclass
class Ticket:
    format: str
    blocks: list[Block]
    md5: str | None = None

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row per block, fetched by the tasks: ``block`` and ``data``."""
        rows = [(i, b.url, b.headers) for i, b in enumerate(self.blocks)]
        urls = spark.createDataFrame(rows, "block int, url string, headers map<string,string>").repartition(max(1, len(rows)), "block")

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    data = Block(r["url"], dict(r["headers"] or {})).fetch()
                    yield pa.RecordBatch.from_arrays([pa.array([r["block"]], pa.int32()), pa.array([data], pa.binary())], ["block", "data"])

        return urls.mapInArrow(fetch, "block int, data binary")

    def chunks(self) -> Iterator[bytes]:
        """The blocks in order, one at a time."""
        for b in self.blocks:
            yield b.fetch()


def payload(kind: str, *, fmt: str | None = None, header_only: bool = False, regions: Sequence[Region] = ()) -> dict:
    """Body of a request; starts are counted from 0, ends are exclusive. A request for the header names no regions."""
    if header_only:
        return {"format": FORMATS[kind][0], "class": "header"}
    if fmt is not None and fmt not in FORMATS[kind]:
        raise ValueError(f"{fmt} is no format of {kind}")
    out: dict = {"format": fmt or FORMATS[kind][0]}
    if regions:
        out["regions"] = [{"referenceName": r.name, **({"start": r.start - 1} if r.start else {}), **({"end": r.end} if r.end else {})} for r in regions]
    return out


def ticket(base_url: str, kind: str, id_: str, **how) -> Ticket:
    """Ask for ``reads`` or ``variants``; an error that the server explains raises ``RemoteError``."""
    body = json.dumps(payload(kind, **how)).encode()
    request = urllib.request.Request(_join(base_url, f"{kind}/{id_}"), data=body, headers={"Content-Type": "application/json"}, method="POST")
    try:
        got = json.loads(_send(request))["htsget"]
    except urllib.error.HTTPError as e:
        if 400 <= e.code < 500:
            told = json.loads(e.read())["htsget"]
            raise RemoteError(told["error"], told["message"]) from None
        raise
    return Ticket(got.get("format", FORMATS[kind][0]), [Block(u["url"], u.get("headers") or {}) for u in got["urls"]], got.get("md5"))


def sequence(base_url: str, id_: str, start: int | None = None, end: int | None = None) -> str:
    """Bases ``start`` .. ``end`` (from 1, both included) of a reference sequence."""
    query = {k: v for k, v in (("start", start and start - 1), ("end", end)) if v is not None}
    url = _join(base_url, f"sequence/{id_}") + (f"?{urllib.parse.urlencode(query)}" if query else "")
    return _send(urllib.request.Request(url, headers={"Accept": "text/vnd.ga4gh.refget.v2.0.0+plain"})).decode("ascii")


def sequence_metadata(base_url: str, id_: str) -> dict:
    return json.loads(_send(_join(base_url, f"sequence/{id_}/metadata")))["metadata"]


def service_info(base_url: str) -> dict:
    return json.loads(_send(_join(base_url, "sequence/service-info")))
