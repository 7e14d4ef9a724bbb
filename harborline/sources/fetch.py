"""Driver-side fetching with retries and a file cache, a source registry, and sinks."""

from __future__ import annotations

import gzip
import hashlib
import json
import os
import random
import tempfile
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from harborline.sources.parsers import SourceError


def atomic_write(path: str | Path, data: bytes) -> Path:
    """Writes beside the target and renames, so a reader never sees half a file."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=path.parent)
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise
    return path


def write_json(path: str | Path, value: object) -> Path:
    return atomic_write(path, json.dumps(value, default=lambda x: x.item() if hasattr(x, "item") else str(x), indent=1).encode())


def read_json(path: str | Path) -> object:
    return json.loads(Path(path).read_text())


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def human_size(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024:
            return f"{n:.1f} {unit}" if unit != "B" else f"{int(n)} B"
        n /= 1024
    return f"{n:.1f} TB"


def file_sha256(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


@dataclass(frozen=True)
class Fetched:
    url: str
    body: bytes
    from_cache: bool
    fetched_at: float
    stale: bool = False
    content_type: str = ""

    @property
    def sha256(self) -> str:
        return sha256(self.body)


class Cache:
    """Bodies by address, each with a sidecar: address, when it was fetched and last confirmed, its digest, and the
    validators that a conditional request sends back. A body whose digest is not the sidecar's is not used."""

    def __init__(self, folder: str, url: str):
        self.body = Path(folder, sha256(url.encode()))
        self.side = self.body.with_suffix(".meta.json")
        self.url = url

    def read(self) -> tuple[bytes, dict] | None:
        if not self.body.exists():
            return None
        body = self.body.read_bytes()
        try:
            meta = read_json(self.side)
        except (OSError, ValueError):  # a body of its own, as an older cache left it
            at = self.body.stat().st_mtime
            return body, {"url": self.url, "fetched_at": at, "checked_at": at}
        return (body, meta) if meta.get("sha256") == sha256(body) else None

    def write(self, body: bytes, headers: dict[str, str], now: float) -> dict:
        kept = {k: headers[k] for k in ("etag", "last-modified", "content-type") if k in headers}
        meta = {"url": self.url, "fetched_at": now, "checked_at": now, "sha256": sha256(body), "size": len(body), **kept}
        atomic_write(self.body, body)
        write_json(self.side, meta)
        return meta

    def confirm(self, meta: dict, now: float) -> None:
        """The source says that the body still holds."""
        write_json(self.side, {**meta, "checked_at": now, "sha256": file_sha256(self.body)})


def get_bytes(url: str, params: dict | None = None, cache_dir: str | None = None, ttl_days: float = 30, timeout: float = 30, max_retries: int = 4, refresh: bool = False, opener: Callable | None = None, pause: Callable[[float], None] = time.sleep) -> Fetched:
    """GET with backoff and jitter; a fresh cached body is used first and a stale one if the source fails.

    A ttl of 0 or less never expires. A cached body that is too old is asked for with its validators, and kept
    for another ttl if the source answers 304. Client errors are not retried, save 408 and 429.
    """
    params = {k: v for k, v in (params or {}).items() if v is not None and v != ""}
    if params:
        url = f"{url}{'&' if '?' in url else '?'}{urllib.parse.urlencode(sorted(params.items()))}"
    cache = Cache(cache_dir, url) if cache_dir else None
    held, meta = cache.read() or (None, {}) if cache else (None, {})
    cached = lambda stale: Fetched(url, held, True, meta["fetched_at"], stale, meta.get("content-type", ""))
    if held is not None and not refresh and (ttl_days <= 0 or time.time() - meta["checked_at"] < ttl_days * 86400):
        return cached(False)
    headers = {"User-Agent": "harborline", "Accept-Encoding": "gzip"}
    if held is not None and not refresh:
        headers |= {name: meta[key] for name, key in (("If-None-Match", "etag"), ("If-Modified-Since", "last-modified")) if key in meta}
    opener, error = opener or urllib.request.urlopen, None
    for attempt in range(max_retries + 1):
        try:
            with opener(urllib.request.Request(url, headers=headers), timeout=timeout) as reply:
                body, answered = reply.read(), {k.lower(): v for k, v in dict(getattr(reply, "headers", None) or {}).items()}
            body = gzip.decompress(body) if body[:2] == b"\x1f\x8b" else body
            now = time.time()
            if cache:
                cache.write(body, answered, now)
            return Fetched(url, body, False, now, False, answered.get("content-type", ""))
        except urllib.error.HTTPError as e:
            if e.code == 304 and held is not None:
                cache.confirm(meta, time.time())
                return cached(False)
            error = e
            if e.code < 500 and e.code not in (408, 429):
                break
        except OSError as e:
            error = e
        if attempt < max_retries:
            pause(min(30, 0.5 * 2**attempt) * (0.5 + random.random() / 2))
    if held is not None:
        return cached(True)
    raise SourceError(f"{url}: {error}")


@dataclass
class Source:
    name: str
    load: Callable[[SparkSession], DataFrame]
    required: bool = True
    url: str = ""


@dataclass
class Manifest:
    rows: list[tuple] = field(default_factory=list)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "source string, status string, n_rows long, url string, fetched_at double, message string")


def ingest_all(spark: SparkSession, sources: list[Source], out: str, only: list[str] | None = None) -> Manifest:
    """Loads each source and writes it as Parquet; a required one that fails stops, an optional one is noted."""
    manifest = Manifest()
    for s in sources:
        if only and s.name not in only:
            continue
        try:
            df = s.load(spark)
            df.write.mode("overwrite").parquet(f"{out}/{s.name}")
            n = spark.read.parquet(f"{out}/{s.name}").count()
            manifest.rows.append((s.name, "ok", n, s.url, time.time(), ""))
        except Exception as e:
            if s.required:
                raise SourceError(f"required source {s.name}: {e}") from e
            manifest.rows.append((s.name, "failed", 0, s.url, time.time(), str(e)[:200]))
    return manifest


def write_results(queries: dict[str, Callable[[SparkSession, str], DataFrame]], spark: SparkSession, sf_dir: str, out: str, limit: int | None = None) -> dict[str, int]:
    """Every query's result as CSV with a header, in order; no limit for None or 0."""
    sizes = {}
    for name, run in queries.items():
        df = run(spark, sf_dir)
        (df.limit(limit) if limit else df).write.mode("overwrite").option("header", True).csv(f"{out}/{name}")
        sizes[name] = spark.read.option("header", True).csv(f"{out}/{name}").count()
    return sizes
