"""Writing the event log on the driver: JSON lines in a file for each day, with the job at hand bound to every event."""

from __future__ import annotations

import contextvars
import datetime
import json
import resource
import sys
import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from typing import Any

SCHEMA_VERSION = "1.0"
_bound: contextvars.ContextVar[dict[str, Any]] = contextvars.ContextVar("bound", default={})


@contextmanager
def bind(**fields: Any) -> Iterator[None]:
    """Events inside carry ``fields``."""
    token = _bound.set(_bound.get() | fields)
    try:
        yield
    finally:
        _bound.reset(token)


class EventLog:
    """Appends events to ``<prefix>-YYYYMMDD.ndjson`` under ``folder``.

    A log that cannot be written never stops the work: it says so once and goes silent.
    """

    def __init__(self, folder: str, prefix: str = "events"):
        self.folder, self.prefix, self.broken = Path(folder), prefix, False
        self._lock = threading.Lock()

    def path(self, day: datetime.date) -> Path:
        return self.folder / f"{self.prefix}-{day:%Y%m%d}.ndjson"

    def write(self, event: str, **fields: Any) -> None:
        now = datetime.datetime.now(datetime.UTC)
        line = {"schema_version": SCHEMA_VERSION, "ts": f"{now:%Y-%m-%dT%H:%M:%SZ}", "event": event, **_bound.get(), **fields}
        if self.broken:
            return
        try:
            with self._lock:
                self.folder.mkdir(parents=True, exist_ok=True)
                with self.path(now.date()).open("a", encoding="utf-8") as f:
                    f.write(json.dumps(line, ensure_ascii=False, default=str) + "\n")
        except OSError as e:
            self.broken = True
            print(f"the event log is off: {e}", file=sys.stderr)


def driver_rss() -> int:
    """Peak resident bytes of this process."""
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024


@contextmanager
def timed_stage(log: EventLog, stage: str, every: float = 0.0) -> Iterator[None]:
    """Events at a stage's start and end, its memory at both, and every ``every`` seconds between (0: not)."""
    stop = threading.Event()

    def sample() -> None:
        while not stop.wait(every):
            log.write("rss.sample", stage=stage, rss_bytes=driver_rss())

    log.write("stage.start", stage=stage)
    log.write("rss.sample", stage=stage, rss_bytes=driver_rss())
    began = time.monotonic()
    context = contextvars.copy_context()
    thread = threading.Thread(target=lambda: context.run(sample), daemon=True) if every > 0 else None
    if thread:
        thread.start()
    try:
        yield
    finally:
        stop.set()
        if thread:
            thread.join()
        log.write("rss.sample", stage=stage, rss_bytes=driver_rss())
        log.write("stage.end", stage=stage, duration_ms=int(1000 * (time.monotonic() - began)))
