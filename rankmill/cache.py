"""Results of single searches, kept for a while in the driver's memory."""

from __future__ import annotations

import hashlib
import json
import time
from collections import OrderedDict
from collections.abc import Callable


def cache_key(query: str, limit: int, normalizer: str, index_version: int, model_version: str, reranker: str, fingerprint: str) -> str:
    """32 hexadecimal digits of all that decides a search's results: a new index version or setting is a new key."""
    parts = [query, limit, normalizer, index_version, model_version, reranker, fingerprint]
    return hashlib.sha256(json.dumps(parts, ensure_ascii=False).encode("utf-8", "surrogatepass")).hexdigest()[:32]


class ResultCache:
    """At most so many results, the least recently used one goes first; each ends after ttl_ms, 0 being never. 0 entries: none is kept."""

    def __init__(self, max_entries: int = 500, ttl_ms: int = 300_000, clock: Callable[[], float] = time.monotonic):
        self.max_entries, self.ttl, self.clock = max_entries, ttl_ms / 1000, clock
        self.entries: OrderedDict[str, tuple[float, list]] = OrderedDict()

    def get(self, key: str) -> list | None:
        made, value = self.entries.get(key, (0.0, None))
        if value is None:
            return None
        if self.ttl and self.clock() - made > self.ttl:
            del self.entries[key]
            return None
        self.entries.move_to_end(key)
        return value

    def put(self, key: str, value: list) -> None:
        self.entries[key] = (self.clock(), value)
        self.entries.move_to_end(key)
        while len(self.entries) > self.max_entries:
            self.entries.popitem(last=False)

    def clear(self) -> None:
        self.entries.clear()
