"""Settings of the engine: defaults, presets of a mode, a YAML file and overrides, merged in that order and checked as a whole."""

from __future__ import annotations

import copy
import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from .errors import ConfigurationError
from .functions.text import STOPWORDS
from .operators import lexical, normalizer, ranking, vector

#: Defaults by section. Fixed values where results depend on them.
DEFAULTS: dict = {
    "mode": "development",
    "database": {"url": None, "host": "127.0.0.1", "port": 5432, "user": "postgres", "password": None, "database": "postgres"},
    "search": {"default_limit": ranking.DEFAULT_LIMIT, "max_limit": ranking.MAX_LIMIT, "max_query_length": normalizer.MAX_QUERY_LENGTH},
    "retrieval": {
        "bm25": {
            "enabled": True, "top_k": lexical.TOP_K, "k1": lexical.K1, "b": lexical.B,
            "field_weights": {"code": 4.0, "name": 2.0, "attributes": 1.5, "brand": 1.0, "category": 1.0},
            "boosts": {"exact_code": lexical.EXACT, "code_prefix": lexical.PREFIX, "numeric_attribute": lexical.NUMERIC}, "stopwords": STOPWORDS,
        },
        "vector": {"enabled": True, "top_k": vector.TOP_K, "metric": "cosine", "min_score": vector.MIN_SCORE},
    },
    "fusion": {"provider": "rrf", "k": ranking.RRF_K, "top_k": ranking.FUSED, "weights": {"bm25": 1.0, "vector": 1.0}},
    "reranking": {
        "enabled": True, "provider": "noop", "candidate_limit": ranking.CANDIDATES, "result_limit": ranking.DEFAULT_LIMIT, "fallback": ["noop"],
        "cross_encoder": {"batch_size": 16, "max_text_length": 512}, "von": {"timeout_ms": 5000, "batch_size": 8, "max_text_length": 512},
    },
    "ranking": {"policy": "reranker", "weights": {"bm25": 0.2, "vector": 0.2, "rrf": 0.2, "reranker": 0.4}},
    "embedding": {"provider": "hashing", "model": "", "model_version": "hashing-v1", "dimensions": vector.DIMENSIONS, "batch_size": 64, "normalize": True},
    "normalization": {
        "enabled": True, "provider": "deterministic", "language": "fr", "typo": {"enabled": True, "max_edit_distance": 2, "min_token_length": 4},
        "tinyllm": {"timeout_ms": 3000, "max_input_chars": 256},
    },
    "cache": {"enabled": True, "max_entries": 500, "ttl_ms": 300_000},
    "logging": {"enabled": True, "level": "info", "pretty": True, "debug_search": False, "events": {"enabled": False, "behavior_events": False}},
    "documents": {"preload": True, "lru_max": 200_000},
}

#: What each mode sets beneath a file's own settings. Fixed values.
PRESETS: dict[str, dict] = {
    "development": {},
    "production": {"logging": {"pretty": False, "level": "info", "debug_search": False}, "cache": {"enabled": True}},
    "benchmark": {"logging": {"pretty": False, "level": "warn", "debug_search": False, "events": {"enabled": False, "behavior_events": False}}, "cache": {"enabled": False}},
    "debug": {"logging": {"level": "debug", "pretty": True, "debug_search": True}},
}

RERANKERS = ["noop", "overlap", "cross-encoder", "von"]
#: Settings with one of a few values.
CHOICES: dict[str, list[str]] = {
    "mode": list(PRESETS), "retrieval.vector.metric": ["cosine", "inner-product"], "fusion.provider": ["rrf"], "reranking.provider": RERANKERS,
    "ranking.policy": ["reranker", "weighted"], "embedding.provider": ["hashing", "transformers", "mock"],
    "normalization.provider": ["none", "deterministic", "tinyllm", "mock"],
}
#: Settings with a least and a largest value (None: open), as numbers.
RANGES: dict[str, tuple[float | None, float | None]] = {
    "search.default_limit": (1, None), "search.max_query_length": (16, 8192), "retrieval.bm25.top_k": (1, 1000), "retrieval.bm25.k1": (1e-9, 3), "retrieval.bm25.b": (0, 1),
    "retrieval.vector.top_k": (1, 1000), "retrieval.vector.min_score": (-1, 1), "fusion.k": (1, None), "fusion.top_k": (1, None), "fusion.weights.bm25": (0, None),
    "fusion.weights.vector": (0, None), "reranking.candidate_limit": (1, 500), "reranking.result_limit": (1, 100), "reranking.cross_encoder.batch_size": (1, None),
    "reranking.von.batch_size": (1, None), "reranking.von.timeout_ms": (100, None), "embedding.dimensions": (8, 4096), "embedding.batch_size": (1, None),
    "normalization.tinyllm.timeout_ms": (100, None), "cache.max_entries": (1, None), "documents.lru_max": (1000, None),
}


def merged(base: dict, patch: dict | None) -> dict:
    """base with the patch's values over it, mapping by mapping; lists and None replace."""
    out = copy.deepcopy(base)
    for key, value in (patch or {}).items():
        both = isinstance(value, dict) and isinstance(out.get(key), dict)
        out[key] = merged(out[key], value) if both else copy.deepcopy(value)
    return out


@dataclass(frozen=True)
class Config:
    """Checked settings; config["retrieval.bm25.top_k"] reads one by its path."""

    values: dict

    def __getitem__(self, path: str):
        at = self.values
        for key in path.split("."):
            at = at[key]
        return at

    def changed(self, patch: dict) -> Config:
        """These settings with a patch over them, checked again."""
        return checked(merged(self.values, patch))

    def fingerprint(self) -> str:
        """16 hexadecimal digits of what decides results."""
        parts = {section: self.values[section] for section in ("search", "retrieval", "fusion", "ranking", "embedding")}
        parts["reranking"] = {k: self[f"reranking.{k}"] for k in ("enabled", "provider", "candidate_limit", "fallback")}
        parts["normalization"] = {k: self[f"normalization.{k}"] for k in ("enabled", "provider", "language", "typo")}
        return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()[:16]


def problems(values: dict) -> list[str]:
    """`path: message` of every wrong setting."""
    at = Config(values)
    found: list[str] = []

    def need(path: str, fine: Callable[[], bool], message: str) -> None:
        try:
            good = fine()
        except (KeyError, TypeError):
            good = False
        if not good:
            found.append(f"{path}: {message}")

    def within(path: str, low: float | None, high: float | None) -> None:
        number = lambda: isinstance(at[path], int | float) and not isinstance(at[path], bool)
        text = f"within [{low:g}, {high:g}]" if low is not None and high is not None else f">= {low:g}"
        need(path, lambda: number() and (low is None or at[path] >= low) and (high is None or at[path] <= high), f"must be {text}")

    for path, allowed in CHOICES.items():
        need(path, lambda path=path, allowed=allowed: at[path] in allowed, "must be " + "|".join(allowed))
    for path, (low, high) in RANGES.items():
        within(path, low, high)
    for group in ("retrieval.bm25.field_weights", "retrieval.bm25.boosts"):
        for name in DEFAULTS["retrieval"]["bm25"][group.rsplit(".", 1)[1]]:
            within(f"{group}.{name}", 0, None)
    need("search.default_limit", lambda: isinstance(at["search.default_limit"], int), "must be a whole number")
    need("search.max_limit", lambda: at["search.max_limit"] >= at["search.default_limit"], "must be >= search.default_limit")
    need("retrieval", lambda: at["retrieval.bm25.enabled"] or at["retrieval.vector.enabled"], "one of retrieval.bm25.enabled and retrieval.vector.enabled must be true")
    need("reranking.fallback", lambda: all(f in RERANKERS for f in at["reranking.fallback"]), "entries must be " + "|".join(RERANKERS))
    need("reranking.fallback", lambda: at["reranking.provider"] != "von" or len(at["reranking.fallback"]) > 0, "von needs a fallback, such as noop")
    need("ranking.weights", lambda: at["ranking.policy"] != "weighted" or sum(at["ranking.weights"].values()) > 0, "must sum to more than 0 with policy weighted")
    need("embedding.model", lambda: at["embedding.provider"] != "transformers" or len(at["embedding.model"]) > 0, "is needed by the provider transformers")
    need("normalization.language", lambda: len(at["normalization.language"]) >= 2, "must be an ISO language code")
    if at["normalization"].get("provider") in ("deterministic", "tinyllm"):
        need("normalization.typo.max_edit_distance", lambda: at["normalization.typo.max_edit_distance"] in (1, 2), "must be 1 or 2")
        within("normalization.typo.min_token_length", 3, None)
    need("cache.ttl_ms", lambda: at["cache.ttl_ms"] == 0 or at["cache.ttl_ms"] >= 1000, "must be 0 (no end) or >= 1000")
    need("database", lambda: at["database.url"] is not None or at["database.host"] is not None, "either database.url or database.host must be set")
    return found


def checked(values: dict) -> Config:
    """The settings, or ConfigurationError with all that is wrong."""
    wrong = problems(values)
    if wrong:
        raise ConfigurationError(f"{len(wrong)} wrong setting(s):\n  - " + "\n  - ".join(wrong), wrong)
    return Config(values)


def read_yaml(path: str, required: bool = False) -> dict:
    """A YAML mapping; an empty file, and a missing one unless required, set nothing."""
    try:
        import yaml
    except ImportError as missing:
        raise ConfigurationError("settings in YAML need the package pyyaml") from missing
    try:
        found = yaml.safe_load(Path(path).read_text("utf-8"))
    except FileNotFoundError as missing:
        if required:
            raise ConfigurationError(f"settings file not found: {path}") from missing
        return {}
    except (yaml.YAMLError, UnicodeDecodeError) as bad:
        raise ConfigurationError(f"settings file {path} is no YAML: {bad}") from bad
    if found is not None and not isinstance(found, dict):
        raise ConfigurationError(f"settings file {path} must hold a mapping")
    return found or {}


def load(path: str | None = None, overrides: dict | None = None, required: bool = False) -> Config:
    """Defaults, then the mode's preset, then the file, then the overrides."""
    patch = merged(read_yaml(path, required) if path else {}, overrides)
    preset = PRESETS.get(patch.get("mode", DEFAULTS["mode"]), {})
    return checked(merged(merged(DEFAULTS, preset), patch))
