"""Configuration: one frozen dataclass, filled by directive lines, and named presets of fingerprint indexes.

A line is ``name value...`` with shell-like quoting and ``#`` comments; names ignore case; later lines override earlier ones. An unknown name, a wrong number of
values or a value outside its set raises ``ConfigError``.
"""

from __future__ import annotations

import math
import shlex
from dataclasses import dataclass, fields, replace

#: Fixed values of the storage format: bytes of a container and of its directory, and of one directory entry.
CONTAINER_BYTES = 4 * 1024 * 1024
DIRECTORY_BYTES = 32 * 1024
ENTRY_BYTES = 28
DIRECTORY_HEADER = 16
CONTAINER_DATA = CONTAINER_BYTES - DIRECTORY_BYTES
MAX_ENTRIES = (DIRECTORY_BYTES - DIRECTORY_HEADER) // ENTRY_BYTES


class ConfigError(ValueError):
    """A directive line that can't be read."""


@dataclass(frozen=True)
class DedupConfig:
    working_directory: str = "/home/data/working/"
    simulation_level: str = "no"
    trace_format: str = "native"
    log_level: str = "warning"
    chunk_algorithm: str = "rabin"
    chunk_avg_size: int = 8192
    chunk_max_size: int = 65536
    chunk_min_size: int = 1024
    index_exact: bool = False
    index_logical: bool = False
    index_preset: str | None = None
    index_cache_size: int = 4096
    index_key_value: str = "htable"
    index_key_size: int = 20
    index_value_length: int = 1
    index_bloom_filter: int = 0
    sampling_method: str = "uniform"
    sampling_ratio: int = 1
    segment_algorithm: str = "fixed"
    segment_average: int = 1024
    segment_min: int = 128
    segment_max: int = 10240
    selection: str = "top"
    selection_top: int = 1
    prefetching: int = 0
    rewrite_algorithm: str = "no"
    rewrite_buffer: int = 1024
    cfl_switch: bool = False
    cfl_require: float = 0.0
    cfl_usage_threshold: float = 0.0
    cbr_limit: float = 0.0
    cbr_minimal_utility: float = 0.0
    capping_level: int = 0
    har: bool = False
    har_utilization_threshold: float = 0.5
    har_rewrite_limit: float = 0.05
    cache_aware: bool = False
    restore_cache: str = "lru"
    restore_cache_size: int = 1024
    restore_opt_window: int = 1_000_000
    retention: int = -1
    #: Geometry: parameters here, so that small inputs fill more than one container.
    container_data: int = CONTAINER_DATA
    container_entries: int = MAX_ENTRIES

    @property
    def physical(self) -> bool:
        return not self.index_logical

    def resolved(self) -> DedupConfig:
        """With the settings that a preset and a physical index force."""
        cfg = self
        if cfg.index_preset:
            cfg = replace(cfg, **{k: v for k, v in PRESETS[cfg.index_preset].items() if v is not None})
            if cfg.index_preset in RATIO_OF and cfg.sampling_ratio <= 1:
                cfg = replace(cfg, sampling_ratio=RATIO_OF[cfg.index_preset])
        if cfg.physical:
            cfg = replace(cfg, segment_algorithm="fixed")
        if cfg.segment_min > cfg.segment_max:
            raise ConfigError("segment boundary: min exceeds max")
        if cfg.chunk_algorithm in ("rabin", "normalized rabin", "tttd"):
            cfg = replace(cfg, chunk_avg_size=power_of_two(cfg.chunk_avg_size))
        if cfg.chunk_algorithm not in ("fixed", "file") and not cfg.chunk_min_size <= cfg.chunk_avg_size <= cfg.chunk_max_size <= cfg.container_data:
            raise ConfigError("chunk sizes: min <= avg <= max <= container data is asked for")
        return cfg


#: What each published index design fixes; None leaves what is configured.
PRESETS: dict[str, dict] = {
    "ddfs": {"index_exact": True, "index_logical": False, "sampling_method": "uniform", "sampling_ratio": 1, "segment_algorithm": "fixed"},
    "sampled index": {"index_exact": False, "index_logical": False, "sampling_method": "uniform", "segment_algorithm": "fixed"},
    "block locality caching": {"index_exact": True, "index_logical": True, "sampling_method": "uniform", "sampling_ratio": 1, "prefetching": 16},
    "extreme binning": {"index_exact": False, "index_logical": True, "segment_algorithm": "file-defined", "segment_min": 0, "sampling_method": "min", "sampling_ratio": 0, "selection": "top", "selection_top": 1, "prefetching": 1},
    "sparse index": {"index_exact": False, "index_logical": True, "segment_algorithm": "content-defined", "sampling_method": "random", "selection": "top", "prefetching": 1},
    "silo": {"index_exact": False, "index_logical": True, "segment_algorithm": "fixed", "segment_min": 0, "sampling_method": "min", "sampling_ratio": 0, "selection": "top", "selection_top": 1, "prefetching": 16},
}
RATIO_OF = {"sampled index": 128, "sparse index": 128}


def power_of_two(n: int) -> int:
    """The largest power of two that n holds."""
    return 1 << max(int(math.floor(math.log2(n))), 0)


def _one_of(*allowed: str):
    def read(v: str) -> str:
        if v.lower() not in allowed:
            raise ConfigError(f"{v!r} is none of {', '.join(allowed)}")
        return v.lower()

    return read


def _yes(v: str) -> bool:
    if v.lower() not in ("yes", "no"):
        raise ConfigError(f"{v!r} is neither yes nor no")
    return v.lower() == "yes"


def _single(name: str, read):
    return lambda a: {name: read(*_exactly(a, 1))}


def _exactly(a: list[str], *counts: int) -> list[str]:
    if len(a) not in counts:
        raise ConfigError(f"{len(a)} values; {' or '.join(map(str, counts))} asked for")
    return a


def _index(a: list[str]) -> dict:
    _exactly(a, 2, 3)
    out: dict = {"index_exact": _one_of("exact", "near-exact")(a[0]) == "exact", "index_logical": _one_of("physical", "logical")(a[1]) == "logical"}
    out["index_preset"] = _one_of(*PRESETS)(a[2]) if len(a) == 3 else None
    return out


def _sampling(a: list[str]) -> dict:
    _exactly(a, 1, 2)
    return {"sampling_method": _one_of("optmin", "random", "min", "uniform")(a[0]), "sampling_ratio": int(a[1]) if len(a) == 2 else 0}


def _segmenting(a: list[str]) -> dict:
    _exactly(a, 1, 2)
    return {"segment_algorithm": _one_of("fixed", "file-defined", "content-defined")(a[0])} | ({"segment_average": int(a[1])} if len(a) == 2 else {})


def _selection(a: list[str]) -> dict:
    _exactly(a, 1, 2)
    return {"selection": _one_of("base", "top", "mix")(a[0])} | ({"selection_top": int(a[1])} if len(a) == 2 else {})


def _rewriting(a: list[str]) -> dict:
    _exactly(a, 1, 2)
    return {"rewrite_algorithm": _one_of("no", "cfl", "cbr", "cap")(a[0])} | ({"rewrite_buffer": int(a[1])} if len(a) == 2 else {})


def _restoring(a: list[str]) -> dict:
    _exactly(a, 2)
    return {"restore_cache": _one_of("lru", "opt", "asm")(a[0]), "restore_cache_size": int(a[1])}


DIRECTIVES = {
    "working-directory": _single("working_directory", str),
    "simulation-level": _single("simulation_level", _one_of("no", "restore", "append", "all")),
    "trace-format": _single("trace_format", lambda v: "fsl" if v.lower() == "fsl" else "native"),  # any other word: the native text format
    "log-level": _single("log_level", _one_of("debug", "verbose", "notice", "warning")),
    "chunk-algorithm": _single("chunk_algorithm", _one_of("fixed", "rabin", "normalized rabin", "tttd", "file", "ae")),
    "chunk-avg-size": _single("chunk_avg_size", int),
    "chunk-max-size": _single("chunk_max_size", int),
    "chunk-min-size": _single("chunk_min_size", int),
    "fingerprint-index": _index,
    "fingerprint-index-cache-size": _single("index_cache_size", int),
    "fingerprint-index-key-value": _single("index_key_value", _one_of("htable")),
    "fingerprint-index-key-size": _single("index_key_size", int),
    "fingerprint-index-value-length": _single("index_value_length", int),
    "fingerprint-index-bloom-filter": _single("index_bloom_filter", int),
    "fingerprint-index-sampling-method": _sampling,
    "fingerprint-index-segment-algorithm": _segmenting,
    "fingerprint-index-segment-boundary": lambda a: dict(zip(("segment_min", "segment_max"), map(int, _exactly(a, 2)), strict=True)),
    "fingerprint-index-segment-selection": _selection,
    "fingerprint-index-segment-prefetching": _single("prefetching", int),
    "rewrite-algorithm": _rewriting,
    "rewrite-enable-cfl-switch": _single("cfl_switch", _yes),
    "rewrite-cfl-require": _single("cfl_require", float),
    "rewrite-cfl-usage-threshold": _single("cfl_usage_threshold", float),
    "rewrite-cbr-limit": _single("cbr_limit", float),
    "rewrite-cbr-minimal-utility": _single("cbr_minimal_utility", float),
    "rewrite-capping-level": _single("capping_level", int),
    "rewrite-enable-har": _single("har", _yes),
    "rewrite-har-utilization-threshold": _single("har_utilization_threshold", float),
    "rewrite-har-rewrite-limit": _single("har_rewrite_limit", float),
    "rewrite-enable-cache-aware": _single("cache_aware", _yes),
    "restore-cache": _restoring,
    "restore-opt-window-size": _single("restore_opt_window", int),
    "backup-retention-time": _single("retention", int),
}


def parse_line(line: str) -> dict:
    """The settings of one line; none for blanks and comments."""
    try:
        words = shlex.split(line, comments=True)
    except ValueError as e:
        raise ConfigError(f"{line!r}: {e}") from e
    if not words:
        return {}
    read = DIRECTIVES.get(words[0].lower())
    if read is None:
        raise ConfigError(f"unknown directive {words[0]!r}")
    try:
        return read(words[1:])
    except ValueError as e:
        raise ConfigError(f"{words[0]}: {e}") from e


def parse_config(text: str, overrides: tuple[str, ...] = (), base: DedupConfig | None = None) -> DedupConfig:
    """Lines of ``text``, then the overriding lines in their order."""
    out = base or DedupConfig()
    for line in [*text.split("\n"), *overrides]:
        out = replace(out, **parse_line(line))
    return out


def as_rows(cfg: DedupConfig) -> list[tuple[str, str]]:
    return [(f.name, str(getattr(cfg, f.name))) for f in fields(cfg)]


#: Small geometry for small inputs: 64 KiB containers, short segments and buffers.
SMALL = DedupConfig(chunk_algorithm="fixed", chunk_avg_size=64, segment_average=128, segment_min=16, segment_max=512, sampling_ratio=8, rewrite_buffer=64, capping_level=4, restore_cache_size=4, container_data=65536, index_cache_size=16, cfl_usage_threshold=0.03, cfl_require=0.6, cbr_limit=0.05, cbr_minimal_utility=0.5)
