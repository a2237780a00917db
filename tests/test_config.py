import pytest

from chunkloom.config import CONTAINER_DATA, MAX_ENTRIES, PRESETS, ConfigError, DedupConfig, parse_config, parse_line, power_of_two

SAMPLE = """
# every directive once
working-directory "/tmp/work"
simulation-level no
trace-format fsl
log-level NOTICE
chunk-algorithm "Normalized Rabin"
chunk-avg-size 4096
chunk-max-size 65536
chunk-min-size 512
fingerprint-index exact physical
fingerprint-index-key-value htable
fingerprint-index-cache-size 128
fingerprint-index-sampling-method random 128
fingerprint-index-key-size 20
fingerprint-index-value-length 1
fingerprint-index-bloom-filter 20
fingerprint-index-segment-algorithm content-defined 1024
fingerprint-index-segment-boundary 128 10240
fingerprint-index-segment-selection base
fingerprint-index-segment-prefetching 1
rewrite-algorithm no
rewrite-enable-cfl-switch no
rewrite-cfl-require 0.6
rewrite-cfl-usage-threshold 0.03
rewrite-cbr-limit 0.05
rewrite-cbr-minimal-utility 0.5
rewrite-capping-level 14
rewrite-enable-har yes
rewrite-har-utilization-threshold 0.5
rewrite-har-rewrite-limit 0.05
rewrite-enable-cache-aware no
restore-cache lru 30
restore-opt-window-size 1000000
backup-retention-time -1
"""


def test_geometry():
    assert (CONTAINER_DATA, MAX_ENTRIES) == (4_161_536, 1169)


def test_every_directive():
    cfg = parse_config(SAMPLE, ("restore-cache opt 64", "Rewrite-Algorithm cbr 512"))
    assert (cfg.chunk_algorithm, cfg.index_exact, cfg.index_logical, cfg.sampling_method, cfg.sampling_ratio) == ("normalized rabin", True, False, "random", 128)
    assert (cfg.restore_cache, cfg.restore_cache_size, cfg.rewrite_algorithm, cfg.rewrite_buffer, cfg.har) == ("opt", 64, "cbr", 512, True)
    assert (cfg.segment_min, cfg.segment_max, cfg.selection, cfg.trace_format) == (128, 10240, "base", "fsl")
    assert cfg.resolved().segment_algorithm == "fixed"  # a physical index needs no other


@pytest.mark.parametrize("line", ["no-such-thing 1", "chunk-avg-size", "chunk-avg-size 1 2", "chunk-algorithm cubes", 'chunk-algorithm "rabin', "log-level loud", "fingerprint-index exact", "rewrite-enable-har maybe", "chunk-avg-size big"])
def test_bad_lines(line):
    with pytest.raises(ConfigError):
        parse_line(line)


def test_defaults_and_omitted_values():
    assert parse_line("") == parse_line("# only this") == {}
    assert parse_line("fingerprint-index-sampling-method min") == {"sampling_method": "min", "sampling_ratio": 0}
    assert parse_config("") == DedupConfig()


def test_presets():
    for name in PRESETS:
        cfg = parse_config(f'fingerprint-index exact physical "{name}"').resolved()
        assert cfg.index_exact == PRESETS[name]["index_exact"] and cfg.index_logical == PRESETS[name]["index_logical"]
    assert parse_config('fingerprint-index near-exact logical "sparse index"').resolved().sampling_ratio == 128
    assert parse_config('fingerprint-index near-exact logical "extreme binning"').resolved().segment_algorithm == "file-defined"


def test_sizes_are_checked():
    assert [power_of_two(n) for n in (1, 2, 3, 4095, 4096)] == [1, 2, 2, 2048, 4096]
    with pytest.raises(ConfigError):
        DedupConfig(chunk_avg_size=512).resolved()
    with pytest.raises(ConfigError):
        DedupConfig(segment_min=9, segment_max=3).resolved()
