"""Scalar functions on fingerprints, segment ids and ratios: built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CONTAINER_BYTES, ENTRY_BYTES


def fingerprint(data: Column) -> Column:
    """SHA-1 of a chunk's bytes, 20 bytes."""
    return F.unhex(F.sha1(data))


def encode_hex(fp: Column) -> Column:
    """40 upper-case digits."""
    return F.hex(fp)


def decode_hex(code: Column) -> Column:
    """Either case."""
    return F.unhex(code)


def feature_key(fp: Column, key_size: int) -> Column:
    return F.substring(fp, 1, key_size)


def tail(fp: Column) -> Column:
    """The last four bytes as a little-endian unsigned number (only its remainders are used, so the sign doesn't matter)."""
    byte = [F.hex(F.substring(fp, 17 + i, 1)) for i in range(4)]
    return F.conv(F.concat(*reversed(byte)), 16, 10).cast("bigint")


def is_zero(data: Column) -> Column:
    """A chunk of zero bytes only; an empty one is none."""
    return (F.octet_length(data) > 0) & F.hex(data).rlike("^0*$")


def segment_id(bv: Column, offset: Column, chunks: Column) -> Column:
    """version << 48 | recipe offset << 16 | chunks."""
    return F.shiftleft(bv.cast("bigint"), 48) + F.shiftleft(offset.cast("bigint"), 16) + chunks.cast("bigint")


def segment_version(sid: Column) -> Column:
    return F.shiftright(sid, 48)


def segment_offset(sid: Column) -> Column:
    return F.shiftright(sid, 16).bitwiseAND(F.lit((1 << 32) - 1))


def segment_size(sid: Column) -> Column:
    return sid.bitwiseAND(F.lit(0xFFFF))


def dedup_ratio(data: Column, stored: Column) -> Column:
    return F.when(data != 0, (data - stored) / data).otherwise(F.lit(0.0))


def dedup_factor(data: Column, stored: Column) -> Column:
    return F.when(stored != 0, data / stored)


def rewrite_ratio(data: Column, rewritten: Column) -> Column:
    return F.when(data != 0, rewritten / data).otherwise(F.lit(0.0))


def speed_factor(data: Column, containers: Column) -> Column:
    """MiB restored for each container that is read."""
    return F.when(containers != 0, data / (F.lit(1048576.0) * containers))


def fragmentation_level(data: Column, chunks: Column, reads: Column) -> Column:
    """Chunk fragmentation: containers at best over containers read, 1 at most."""
    best = F.ceil((data + ENTRY_BYTES * chunks) / F.lit(float(CONTAINER_BYTES)))
    return F.when(reads != 0, F.least(F.lit(1.0), best / reads))


def utilization(size: Column, container_data: int) -> Column:
    return size / F.lit(float(container_data))


def rewrite_utility(covered: Column, size: Column, container_data: int) -> Column:
    """1 - the share of the container that the look-ahead buffer uses (the chunk's own size counts twice: a fixed rule)."""
    return F.greatest(F.lit(0.0), 1 - (covered + size) / F.lit(float(container_data)))


def write_predicate(is_dup: Column, denied: Column, sparse: Column, out_of_order: Column, in_cache: Column, switch: Column) -> Column:
    """Whether a chunk is written: new ones, and duplicates marked for rewriting."""
    return ~is_dup | (~denied & (sparse | (switch & out_of_order & ~in_cache)))


def state_bits(**marks: Column) -> Column:
    """The marks as the bitmask of exported chunk states."""
    from ..schema import FLAGS

    out = F.lit(0)
    for name, column in marks.items():
        out = out.bitwiseOR(F.when(column, F.lit(FLAGS[name])).otherwise(F.lit(0)))
    return out


def throughput(size: Column, seconds: Column) -> Column:
    """MiB a second; null where no time passed."""
    return F.when(seconds > 0, size / (F.lit(1048576.0) * seconds))


def power_of_two(n: Column) -> Column:
    """The largest power of two that n > 0 holds; 1 for anything smaller. Read off the binary digits, so that no logarithm rounds."""
    return F.when(n > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.length(F.bin(n)) - 1)).otherwise(F.lit(1).cast("bigint"))


def yes_no(text: Column) -> Column:
    """true for yes, false for no, in any case; null for anything else."""
    return F.when(F.lower(text) == "yes", True).when(F.lower(text) == "no", False)
