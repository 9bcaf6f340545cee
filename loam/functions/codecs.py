"""Binary codecs and checksums of the log format, as plain functions and as pandas functions for columns."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

MASK = (1 << 64) - 1


class Corruption(ValueError):
    """Bytes that do not decode."""


def put_varint(v: int) -> bytes:
    if not 0 <= v <= MASK:
        raise ValueError("out of range")
    out = bytearray()
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    return bytes([*out, v])


def get_varint(raw: bytes, at: int = 0, bits: int = 64) -> tuple[int, int]:
    """(value, place after it); truncated or over-long input is corruption."""
    v = 0
    for k in range(-(-bits // 7)):
        if at + k >= len(raw):
            break
        v |= (raw[at + k] & 127) << 7 * k
        if raw[at + k] < 128:
            if v >> bits:
                break
            return v, at + k + 1
    raise Corruption("bad varint")


def put_slice(raw: bytes) -> bytes:
    return put_varint(len(raw)) + raw


def get_slice(raw: bytes, at: int = 0) -> tuple[bytes, int]:
    n, at = get_varint(raw, at, 32)
    if at + n > len(raw):
        raise Corruption("truncated slice")
    return raw[at : at + n], at + n


def internal_key(user_key: bytes, seq: int, vtype: int) -> bytes:
    return user_key + struct.pack("<Q", seq << 8 | vtype)


def parsed_key(raw: bytes) -> tuple[bytes, int, int]:
    if len(raw) < 8:
        raise Corruption("short internal key")
    (tail,) = struct.unpack("<Q", raw[-8:])
    if tail & 255 > 1:
        raise Corruption("unknown type")
    return raw[:-8], tail >> 8, tail & 255


def encoded_batch(seq: int, ops: list[tuple[bytes, bytes | None]]) -> bytes:
    """Operations (key, value or None for a delete) as one record."""
    return struct.pack("<QI", seq, len(ops)) + b"".join(b"\0" + put_slice(k) if v is None else b"\1" + put_slice(k) + put_slice(v) for k, v in ops)


def decoded_batch(raw: bytes) -> tuple[int, list[tuple[bytes, bytes | None]]]:
    """Checked whole before anything is used: tags, lengths, count, no trailing bytes."""
    if len(raw) < 12:
        raise Corruption("short batch")
    seq, count = struct.unpack_from("<QI", raw)
    at, ops = 12, []
    while at < len(raw):
        tag = raw[at]
        if tag > 1:
            raise Corruption("unknown tag")
        key, at = get_slice(raw, at + 1)
        value = None
        if tag:
            value, at = get_slice(raw, at)
        ops.append((key, value))
    if len(ops) != count:
        raise Corruption("wrong count")
    return seq, ops


def _crc_table(poly: int = 0x82F63B78) -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(poly), t >> 1)
    return t


_CRC = _crc_table().tolist()


def crc32c(raw: bytes, before: int = 0) -> int:
    c = before ^ 0xFFFFFFFF
    for b in raw:
        c = _CRC[(c ^ b) & 255] ^ c >> 8
    return c ^ 0xFFFFFFFF


def masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def unmasked(m: int) -> int:
    r = (m - 0xA282EAD8) & 0xFFFFFFFF
    return (r >> 17 | r << 15) & 0xFFFFFFFF


def key_hash(raw: bytes) -> int:
    """FNV-1a over the bytes, finished by the mixer of SplitMix64."""
    h = 14695981039346656037
    for b in raw:
        h = (h ^ b) * 1099511628211 & MASK
    return mixed(h)


def mixed(z: int) -> int:
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & MASK
    z = (z ^ z >> 27) * 0x94D049BB133111EB & MASK
    return z ^ z >> 31


def split_mix(seed: int, n: int) -> np.ndarray:
    """The first n numbers of the SplitMix64 sequence of a seed."""
    with np.errstate(over="ignore"):
        z = np.uint64(seed) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


# Probes and bits a key of a Bloom filter.
PROBES, BITS_A_KEY = 7, 10


def _probe_bits(raw: bytes, size: int) -> list[int]:
    h = key_hash(raw)
    first, step = h & 0xFFFFFFFF, h >> 32 | 1
    return [(first + i * step & 0xFFFFFFFF) % size for i in range(PROBES)]


def bloom(keys: list[bytes]) -> bytes:
    size = -(-max(64, len(keys) * BITS_A_KEY) // 64) * 64
    bits = np.zeros(size, np.uint8)
    for k in keys:
        bits[_probe_bits(k, size)] = 1
    return bytes([PROBES]) + np.packbits(bits, bitorder="little").tobytes()


def may_contain(filter_: bytes, key: bytes) -> bool:
    if len(filter_) < 9 or (len(filter_) - 1) % 8 or filter_[0] != PROBES:
        raise Corruption("invalid Bloom filter")
    return all(filter_[1 + b // 8] >> b % 8 & 1 for b in _probe_bits(key, (len(filter_) - 1) * 8))


def separator(low: bytes, high: bytes) -> bytes:
    """A short key in [low, high)."""
    n = common_prefix(low, high)
    if n < min(len(low), len(high)) and low[n] < 255 and low[n] + 1 < high[n]:
        return low[:n] + bytes([low[n] + 1])
    return low


def successor(key: bytes) -> bytes:
    """A short key at or above key."""
    for i, b in enumerate(key):
        if b != 255:
            return key[:i] + bytes([b + 1])
    return key


def common_prefix(a: bytes, b: bytes) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def varint_column(c: Column) -> Column:
    """Varint bytes of a non-negative bigint; no Python."""
    sevens = F.sequence(F.lit(0), F.floor((F.greatest(F.length(F.bin(c)), F.lit(1)) - 1) / 7).cast("int"))
    last = F.size(sevens) - 1

    def one(i: Column) -> Column:
        part = F.call_function("shiftrightunsigned", c, i * 7).bitwiseAND(F.lit(127))
        return F.lpad(F.hex(part + F.when(i < last, 128).otherwise(0)), 2, "0")

    return F.when(c.isNotNull(), F.unhex(F.array_join(F.transform(sevens, one), "")))


def varint_value(raw: Column) -> Column:
    """The number of a varint cell (of up to nine bytes); null where the bytes are no varint."""
    pairs = F.regexp_extract_all(F.hex(raw), F.lit("(..)"), F.lit(1))
    numbers = F.transform(pairs, lambda p: F.conv(p, 16, 10).cast("long"))
    whole = F.size(pairs).between(1, 9) & F.forall(F.slice(numbers, 1, F.size(pairs) - 1), lambda b: b > 127) & (F.element_at(numbers, -1) < 128)
    value = F.aggregate(F.reverse(numbers), F.lit(0).cast("long"), lambda acc, b: acc * 128 + b.bitwiseAND(F.lit(127)))
    return F.when((F.length(raw) > 0) & whole, value)


def fixed64_value(raw: Column) -> Column:
    """The number of eight little-endian bytes (below 2**63); null for other lengths."""
    turned = F.concat(*(F.substring(F.hex(raw), 15 - 2 * k, 2) for k in range(8)))
    return F.when(F.length(raw) == 8, F.conv(turned, 16, 10).cast("long"))


def crc32c_batch(cells: list[bytes]) -> np.ndarray:
    """CRC-32C of many cells at once: a step a byte position, over the cells that are that long."""
    size = np.array([len(x) for x in cells], np.int64)
    order = np.argsort(-size, kind="stable")
    flat, start = np.frombuffer(b"".join(cells), np.uint8), np.cumsum(size) - size
    c, table = np.full(len(cells), 0xFFFFFFFF, np.uint32), np.array(_CRC, np.uint32)
    longest_first, left = start[order], -size[order]
    for k in range(int(size.max(initial=0))):
        n = int(np.searchsorted(left, -k, side="left"))  # cells of more than k bytes
        c[:n] = table[(c[:n] ^ flat[longest_first[:n] + k]) & np.uint32(255)] ^ c[:n] >> np.uint32(8)
    out = np.empty(len(cells), np.uint32)
    out[order] = c ^ np.uint32(0xFFFFFFFF)
    return out


def crc32c_column(c: Column) -> Column:
    @F.pandas_udf("long")
    def f(v: pd.Series) -> pd.Series:
        there = v.notna()
        out = pd.Series(pd.NA, index=v.index, dtype="Int64")
        out[there] = crc32c_batch([bytes(x) for x in v[there]]).astype(np.int64)
        return out

    return f(c)


def fixed64_column(c: Column) -> Column:
    """Little-endian bytes of a non-negative bigint; no Python."""
    return F.unhex(F.concat(*(F.substring(F.lpad(F.hex(c), 16, "0"), 15 - 2 * k, 2) for k in range(8))))


def internal_key_column(user_key: Column, seq: Column, vtype: Column) -> Column:
    return F.concat(user_key.cast("binary"), fixed64_column(seq * 256 + vtype))
