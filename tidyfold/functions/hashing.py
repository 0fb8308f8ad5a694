"""Deterministic hashes and draws.

Every draw is a function of (seed, ids), so it does not depend on the
partitioning and a lost executor redraws the same numbers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# 15 hex digits: the widest prefix that stays a positive bigint.
DIGITS = 15
SPAN = float(16**DIGITS)


def md5_hex(*parts) -> Column:
    """The first 15 hex digits of md5 over the parts joined by ':'."""
    return F.substring(F.md5(F.concat_ws(":", *[_text(p) for p in parts])), 1, DIGITS)


def md5_hash(*parts) -> Column:
    """`md5_hex` as a bigint in [0, 16^15)."""
    return F.conv(md5_hex(*parts), 16, 10).cast("bigint")


def _text(part) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


@F.pandas_udf(T.StringType())
def _blake2b_hex(text: pd.Series) -> pd.Series:
    return text.map(lambda s: hashlib.blake2b(s.encode(), digest_size=8).hexdigest())


def salted_hex(salt: str, case: Column, hash_fn: str = "blake2b") -> Column:
    """Fixed-width hex hash of `salt:case`; its text order is the unsigned number's order."""
    if hash_fn == "blake2b":
        return _blake2b_hex(F.concat_ws(":", F.lit(salt), case.cast("string")))
    if hash_fn == "md5":
        return md5_hex(salt, case)
    raise ValueError(f"unknown hash_fn {hash_fn!r}; expected 'blake2b' or 'md5'")


def hex_number(text: Column) -> Column:
    """A hex hash as an exact unsigned number (Spark has no unsigned bigint)."""
    return F.conv(text, 16, 10).cast("decimal(20,0)")


def draw(seed: int, *ids, hash_fn: str = "xxhash64") -> Column:
    """A bigint in [0, 2^53) or [0, 16^15) drawn from (seed, ids)."""
    if hash_fn == "md5":
        return md5_hash(seed, *ids)
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *ids), 11)


def uniform(seed: int, *ids, hash_fn: str = "xxhash64", drawn: Column | None = None) -> Column:
    """A double in [0, 1) drawn from (seed, ids); `drawn` is that `draw` where it was made before."""
    span = SPAN if hash_fn == "md5" else float(2**53)
    return (draw(seed, *ids, hash_fn=hash_fn) if drawn is None else drawn).cast("double") / F.lit(span)


def choice(seed: int, n: Column, *ids, hash_fn: str = "xxhash64", drawn: Column | None = None) -> Column:
    """An integer in [0, n) drawn from (seed, ids); null where n is 0. `drawn` is that `draw` where it was made before."""
    return F.when(n > 0, F.pmod(draw(seed, *ids, hash_fn=hash_fn) if drawn is None else drawn, F.when(n > 0, n)))


#: md5's shifts and constants by round, messages hashed at once, and those from which on numpy is quicker than one after another.
_SHIFTS = np.array([7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4, np.uint32)
_SINES = [int(x) for x in np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32)]
_AT_ONCE, _MANY = 1 << 14, 600


def _md5_words(prefix: bytes, numbers: np.ndarray, digits: int) -> list:
    """The 16 words of the padded messages `prefix` + i, for numbers i of as many digits; a word that all share is one number."""
    at, size = len(prefix), len(prefix) + digits
    block = np.zeros(64, np.uint8)
    block[:at] = np.frombuffer(prefix, np.uint8)
    block[size], block[56], block[57] = 0x80, size * 8 & 255, size * 8 >> 8
    words = list(block.view("<u4"))
    left = numbers.astype(np.uint32 if digits < 10 else np.uint64)
    for place in range(size - 1, at - 1, -1):
        rest = left // left.dtype.type(10)
        digit = (left - rest * left.dtype.type(10)).astype(np.uint32) + np.uint32(48)
        words[place // 4] = words[place // 4] | digit << np.uint32(8 * (place % 4))
        left = rest
    return words


def _md5_block(words: list, n: int) -> np.ndarray:
    """`md5_hash` of n messages of one block each."""
    start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(n, x) for x in start)
    t, u = np.empty_like(a), np.empty_like(a)
    for r in range(64):
        if r < 32:  # a choice by bits between two words
            x, y, z, word = (b, c, d, r) if r < 16 else (d, b, c, (5 * r + 1) % 16)
            np.bitwise_xor(y, z, out=t)
            t &= x
            t ^= z
        elif r < 48:
            word = (3 * r + 5) % 16
            np.bitwise_xor(b, c, out=t)
            t ^= d
        else:
            word = 7 * r % 16
            np.invert(d, out=t)
            t |= b
            t ^= c
        t += a
        if isinstance(words[word], np.ndarray):
            t += words[word]
            t += np.uint32(_SINES[r])
        else:
            t += np.uint32((int(words[word]) + _SINES[r]) & 0xFFFFFFFF)
        np.right_shift(t, 32 - _SHIFTS[r], out=u)
        t <<= _SHIFTS[r]
        t |= u
        t += b
        a, d, c, b, t = d, c, b, t, a
    high, low = (a + start[0]).byteswap().astype(np.uint64), (b + start[1]).byteswap()
    return ((high << np.uint64(32) | low) >> np.uint64(4)).astype(np.int64)


def _md5_each(texts) -> np.ndarray:
    """`md5_hash` of byte strings, one after another."""
    return (np.frombuffer(b"".join(hashlib.md5(x).digest() for x in texts), ">u8")[::2] >> np.uint64(4)).astype(np.int64)


def md5_at(prefix: str, numbers: np.ndarray) -> np.ndarray:
    """`md5_hash` of `prefix` + i for each of the numbers i from 0 on, as int64; one pass of numpy over many messages."""
    raw, out = prefix.encode(), np.empty(len(numbers), np.int64)
    for lo in range(0, len(numbers), _AT_ONCE):
        part, found = numbers[lo : lo + _AT_ONCE], out[lo : lo + _AT_ONCE]
        least, most = len(str(part.min())), len(str(part.max()))
        for digits in range(least, most + 1):
            mine = slice(None) if least == most else np.flatnonzero((part < 10**digits) & (part >= (10 ** (digits - 1) if digits > 1 else 0)))
            own = part[mine]
            if len(own) < _MANY or len(raw) + digits > 55:
                found[mine] = _md5_each(raw + b"%d" % i for i in own.tolist())
            else:
                found[mine] = _md5_block(_md5_words(raw, own, digits), len(own))
    return out


def md5_table(prefixes: list[str], suffixes: list[str]) -> np.ndarray:
    """`md5_hash` of each prefix with each suffix, as int64 rows by prefix."""
    tails, heads = [x.encode() for x in suffixes], [x.encode() for x in prefixes]
    sizes = np.array([len(x) for x in tails])
    width = int(sizes.max()) + 1
    tail = np.frombuffer(b"".join((x + b"\x80").ljust(width, b"\0") for x in tails), np.uint8).reshape(len(tails), width)
    out = np.empty((len(heads), len(tails)), np.int64)
    lengths, step = np.array([len(x) for x in heads]), max(1, _AT_ONCE // len(tails))
    for at in np.unique(lengths).tolist():
        alike = np.flatnonzero(lengths == at)
        for lo in range(0, len(alike), step):
            mine = alike[lo : lo + step]
            if at + width > 56:
                out[mine] = _md5_each(heads[i] + x for i in mine for x in tails).reshape(len(mine), -1)
                continue
            block = np.zeros((len(mine), len(tails), 64), np.uint8)
            block[:, :, :at] = np.frombuffer(b"".join(heads[i] for i in mine), np.uint8).reshape(len(mine), 1, at)
            block[:, :, at : at + width] = tail
            block[:, :, 56], block[:, :, 57] = (at + sizes) * 8 & 255, (at + sizes) * 8 >> 8
            words = block.reshape(-1, 64).view("<u4").T.copy()
            used = [w if k * 4 < at + width or k == 14 else np.uint32(0) for k, w in enumerate(words)]
            out[mine] = _md5_block(used, words.shape[1]).reshape(len(mine), -1)
    return out


def md5_ids(prefix: str, ids: pa.Array) -> np.ndarray:
    """`md5_hash` of the parts that `prefix` joins (with a colon at its end) and each id, a whole number or text; a null id is left out as it is there."""
    if pa.types.is_integer(ids.type) and not ids.null_count:
        numbers = np.asarray(ids)
        if not len(numbers) or numbers.min() >= 0:
            return md5_at(prefix, numbers)
    return _md5_each((prefix[:-1] if x is None else f"{prefix}{x}").encode() for x in ids.to_pylist())


def md5_numbers(prefix: str, first: int, last: int) -> np.ndarray:
    """`md5_hash` of `prefix` + i for each i in [first, last), as int64; messages of one block only."""
    if last > first and len(prefix.encode()) + len(str(last - 1)) > 55:
        raise ValueError(f"{prefix!r} and a number of {len(str(last - 1))} digits are over one block of md5")
    return md5_at(prefix, np.arange(first, max(first, last)))
