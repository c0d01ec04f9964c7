"""Scalar helpers: probabilities, identifiers, hashing and checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def score_at_least(threshold: float, strict: bool = False, column: str = "score") -> Column:
    """Score filter whose comparator (``>=`` or ``>``) is chosen by the caller."""
    return F.col(column) > threshold if strict else F.col(column) >= threshold


def patient_of(case_id: Column) -> Column:
    return F.split(case_id, "_").getItem(0)


def case_from_path(path: Column, suffix: str = r"(_\d{4})?\.[^/]+$") -> Column:
    """File name without folder, modality suffix and extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), suffix, "")


def modality_from_path(path: Column) -> Column:
    digits = F.regexp_extract(path, r"_(\d{4})\.[^/]+$", 1)
    return F.when(digits != "", digits.cast("long"))


def config_from_path(path: Column, full_names: Sequence[str] = ("full",)) -> Column:
    """Run configuration by ordered keyword tests on the parent folder name.

    ``full_names`` are the keywords that stand for the full configuration; a project adds its own.
    """
    full = reduce(lambda a, b: a | b, [F.lower(F.regexp_extract(path, r"([^/]+)/[^/]*$", 1)).contains(n) for n in full_names])
    parent = F.lower(F.regexp_extract(path, r"([^/]+)/[^/]*$", 1))
    return (
        F.when(parent.contains("baseline"), "baseline")
        .when(parent.contains("lff"), "lff")
        .when(parent.contains("caf") & ~parent.contains("full"), "caf")
        .when(full, "full")
        .otherwise(parent)
    )


def argmax_grade(probs: Column, first_grade: int = 2) -> Column:
    """Grade of the largest probability; the first maximum wins."""
    return (F.array_position(probs, F.array_max(probs)) + F.lit(first_grade - 1)).cast("long")


def temperature_scale(probs: Column, temperature: Column, floor: float = 1e-7) -> Column:
    """Softmax of ``log(p) / T`` with the probabilities clipped to ``[floor, 1]``."""
    logits = F.transform(
        probs, lambda p: F.log(F.greatest(F.lit(floor), F.least(p, F.lit(1.0)))) / temperature
    )
    peak = F.array_max(logits)
    exps = F.transform(logits, lambda v: F.exp(v - peak))
    norm = F.aggregate(exps, F.lit(0.0), lambda a, v: a + v)
    return F.transform(exps, lambda v: v / norm)


def ordinal_class_probs(logits: Column) -> Column:
    """Class probabilities from cumulative ordinal logits (P(y > k)).

    Differences that come out negative are clamped to 0 and the rest renormalised.
    """
    above = F.transform(logits, lambda v: F.lit(1.0) / (F.lit(1.0) + F.exp(-v)))
    left = F.concat(F.array(F.lit(1.0)), above)
    right = F.concat(above, F.array(F.lit(0.0)))
    raw = F.zip_with(left, right, lambda a, b: F.greatest(a - b, F.lit(0.0)))
    norm = F.aggregate(raw, F.lit(0.0), lambda a, v: a + v)
    return F.transform(raw, lambda v: v / norm)


def ordinal_clamp_count(logits: Column) -> Column:
    """How many adjacent cumulative probabilities were out of order."""
    n = F.size(logits)
    drops = F.zip_with(
        F.slice(logits, F.lit(1), n - 1), F.slice(logits, F.lit(2), n - 1), lambda a, b: b > a
    )
    return F.size(F.filter(drops, lambda d: d)).cast("long")


def draw(*parts: Column) -> Column:
    """Reproducible pseudo-random integer of 60 bits from columns.

    The leading bits of a digest of the parts: replayable in any SQL engine, independent of
    partitioning and of retries, and wide enough that ``draw % n`` reaches all of a pool.
    """
    text = F.concat_ws("|", F.lit("2026"), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def draw_sql(*parts: str) -> str:
    """The SQL text of :func:`draw`."""
    return f"(('0x' || substr(md5(concat_ws('|', '2026', {', '.join(f'({p})::VARCHAR' for p in parts)})), 1, 15))::BIGINT)"


_ADD = [int(v) for v in np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32)]
_TURN = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]


def draws(b: int, n: int) -> np.ndarray:
    """``draw(b, j)`` for all j below ``n``, worked out on arrays and outside of Spark."""
    prefix = f"2026|{b}|".encode()
    edges = sorted({*range(0, n, 16_384), *(e for d in range(1, 19) if (e := 10**d) < n), n})
    return np.concatenate([_draws_between(prefix, lo, hi) for lo, hi in zip(edges, edges[1:])] or [np.empty(0, np.int64)])


def _draws_between(prefix: bytes, lo: int, hi: int) -> np.ndarray:
    """The leading 60 bits of the MD5 of ``prefix`` and j, for j from ``lo`` to ``hi``, which have equally many digits."""
    digits, j = len(str(lo)), np.arange(lo, hi)
    start, end = len(prefix), len(prefix) + digits
    text = np.zeros((64, hi - lo), np.uint8)
    text[:start] = np.frombuffer(prefix, np.uint8)[:, None]
    for i in range(digits):
        text[start + i] = j // 10 ** (digits - 1 - i) % 10 + ord("0")
    text[end] = 0x80
    text[56] = end * 8 % 256
    text[57] = end * 8 // 256
    words = np.ascontiguousarray(text.reshape(16, 4, -1).transpose(0, 2, 1)).view("<u4")[..., 0]
    a, b, c, d = first = [np.full(hi - lo, v, np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        # words without a digit are the same in all messages
        if start // 4 <= g <= end // 4:
            f = f + a + words[g] + np.uint32(_ADD[i])
        else:
            f = f + a + np.uint32((_ADD[i] + int(words[g, 0])) % 2**32)
        a, d, c, b = d, c, b, b + ((f << np.uint32(_TURN[i])) | (f >> np.uint32(32 - _TURN[i])))
    high, low = ((x + y).byteswap().astype(np.int64) for x, y in ((a, first[0]), (b, first[1])))
    return high << 28 | low >> 4
