"""Exact integer arithmetic as Column expressions: micro-units (SCALE) in BIGINT, never floats."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE = 1_000_000
LN2_NANOS = 693_147_181
#: Confidence: absent means full; defaults of decay.
FULL, HALF_LIFE, DECAY_WEIGHT, PRUNE_FLOOR = SCALE, 90 * 86_400, 200_000, 250_000


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x).cast("long")


def div(a, b) -> Column:
    """Integer division that truncates toward zero."""
    return F.call_function("div", col(a), col(b))


def mul_div_round(a, b, c) -> Column:
    """(a * b + c / 2) / c for non-negative numbers, with a product of up to 38 digits."""
    return div(col(a).cast("decimal(19,0)") * col(b) + div(c, 2), c)


def ln_micros(num, den) -> Column:
    """ln(num / den) in micro-units: num / den = 2^k (1 + z) / (1 - z), twelve terms of the series of atanh z in nano-units."""
    pair = F.struct(col(num).alias("n"), col(den).alias("d"), F.lit(0).cast("long").alias("k"))
    fold = F.aggregate(F.sequence(F.lit(1), F.lit(62)), pair, lambda s, _: F.when(s.n >= 2 * s.d, F.struct(s.n.alias("n"), (s.d * 2).alias("d"), (s.k + 1).alias("k"))).when(s.n < s.d, F.struct((s.n * 2).alias("n"), s.d.alias("d"), (s.k - 1).alias("k"))).otherwise(s))
    start = lambda s: div((s.n - s.d) * 1_000_000_000 + div(s.n + s.d, 2), s.n + s.d)
    series = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.lit(11).cast("long")),
        F.transform(F.array(fold), lambda s: F.struct(s.k.alias("k"), start(s).alias("t"), start(s).alias("s"), div(start(s) * start(s) + 500_000_000, 1_000_000_000).alias("q")))[0],
        lambda a, i: F.transform(F.array(div(a.t * a.q + 500_000_000, 1_000_000_000)), lambda t: F.struct(a.k.alias("k"), t.alias("t"), (a.s + div(t + div(2 * i + 1, 2), 2 * i + 1)).alias("s"), a.q.alias("q")))[0],
        lambda a: a.k * LN2_NANOS + 2 * a.s,
    )
    return F.transform(F.array(series), lambda x: div(x + F.when(x >= 0, 500).otherwise(-500), 1000))[0]


def isqrt(x) -> Column:
    """Floor of the square root, exact up to 2^52."""
    return F.floor(F.sqrt(col(x).cast("double"))).cast("long")


def cosine_micros(dot, norm_a, norm_b) -> Column:
    """Cosine from an integer dot product and two squared norms; 0 where the dot is not positive, 1 at most."""
    d = col(dot).cast("decimal(19,0)")
    ratio = div(d * d * F.lit(1_000_000_000_000).cast("decimal(13,0)"), col(norm_a) * col(norm_b))
    return F.when((col(dot) <= 0) | (col(norm_a) <= 0) | (col(norm_b) <= 0), F.lit(0).cast("long")).otherwise(F.least(isqrt(ratio), F.lit(SCALE).cast("long")))


def jaccard_micros(a: Column, b: Column) -> Column:
    """Shared over all distinct elements of two arrays; 0 where both are empty."""
    union = F.size(F.array_union(a, b)).cast("long")
    return F.when(union == 0, F.lit(0).cast("long")).otherwise(div(F.size(F.array_intersect(a, b)).cast("long") * SCALE, union))


def decayed(base, last_used, now, half_life) -> Column:
    """Confidence after `now - last_used` seconds: halved for each whole half-life, linear within one."""
    base, gone, life = F.least(F.greatest(col(base), F.lit(0).cast("long")), F.lit(FULL).cast("long")), col(now) - col(last_used), col(half_life)
    whole, part = div(gone, F.greatest(life, F.lit(1).cast("long"))), gone % F.greatest(life, F.lit(1).cast("long"))
    value = F.call_function("shiftright", base, F.least(whole, F.lit(63).cast("long")).cast("int"))
    inner = F.when(whole >= 63, F.lit(0).cast("long")).when(part > 0, div(value * (2 * life - part), 2 * life)).otherwise(value)
    return F.when((life <= 0) | (gone <= 0), base).otherwise(inner)


def decay_penalty(confidence, weight=DECAY_WEIGHT) -> Column:
    return div(col(weight) * (FULL - col(confidence)), FULL)


def render_micros(x) -> Column:
    """Two decimals, cut off."""
    x = col(x)
    return F.concat(F.when((x < 0) & (x > -SCALE), F.lit("0")).otherwise(div(x, SCALE).cast("string")), F.lit("."), F.lpad(div(F.abs(x % SCALE), SCALE // 100).cast("string"), 2, "0"))


def render_score(x) -> Column:
    """Three decimals, half up."""
    y = div(col(x) + 500, 1000)
    return F.concat(div(y, 1000).cast("string"), F.lit("."), F.lpad((y % 1000).cast("string"), 3, "0"))


FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a64_many(values: list[bytes]) -> np.ndarray:
    """FNV-1a of many strings at once: one step for each byte position, over all strings that are that long."""
    size = np.array([len(v) for v in values], np.int64)
    order = np.argsort(-size, kind="stable")
    buf = np.frombuffer(b"".join(values), np.uint8).astype(np.uint64)
    at = (np.cumsum(size) - size)[order]
    h, longest = np.full(len(values), FNV_BASIS, np.uint64), int(size.max()) if len(values) else 0
    active = np.searchsorted(-size[order], -np.arange(longest))  # strings longer than each position
    for p in range(longest):
        k = active[p]
        h[:k] = (h[:k] ^ buf[at[:k] + p]) * np.uint64(FNV_PRIME)
    out = np.empty_like(h)
    out[order] = h
    return out


def _fnv_hex(s: pd.Series) -> pd.Series:
    known = s.notna()
    out = pd.Series([None] * len(s), dtype=object)
    out[known.to_numpy()] = [f"{int(x):016x}" for x in fnv1a64_many([v.encode() for v in s[known]])]
    return out


fnv1a64_hex = F.pandas_udf(_fnv_hex, T.StringType())


def fnv1a64_hex_native(s: Column) -> Column:
    """The same for short strings without leaving the JVM: two 32-bit halves, folded over the bytes."""
    low = 0xFFFFFFFF
    digits = F.hex(F.encode(s, "utf-8"))
    count = F.octet_length(s)
    places = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(FNV_BASIS >> 32).cast("long").alias("h"), F.lit(FNV_BASIS & low).cast("long").alias("l"))

    def step(a, i):
        x = a.l.bitwiseXOR(F.conv(F.substr(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("long"))
        mixed = x * 435
        high = (a.h * 435 + F.call_function("shiftright", mixed, F.lit(32)) + F.call_function("shiftleft", x, F.lit(8))).bitwiseAND(F.lit(low).cast("long"))
        return F.struct(high.alias("h"), mixed.bitwiseAND(F.lit(low).cast("long")).alias("l"))

    return F.aggregate(places, start, step, lambda a: F.lower(F.concat(F.lpad(F.hex(a.h), 8, "0"), F.lpad(F.hex(a.l), 8, "0"))))


def parse_rfc3339(s) -> Column:
    """Epoch seconds of exactly YYYY-MM-DDTHH:MM:SSZ; null for any other form or a date that doesn't exist."""
    s = col(s)
    good = s.rlike(r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]Z$")
    day = F.call_function("try_to_date", F.substr(s, F.lit(1), F.lit(10)), F.lit("yyyy-MM-dd"))
    clock = F.substr(s, F.lit(12), F.lit(2)).cast("long") * 3600 + F.substr(s, F.lit(15), F.lit(2)).cast("long") * 60 + F.substr(s, F.lit(18), F.lit(2)).cast("long")
    return F.when(good, F.unix_date(day).cast("long") * 86_400 + clock)


def format_rfc3339(x) -> Column:
    """Epoch seconds as YYYY-MM-DDTHH:MM:SSZ, whatever the session's time zone."""
    x = col(x)
    second = F.pmod(x, F.lit(86_400).cast("long"))
    pad = lambda v: F.lpad(v.cast("string"), 2, "0")
    day = F.date_from_unix_date(div(x - second, 86_400).cast("int"))
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), pad(div(second, 3600)), F.lit(":"), pad(div(second % 3600, 60)), F.lit(":"), pad(second % 60), F.lit("Z"))
