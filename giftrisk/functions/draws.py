"""Key-derived pseudo-random draws.

A draw is a pure function of a row key and a salt:

    u(key, salt, slot) = int(hex(md5(key || '|' || salt))[8*slot : 8*slot+8]) / 2^32

so it is the same under any partitioning, retry or executor loss, and it can be
recomputed by any SQL engine with ``md5``. One md5 yields four independent
32-bit draws, so rows pay one hash per four draws. The draws are dyadic
rationals (k / 2^32), so sums of them are exact in double precision.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0

# draw name -> (entity, salt, slot). "order" draws are keyed by the donation,
# "cust" draws by the donor.
DRAWS: dict[str, tuple[str, str, int]] = {
    # donor attributes
    "first_name": ("cust", "who", 0),
    "last_name": ("cust", "who", 1),
    "age": ("cust", "who", 2),
    "gender": ("cust", "who", 3),
    # bank transaction attributes
    "time": ("order", "tx", 0),
    "device": ("order", "tx", 1),
    "round": ("order", "tx", 2),
    "major": ("order", "tx", 3),
    # donation profile
    "campaign": ("order", "profile", 0),
    "frequency": ("order", "profile", 1),
    "tenure": ("order", "profile", 2),
    "tenure_regular": ("order", "profile", 3),
    # behaviour flags
    "anon_base": ("order", "flags", 0),
    "anon_highval": ("order", "flags", 1),
    "anon_platform": ("order", "flags", 2),
    "gift_aid": ("order", "flags", 3),
    "refund_base": ("order", "refund", 0),
    "refund_highval": ("order", "refund", 1),
    "refund_platform": ("order", "refund", 2),
    "recurring": ("order", "refund", 3),
    "matched_base": ("order", "matched", 0),
    "matched_corporate": ("order", "matched", 1),
    "matched_december": ("order", "matched", 2),
    "channel": ("order", "matched", 3),
    # partner signals
    "cvv": ("order", "partner", 0),
    "fingerprint": ("order", "partner", 1),
    "webhook": ("order", "partner", 2),
    "mismatch": ("order", "partner", 3),
    "vpn": ("order", "ip", 0),
    "vpn_mismatch": ("order", "ip", 1),
    "vel_regular": ("order", "ip", 2),
    "vel_regular_value": ("order", "ip", 3),
    "vel_corporate": ("order", "vel", 0),
    "vel_corporate_value": ("order", "vel", 1),
    "vel_ambient": ("order", "vel", 2),
    "vel_card": ("order", "vel", 3),
    "vel_card_value": ("order", "velv", 0),
}

# Label noise: Irwin-Hall sum of 12 uniforms (mean 6, variance 1).
NOISE_DRAWS = [("order", f"noise{g}", s) for g in range(3) for s in range(4)]

# 60-bit integer draw used to pick label flips (order by it, then by id).
FLIP_DRAW = ("order", "flip")


def hash_hex(key: Column, salt: str) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit("|" + salt)))


def uniform_from_hex(hex_col: Column, slot: int) -> Column:
    """Slot ``slot`` (0-3) of an md5 hex string as a uniform in [0, 1)."""
    part = F.substring(hex_col, 1 + 8 * slot, 8)
    return F.conv(part, 16, 10).cast("bigint") / F.lit(TWO_32)


def pair_from_hex(hex_col: Column, half: int) -> Column:
    """Half ``half`` (0-1) of an md5 hex string as a signed long: slots 2 half and
    2 half + 1, read in one conversion."""
    return F.conv(F.substring(hex_col, 1 + 16 * half, 16), 16, -10).cast("bigint")


def uniform_from_pair(pair: Column, slot: int) -> Column:
    """The same uniform as ``uniform_from_hex``, from the pair that holds its slot."""
    part = pair.bitwiseAND(F.lit(0xFFFFFFFF)) if slot % 2 else F.shiftrightunsigned(pair, 32)
    return part / F.lit(TWO_32)


def uniform(key: Column, salt: str, slot: int = 0) -> Column:
    return uniform_from_hex(hash_hex(key, salt), slot)


def bigint_draw(key: Column, salt: str) -> Column:
    """60-bit non-negative integer draw (first 15 hex digits)."""
    return F.conv(F.substring(hash_hex(key, salt), 1, 15), 16, 10).cast("bigint")


def hash_columns(keys: dict[str, Column], names: list[str] | None = None) -> dict[str, Column]:
    """One md5 column per (entity, salt) used by ``names``; keys maps entity -> key column."""
    names = names or list(DRAWS)
    groups = sorted({DRAWS[n][:2] for n in names})
    return {f"_h_{ent}_{salt}": hash_hex(keys[ent], salt) for ent, salt in groups}


def draw_column(name: str) -> Column:
    """Draw ``name`` read from the hash column made by ``hash_columns``."""
    ent, salt, slot = DRAWS[name]
    return uniform_from_hex(F.col(f"_h_{ent}_{salt}"), slot)


def pair_columns(names: list[str] | None = None) -> dict[str, Column]:
    """The pairs that hold the draws ``names``, read from the columns of ``hash_columns``."""
    halves = sorted({(ent, salt, slot // 2) for ent, salt, slot in (DRAWS[n] for n in names or list(DRAWS))})
    return {f"_u_{ent}_{salt}_{half}": pair_from_hex(F.col(f"_h_{ent}_{salt}"), half) for ent, salt, half in halves}


def draw_of_pairs(name: str) -> Column:
    """Draw ``name`` read from the columns of ``pair_columns``."""
    ent, salt, slot = DRAWS[name]
    return uniform_from_pair(F.col(f"_u_{ent}_{salt}_{slot // 2}"), slot)


def weighted_choice(u: Column, options: list[tuple[str, float]]) -> Column:
    """Categorical draw: first option whose cumulative weight exceeds u."""
    expr = None
    bounds = cumulative_bounds(options)
    for i, (value, cum) in enumerate(bounds):
        if i == len(bounds) - 1:
            expr = expr.otherwise(F.lit(value)) if expr is not None else F.lit(value)
        else:
            cond = u < F.lit(cum)
            expr = F.when(cond, F.lit(value)) if expr is None else expr.when(cond, F.lit(value))
    return expr


def cumulative_bounds(options: list[tuple[object, float]]) -> list[tuple[object, float]]:
    """(value, cumulative upper bound) pairs, normalised; shared with the SQL oracle."""
    total = sum(w for _, w in options)
    out, cum = [], 0.0
    for value, w in options:
        cum += w / total
        out.append((value, cum))
    return out
