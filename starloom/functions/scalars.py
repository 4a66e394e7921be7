"""Scalar column functions. All are built from JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text formats of the inputs.
SNAPSHOT_PATTERN = r"^snap_(\d+)-z([0-9.eE+-]+)$"
SETUP_PATTERN = r"^z(\d+)_(adapt|fixed)$"
SOFTENING_ALIASES = {"adapt": "adaptive", "fixed": "fixed"}


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def log10_positive(value: Column | str) -> Column:
    """log10 for positive input, NULL otherwise (never NaN or -inf)."""
    v = as_column(value).cast("double")
    return F.when(v > 0, F.log10(v))


def quantise(value: Column | str, digits: int) -> Column:
    """Half-up rounding by plain double arithmetic, the same on every SQL engine."""
    scale = F.lit(float(10**digits))
    return F.floor(as_column(value).cast("double") * scale + F.lit(0.5)).cast("double") / scale


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 * part / whole, quantised; NULL where the whole is zero."""
    return quantise(F.try_divide(F.lit(100.0) * part, whole), digits)


def bin_index(value: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based index of the half-open bin between the even edges low + i * (high - low) / bins.

    The quotient is only a guess; the edges decide, so a value on an edge always falls to the right
    of it. Values at or above ``high`` give ``bins``, values below ``low`` are negative.
    """
    step = (high - low) / F.lit(float(bins))
    guess = F.floor((value - low) * F.lit(float(bins)) / (high - low)).cast("double")
    down = (value < low + guess * step).cast("int")
    up = (value >= low + (guess + F.lit(1.0)) * step).cast("int")
    inner = F.least(guess.cast("int") - down + up, F.lit(bins - 1))
    return F.when(value >= high, F.lit(bins)).otherwise(inner)


def box_fraction(position_kpc: Column | str, box_mpc: Column | str) -> Column:
    """Position in kpc as a fraction of a box given in Mpc."""
    return as_column(position_kpc).cast("double") / (as_column(box_mpc).cast("double") * F.lit(1000.0))


def merit(shared: Column | str, size_a: Column | str, size_b: Column | str) -> Column:
    """Overlap score: shared squared over the product of both sizes; NULL on an empty side."""
    s, a, b = (as_column(c).cast("double") for c in (shared, size_a, size_b))
    return F.try_divide(s * s, a * b)


def linear_relation(value: Column | str, slope: float, intercept: float) -> Column:
    """slope * log10(value) + intercept, NULL where the value is not positive."""
    return F.lit(float(slope)) * log10_positive(value) + F.lit(float(intercept))


def missing_flag(value: Column | str) -> Column:
    return as_column(value).isNull().cast("double")


def _checked_extract(value: Column | str, pattern: str, group: int, what: str) -> Column:
    v = as_column(value)
    return F.when(v.isNull(), F.lit(None)).when(
        v.rlike(pattern), F.regexp_extract(v, pattern, group)
    ).otherwise(F.raise_error(F.concat(F.lit(f"not a {what}: "), v)))


def snapshot_number(value: Column | str, pattern: str = SNAPSHOT_PATTERN) -> Column:
    """'snap_056-z0.000' -> 56. Malformed text raises, NULL stays NULL."""
    return _checked_extract(value, pattern, 1, "snapshot").cast("bigint")


def scale_factor(value: Column | str, pattern: str = SNAPSHOT_PATTERN) -> Column:
    """'snap_056-z1.000' -> 1 / (1 + z)."""
    z = _checked_extract(value, pattern, 2, "snapshot").cast("double")
    return F.lit(1.0) / (F.lit(1.0) + z)


def setup_redshift(value: Column | str, pattern: str = SETUP_PATTERN) -> Column:
    """'z39_adapt' -> 39."""
    return _checked_extract(value, pattern, 1, "setup id").cast("int")


def setup_softening(
    value: Column | str,
    pattern: str = SETUP_PATTERN,
    aliases: dict[str, str] = SOFTENING_ALIASES,
) -> Column:
    """'z39_adapt' -> 'adaptive'; a token without an alias raises."""
    token = _checked_extract(value, pattern, 2, "setup id")
    lookup = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    full = F.try_element_at(lookup, token)
    return F.when(token.isNull(), F.lit(None)).otherwise(
        F.coalesce(full, F.raise_error(F.concat(F.lit("unknown alias: "), token)).cast("string"))
    )


def stable_hash(seed: int | str, *keys: Column | str) -> Column:
    """Repeatable pseudo-random hex text of a seed and a key; independent of partitioning."""
    parts = [as_column(k).cast("string") for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))
