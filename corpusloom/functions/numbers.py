"""Numeric and array functions as Catalyst expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def bce_with_logits(x: Column, y: Column, pos_weight: Column) -> Column:
    """Binary cross-entropy of a logit, stable for large ones."""
    log_p = -(F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))))
    return -(pos_weight * y * log_p + (1 - y) * (log_p - x))


def quantize_row(v: Column) -> Column:
    """struct<scale, q>: symmetric int8 with one scale for the array; halves round to even; idempotent."""
    scale = F.greatest(F.array_max(F.transform(v, lambda x: F.abs(x.cast("double")))) / 127, F.lit(1e-12))
    return F.element_at(F.transform(F.array(scale), lambda s: F.struct(s.alias("scale"), F.transform(v, lambda x: F.least(F.greatest(F.rint(x.cast("double") / s), F.lit(-127.0)), F.lit(127.0)).cast("int")).alias("q"))), 1)


def dequantize(q: Column) -> Column:
    return F.transform(q["q"], lambda x: x * q["scale"])


def quantize_channels(m: Column) -> Column:
    """Fake-quantized values of a matrix (an array of rows): symmetric int8, one scale for each row (output channel)."""
    return F.transform(m, lambda row: dequantize(quantize_row(row)))


def quantize_affine(v: Column) -> Column:
    """Fake-quantized values: unsigned 8 bits with scale and zero point of the whole array."""
    lo, hi = F.array_min(v).cast("double"), F.array_max(v).cast("double")
    one = F.array(F.struct((F.greatest(hi - lo, F.lit(1e-12)) / 255).alias("s"), lo.alias("lo")))
    return F.element_at(F.transform(one, lambda c: F.transform(v, lambda x: (F.least(F.greatest(F.rint(x / c["s"]) + F.rint(-c["lo"] / c["s"]), F.lit(0.0)), F.lit(255.0)) - F.rint(-c["lo"] / c["s"])) * c["s"])), 1)


def zscore(v: Column, columns: list[int], mean: Column, std: Column) -> Column:
    """Array with the given (0-based) columns normalised; mean and std hold one value for each of them."""
    place = [None] * (max(columns, default=-1) + 1)
    for k, c in enumerate(columns):
        place[c] = k
    at = F.array(*(F.lit(k).cast("int") for k in place)) if place else F.array().cast("array<int>")
    return F.transform(v, lambda x, i: F.when(F.get(at, i).isNotNull(), (x - F.get(mean, F.get(at, i))) / F.get(std, F.get(at, i))).otherwise(x))


def group_columns(groups: str, order: str = "ABC", sizes: dict[str, int] | None = None) -> list[int]:
    """Columns that some feature groups take in the full layout (A: 30 tags, B: depth and has_link, C: log_chars)."""
    sizes = sizes or {"A": 30, "B": 2, "C": 1}
    out, at = [], 0
    for g in order:
        if g in groups:
            out += range(at, at + sizes[g])
        at += sizes[g]
    return out


def learning_rate(step: Column, total: int, warm: int, peak: float, decay: bool = True) -> Column:
    """Linear warm-up, then linear decay to 0 (or hold)."""
    after = peak * F.greatest(F.lit(0.0), (F.lit(total) - step) / F.lit(max(1, total - warm))) if decay else F.lit(peak)
    return F.when(step < warm, peak * (step + 1) / F.lit(max(1, warm))).otherwise(after)
