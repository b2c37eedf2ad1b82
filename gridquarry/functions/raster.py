"""Pixel arrays as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: numbers down to this one mark missing pixels.
INVALID = -32752


def stretch_u8(pixels: Column, low: Column, high: Column, rounded: bool = False) -> Column:
    """Pixels scaled to 0 to 255, cut (or rounded); missing ones, and all if high is not above low, become 0."""

    def scale(x: Column, limits: Column) -> Column:
        x = x.cast("double")
        part = F.least(F.greatest((x - limits["low"]) / limits["span"], F.lit(0.0)), F.lit(1.0)) * 255
        part = F.floor(part + 0.5) if rounded else F.floor(part)
        return F.when(x.isNull() | F.isnan(x) | (x <= INVALID), 0).otherwise(F.coalesce(part, F.lit(0))).cast("int")

    # the limits are an argument of a lambda, so they are evaluated once an array and not once a pixel
    ends = F.transform(F.array(F.struct(low.alias("low"), high.alias("high"))), lambda e: F.struct(e["low"].alias("low"), F.when(e["high"] > e["low"], e["high"] - e["low"]).alias("span")))
    return F.transform(ends, lambda limits: F.transform(pixels, lambda x: scale(x, limits)))[0]


def calibrate(dn: Column, scale: float, offset: float) -> Column:
    """Physical value of a number; null for missing pixels."""
    return F.when(dn > INVALID, dn * scale + offset)


def softmax(values: Column, temperature: float = 1.0) -> Column:
    top = F.array_max(values)
    e = F.transform(values, lambda x: F.exp((x - top) / temperature))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def strict_classes(probs: Column, threshold: float) -> Column:
    """1 if the probability of class 1 is above threshold, else 2 if that of class 2 is above 0.5, else 0."""
    return F.when(probs[1] > threshold, 1).when(probs[2] > 0.5, 2).otherwise(0)


def weak_label(norm: Column, x: Column, y: Column, cx: Column, cy: Column, reach: float = 40.0, dark: float = 0.20, bright: float = 0.80) -> Column:
    """1 for dark, 2 for bright pixels within reach of the centre, else 0."""
    near = F.sqrt(F.pow(x - cx, 2) + F.pow(y - cy, 2)) <= reach
    return F.when(near & (norm < dark), 1).when(near & (norm > bright), 2).otherwise(0)
