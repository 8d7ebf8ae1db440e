"""Vector measures over ``array<float>`` columns, without Python."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def l2_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def l1_distance(a: Column, b: Column) -> Column:
    parts = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def hamming_distance(a: Column, b: Column) -> Column:
    """Places that differ, for vectors of 0 and 1."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)


def normalised(a: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    return F.when(norm(a) == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(
        F.transform(a, lambda x: x.cast("double") / norm(a))
    )


def character_embedding(text: Column, dims: int = 50, seed: int = 42) -> Column:
    """A vector of length 1 made of a text's characters: the mean of a fixed normal vector a character, for tests and demonstrations.

    The normal numbers come from hashes of character, place and seed, so they are the same everywhere;
    an empty text has a zero vector, a null none.
    """
    letters = F.split(text, "")

    def unit(c: Column, i: Column, which: int) -> Column:
        return (F.pmod(F.xxhash64(c, i, F.lit(seed), F.lit(which)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)

    def normal(c: Column, i: Column) -> Column:
        return F.sqrt(-2 * F.ln(unit(c, i, 0))) * F.cos(2 * math.pi * unit(c, i, 1)) / math.sqrt(dims)

    places = F.sequence(F.lit(0), F.lit(dims - 1))
    mean = F.transform(places, lambda i: F.aggregate(letters, F.lit(0.0), lambda s, c: s + normal(c, i)) / F.size(letters))
    return F.when(text == "", F.transform(places, lambda i: F.lit(0.0))).when(text.isNotNull(), normalised(mean))


def similarity(kind: str, a: Column, b: Column) -> Column:
    """A score that is higher for nearer vectors: cosine, inner_product, or negated l2 or hamming distance."""
    makers = {
        "cosine": lambda: cosine(a, b),
        "inner_product": lambda: dot(a, b),
        "l2": lambda: -l2_distance(a, b),
        "hamming": lambda: -hamming_distance(a, b),
    }
    if kind not in makers:
        raise ValueError(f"unknown distance type: {kind}")
    return makers[kind]()
