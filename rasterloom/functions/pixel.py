"""Scalar functions of pixels, points, names and parameters.  All are plain Columns: nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Luma weights of the BGR to gray conversion (fixed values).
BLUE, GREEN, RED = 0.114, 0.587, 0.299


def rounded(x: Column, digits: int = 6) -> Column:
    """x rounded, with -0.0 as 0.0."""
    return F.round(x, digits) + F.lit(0.0)


def gray_from_bgr(b: Column, g: Column, r: Column) -> Column:
    return F.round(b * BLUE + g * GREEN + r * RED).cast("int")


def replace_highlights(v: Column, low: int = 245, high: int = 255, value: int = 190) -> Column:
    return F.when(v.between(low, high), F.lit(value)).otherwise(v)


def threshold(v: Column, cut: int = 127, above: int = 255, below: int = 0) -> Column:
    """above where v > cut, else below: binary (255, 0), inverse (0, 255) and unit (1, 0) thresholds."""
    return F.when(v > cut, F.lit(above)).otherwise(F.lit(below))


def unit_range(v: Column) -> Column:
    return v / F.lit(255.0)


def signed_range(v: Column) -> Column:
    return (v / F.lit(255.0) - F.lit(0.5)) / F.lit(0.5)


def invert(v: Column) -> Column:
    return F.lit(255) - v


def mask_and(v: Column, mask: Column) -> Column:
    return v.bitwiseAND(mask)


def clear_frame(v: Column, r: Column, c: Column, h: Column, w: Column) -> Column:
    return F.when((r == 0) | (c == 0) | (r == h - 1) | (c == w - 1), F.lit(0)).otherwise(v)


def distance(r1: Column, c1: Column, r2: Column, c2: Column) -> Column:
    return F.sqrt((r1 - r2) * (r1 - r2) + (c1 - c2) * (c1 - c2))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def region_code(path: Column) -> Column:
    """The first two characters of the file name."""
    return F.substring(base_name(path), 1, 2)


def parse_pair(text: Column) -> Column:
    """"(a, b)" as struct<a:int, b:int>; blanks anywhere and signs are allowed, anything else gives null."""
    parts = F.split(F.regexp_replace(text, r"[()\s]", ""), ",")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("int")
    return F.when(number(0).isNotNull() & number(1).isNotNull(), F.struct(number(0).alias("a"), number(1).alias("b")))


def format_pair(pair: Column) -> Column:
    return F.format_string("(%d,%d)", pair["a"], pair["b"])


#: Fields of a calibration, in order, with their kinds (fixed values).
CALIBRATION = (
    ("image_path", "text"), ("folder_name", "text"), ("nlm_h", "int"), ("nlm_tws", "int"), ("nlm_sws", "int"), ("gb_kernel", "pair"),
    ("clahe_cl", "double"), ("clahe_tgs", "pair"), ("thresh_bs", "int"), ("thresh_c", "double"), ("morphx_kernel", "pair"),
    ("kernel_open", "pair"), ("kernel_close", "pair"), ("debug_args", "names"), ("output_destination", "text"),
)


def parse_args(fields: dict[str, Column]) -> dict[str, Column]:
    """The calibration's text fields in their kinds; what cannot be read is null, names are split at commas without blanks."""
    read = {
        "text": lambda c: c,
        "int": lambda c: F.trim(c).try_cast("int"),
        "double": lambda c: F.trim(c).try_cast("double"),
        "pair": parse_pair,
        "names": lambda c: F.split(F.replace(c, F.lit(" "), F.lit("")), ","),
    }
    return {name: read[kind](fields[name]) for name, kind in CALIBRATION}
