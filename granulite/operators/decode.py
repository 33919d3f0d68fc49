"""Raw layer values to column values, as native expressions.

Layers are arrays in the row of a chunk. Whatever a pixel needs is looked up by its
position in the chunk, so a layer is decoded only for the pixels that are kept.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(layer: Column, index: Column) -> Column:
    """The element at a position from 0."""
    return F.get(layer, index)


def filled(v: Column, fill) -> Column:
    """Null where a value equals the fill value, also for a fill of NaN."""
    if fill is None:
        return v
    return F.when(~v.eqNullSafe(fill if isinstance(fill, Column) else F.lit(fill)), v)


def in_range(v: Column, low, high) -> Column:
    """Null where a raw value is outside of the valid range."""
    return F.when(v.between(low, high), v)


def scaled(v: Column, scale=1.0, offset=0.0, inverse: bool = False) -> Column:
    """scale * (v - offset); with inverse v / scale + offset."""
    scale, offset = (x if isinstance(x, Column) else F.lit(float(x)) for x in (scale, offset))
    v = v.cast("double")
    return v / scale + offset if inverse else scale * (v - offset)


def replicated(index: Column, samples: int, hfactor: int, vfactor: int) -> Column:
    """Position in a layer whose elements each cover vfactor lines and hfactor samples."""
    line, sample = F.floor(index / samples), index % samples
    return (F.floor(line / vfactor) * (samples // hfactor) + F.floor(sample / hfactor)).cast("int")


def prefix_offset(prefix: tuple[int, ...], dims: tuple[int, ...], plane: int) -> int:
    """Where the plane with these leading indexes begins in a flattened N-d layer of planes of ``plane`` elements."""
    n = 0
    for i, d in zip(prefix, dims):
        if not 0 <= i < d:
            raise ValueError(f"index {i} in a dimension of {d}")
        n = n * d + i
    return n * plane


def plane(layer: Column, prefix: tuple[int, ...], dims: tuple[int, ...], size: int) -> Column:
    """The plane of an N-d layer with these leading indexes."""
    return F.slice(layer, prefix_offset(prefix, dims, size) + 1, size)


def bits_postfix(layer: Column, index: Column, width: int) -> Column:
    """A bit field of ``width`` consecutive bytes for each pixel, the first the most significant."""
    out = F.lit(0).cast("long")
    for k in range(width):
        out = F.shiftleft(out, 8).bitwiseOR(at(layer, index * width + k).cast("long").bitwiseAND(F.lit(255).cast("long")))
    return out


def bits_prefix(layer: Column, index: Column, width: int, size: int) -> Column:
    """A bit field whose bytes stand in ``width`` planes of ``size`` elements."""
    out = F.lit(0).cast("long")
    for k in range(width):
        out = F.shiftleft(out, 8).bitwiseOR(at(layer, index + k * size).cast("long").bitwiseAND(F.lit(255).cast("long")))
    return out


def bits_wide(layer: Column, index: Column, width: int, step: int | Column, first: int | Column) -> Column:
    """A bit field of more bytes than a long has, as binary: byte k stands at ``first * index + k * step``."""
    byte = lambda k: F.lpad(F.hex(at(layer, index * first + k * step).cast("long").bitwiseAND(F.lit(255).cast("long"))), 2, "0")
    return F.unhex(F.concat(*(byte(k) for k in range(width))))


def wrapped_short(v: Column) -> Column:
    """A value in 16 signed bits, wrapping around."""
    return (F.pmod(v.cast("long") + 32768, F.lit(65536)) - 32768).cast("short")


def dataset_name(template: str, file: Column) -> Column:
    """A dataset's name from a template: %f is the file's name, %% a percent sign."""
    parts, i = [], 0
    while i < len(template):
        c = template[i]
        if c != "%":
            j = template.find("%", i)
            j = len(template) if j < 0 else j
            parts.append(F.lit(template[i:j]))
            i = j
            continue
        follow = template[i + 1 : i + 2]
        if follow == "f":
            parts.append(file)
        elif follow == "%":
            parts.append(F.lit("%"))
        else:
            raise ValueError(f"%{follow} in {template!r}")
        i += 2
    return F.concat(*parts) if parts else F.lit("")
