"""Declarations of pixel tables: what a column is and how its layer is decoded.

A table is declared once, column by column, as an archive's DDL would do it. Unlike a
validator that accepts anything, a declaration is checked when it's made.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from enum import Enum


class Role(Enum):
    """What a pixel column holds."""

    DATASET = "dataset"
    CATALOG = "catalog"
    INDEX = "index"
    LINE = "line_index"
    SAMPLE = "sample_index"
    POINT = "point"
    FOOTPRINT = "footprint"
    #: A footprint's box.
    BOX = "box"


#: Declared types of dataset columns. float8 is scaled, the others are copied.
TYPES = ("int2", "int4", "int8", "float4", "float8", "bit")


@dataclass(frozen=True)
class Column:
    """One column.

    dataset: the layer (or catalog column) it reads. product: the catalog column with the
    path of the file that holds the layer. prefix: index in the leading dimensions of an N-d
    layer. scale_name, offset_name: arrays of a file with a value for each such index.
    """

    name: str
    role: Role = Role.DATASET
    type: str = "float8"
    product: str | None = None
    dataset: str | None = None
    hfactor: int = 1
    vfactor: int = 1
    prefix: tuple[int, ...] = ()
    dims: tuple[int, ...] = ()
    scale: float | None = None
    offset: float | None = None
    scale_name: str | None = None
    offset_name: str | None = None
    inverse_scale: bool = False
    fill: float | None = None
    valid_range: tuple[float, float] | None = None
    bits: int = 0
    bitmap_prefix: bool = False
    constant: bool = False

    def __post_init__(self):
        if self.role is Role.DATASET and self.type not in TYPES:
            raise ValueError(f"{self.name}: type {self.type!r} is none of {', '.join(TYPES)}")
        if self.hfactor < 1 or self.vfactor < 1:
            raise ValueError(f"{self.name}: factors begin at 1")
        if len(self.prefix) != len(self.dims):
            raise ValueError(f"{self.name}: {len(self.prefix)} indexes into {len(self.dims)} leading dimensions")
        if self.type == "bit" and self.bits < 1:
            raise ValueError(f"{self.name}: bit columns have 1 bit or more")

    @property
    def layer(self) -> str:
        return self.dataset or self.name

    @property
    def width(self) -> int:
        """Bytes of a pixel's bit field; 1 for other columns."""
        return -(-self.bits // 8) if self.type == "bit" else 1

    @property
    def plain(self) -> bool:
        """Whether its layer has one value for each pixel."""
        return self.role is Role.DATASET and self.hfactor * self.vfactor == 1 and not self.prefix and self.type != "bit"


@dataclass(frozen=True)
class Geolocation:
    """Layers of coordinates, with one value for factor x factor pixels. product: the catalog column with the path of their file."""

    lat: str = "lat"
    lon: str = "lon"
    factor: int = 1
    product: str | None = None


@dataclass(frozen=True)
class Table:
    """A pixel table: driver, size of a chunk and columns.

    A file's size is that of its geolocation, if the table has one, else of the first
    column that has one value for each pixel.
    """

    name: str
    columns: tuple[Column, ...]
    driver: str = "swath"
    lines: int = 4
    samples: int = 8
    shift_longitude: bool = False
    geolocation: Geolocation | None = None

    def __post_init__(self):
        names = [c.name for c in self.columns]
        if len(set(names)) < len(names):
            raise ValueError(f"{self.name}: columns of one name")
        for role in Role:
            own = [c.name for c in self.columns if c.role is role]
            if role not in (Role.DATASET, Role.CATALOG) and len(own) > 1:
                raise ValueError(f"{self.name}: {role.value} is declared as {' and '.join(own)}")
        for c in self.columns:
            if c.role is Role.DATASET and not c.constant and (self.lines % c.vfactor or self.samples % c.hfactor):
                raise ValueError(f"{self.name}.{c.name}: its factors don't divide a chunk of {self.lines} x {self.samples}")

        g = self.geolocation
        if g and (self.lines % g.factor or self.samples % g.factor or self.samples < 2 * g.factor or self.lines < 2 * g.factor):
            raise ValueError(f"{self.name}: geolocation of factor {g.factor} needs blocks of at least 2 x 2 values")
        if not g and not any(c.plain for c in self.columns):
            raise ValueError(f"{self.name}: nothing tells a file's size")

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise KeyError(name)


#: Options of a column as strings, as DDL carries them, and how each is read.
_NUMBERS = {"factor": int, "hfactor": int, "vfactor": int, "bits": int}


def column_of(name: str, type_: str = "float8", **options: str) -> Column:
    """A column from DDL-like string options; an unknown option is an error."""
    known = {f.name for f in fields(Column)} | {"cat_name", "factor", "bitmap_type", "role"}
    if unknown := sorted(set(options) - known):
        raise ValueError(f"{name}: unknown options {', '.join(unknown)}")
    c = Column(name, Role(options.get("role", "dataset")), type_, bits=int(options.get("bits", 0)))
    change: dict = {}
    if "factor" in options:
        change |= {"hfactor": int(options["factor"]), "vfactor": int(options["factor"])}
    for k in ("hfactor", "vfactor"):
        if k in options:
            change[k] = _NUMBERS[k](options[k])
    if "cat_name" in options:
        change["product"] = options["cat_name"]
    if "dataset" in options:
        change["dataset"] = options["dataset"]
    if "prefix" in options:
        change["prefix"] = tuple(int(x) for x in options["prefix"].replace(",", " ").split())
        change["dims"] = tuple(int(x) for x in options["dims"].replace(",", " ").split())
    for k in ("scale", "offset", "fill"):
        if k in options:
            try:
                change[k] = float(options[k])
            except ValueError:  # the name of an attribute
                if k == "fill":
                    raise
                change[f"{k}_name"] = options[k]
    if "inverse_scale" in options:
        change["inverse_scale"] = options["inverse_scale"].lower() == "true"
    if "bitmap_type" in options:
        change["bitmap_prefix"] = options["bitmap_type"] == "prefix"
    return replace(c, **change)
