"""Options and errors of the tile builders."""

from __future__ import annotations

from dataclasses import dataclass


class TileError(ValueError):
    """Input or options that can't be tiled."""


def check_zooms(low: int, high: int) -> None:
    if not 0 <= low <= high <= 30:
        raise TileError(f"zooms must be 0 <= min <= max <= 30: {low}, {high}")


def check_stretch(stretch: tuple[float, float] | None) -> None:
    if stretch and not stretch[0] < stretch[1]:
        raise TileError(f"stretch must rise: {stretch}")


@dataclass(frozen=True)
class RasterMeta:
    """A north-up grid: ``crs`` is '4326' or '3857'; the origin is the north-west corner."""

    rows: int
    cols: int
    origin_x: float
    origin_y: float
    px_w: float
    px_h: float
    crs: str = "4326"
    bands: int = 1

    def __post_init__(self):
        if self.bands not in (1, 3, 4) or self.rows < 1 or self.cols < 1 or self.px_w <= 0 or self.px_h <= 0:
            raise TileError(f"not a north-up grid of 1, 3 or 4 bands: {self}")
        if self.crs not in ("4326", "3857"):
            raise TileError(f"unsupported CRS {self.crs}")

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        return self.origin_x, self.origin_y - self.rows * self.px_h, self.origin_x + self.cols * self.px_w, self.origin_y


@dataclass(frozen=True)
class PyramidOptions:
    min_zoom: int = 0
    max_zoom: int | None = None
    tile_size: int = 256
    resampling: str = "bilinear"
    format: str = "png"
    stretch: tuple[float, float] | None = None
    scheme: str = "grayscale"
    name: str = "tiles"

    def __post_init__(self):
        if self.resampling not in ("nearest", "bilinear") or self.format not in ("png", "webp"):
            raise TileError(f"unknown resampling or format: {self}")
        check_zooms(self.min_zoom, self.min_zoom if self.max_zoom is None else self.max_zoom)
        check_stretch(self.stretch)


@dataclass(frozen=True)
class MvtOptions:
    min_zoom: int = 0
    max_zoom: int = 14
    extent: int = 4096
    buffer: int = 64
    simplify: float = 1.0
    compress: bool = True
    name: str = "tiles"

    def __post_init__(self):
        check_zooms(self.min_zoom, self.max_zoom)
        if self.extent <= 0 or self.buffer < 0:
            raise TileError("extent must be above 0, and the buffer not below")


@dataclass(frozen=True)
class CogOptions:
    tile_size: int = 512
    deflate: bool = True
    stretch: tuple[float, float] | None = None

    def __post_init__(self):
        if self.tile_size <= 0 or self.tile_size % 16:
            raise TileError("tile size must be a multiple of 16")
        check_stretch(self.stretch)
