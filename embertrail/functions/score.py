"""Density, duration and the significance rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from embertrail.config import Config


def density(max_hot: Column, width: Column, height: Column) -> Column:
    """Hot pixels over the area of the ellipse in the box; 0 without a box."""
    return F.coalesce(F.try_divide(max_hot.cast("double"), width * height * F.lit(0.785)), F.lit(0.0))


def duration_units(n_real: Column, cfg: Config) -> Column:
    """How many least durations an object was seen for."""
    return F.lit(1.0) if cfg.input_is_images else n_real * F.lit(1000.0) / F.lit(cfg.fps) / F.lit(float(cfg.object_min_duration_ms))


def vaguely_significant(max_hot: Column, cfg: Config) -> Column:
    low = F.lit(True) if cfg.object_min_pixels <= 0 else max_hot >= cfg.object_min_pixels
    return low & (F.lit(True) if cfg.object_max_pixels <= 0 else max_hot <= cfg.object_max_pixels)


def _grades(max_hot: Column, max_heat_pixels: Column, units: Column, height: Column, cfg: Config):
    basics = (max_heat_pixels >= cfg.object_min_max_heat_pixels) & (F.lit(True) if cfg.object_max_pixels <= 0 else max_hot <= cfg.object_max_pixels)
    m = cfg.object_min_pixels
    p = [basics & (max_hot > m * k) for k in (1, 2, 4)]
    t = [units >= k for k in (1, 2, 4)]
    h = F.coalesce(height, F.lit(-2.0))
    e = [h >= 0, h > 2, h > 4]
    return p, t, e


def significant(max_hot: Column, max_heat_pixels: Column, dense: Column, units: Column, height: Column, cfg: Config) -> Column:
    p, t, e = _grades(max_hot, max_heat_pixels, units, height, cfg)
    long_or_images = F.lit(True) if cfg.input_is_images else t[0] & (e[1] | p[1])
    return F.coalesce(p[0] & (dense >= cfg.object_min_hot_density) & long_or_images, F.lit(False))


def attributes(sig: Column, max_hot: Column, max_heat_pixels: Column, units: Column, height: Column, cfg: Config) -> Column:
    """The grades as text, such as `Sig P3 T2 E1`; lower case for none."""
    p, t, e = _grades(max_hot, max_heat_pixels, units, height, cfg)
    grade = lambda x, name: F.when(x[2], f"{name}3").when(x[1], f"{name}2").when(x[0], f"{name}1").otherwise(name.lower())
    return F.trim(F.concat_ws(" ", F.when(sig, "Sig").otherwise(""), grade(p, "P"), grade(t, "T"), grade(e, "E")))
