"""Job parameters. All kernels take them as an argument; there is no global state."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

#: Heat thresholds by camera. Fixed values.
CAMERA_HEAT = {"H20N": 180, "M3T": 235}


@dataclass(frozen=True)
class Config:
    search_higher_pixels: int = 20
    yolo_confidence: float = 0.1
    yolo_iou: float = 0.25
    yolo_max_x_delta: int = 10
    yolo_max_y_delta: int = 25
    yolo_max_time_gap: int = 5
    feature_min_pixels: int = 8
    feature_max_size: int = 100
    feature_min_overlap_perc: int = 5
    radiometric_low: int = 4575
    radiometric_high: int = 4620
    heat_threshold: int = 200
    object_min_duration_ms: int = 500
    object_max_unreal_blocks: int = 5
    object_min_pixels: int = 2
    object_max_pixels: int = 1000
    object_min_max_heat_pixels: int = 0
    object_max_range_m: float = 350.0
    object_min_hot_density: float = 0.1
    exclude_corner: bool = True
    exclude_width: float = 0.0
    exclude_height: float = 0.0
    good_location_err_m: float = 5.0
    good_height_err_m: float = 5.0
    abandon_height_err_m: float = 5.0
    fps: float = 30.0
    image_width: int = 640
    image_height: int = 512
    input_is_images: bool = False
    save_objects: str = "Significant"
    #: Departures from the original behaviour, off by default.
    reacquire_unreal: bool = False
    interpolate_ray: bool = False

    def clamped(self) -> Config:
        """Parameters inside their allowed ranges; detector parameters out of range fall back to their defaults."""
        hold = lambda x, low, high: min(max(x, low), high)
        return replace(
            self,
            heat_threshold=hold(self.heat_threshold, 50, 255),
            object_min_pixels=hold(self.object_min_pixels, 1, 1000),
            object_max_pixels=hold(self.object_max_pixels, 10, 100_000),
            object_min_max_heat_pixels=hold(self.object_min_max_heat_pixels, 0, 100),
            radiometric_low=hold(self.radiometric_low, 4000, 5000),
            radiometric_high=hold(self.radiometric_high, 4000, 5000),
            yolo_confidence=self.yolo_confidence if 0.1 <= self.yolo_confidence <= 0.9 else Config.yolo_confidence,
            yolo_iou=self.yolo_iou if 0.1 <= self.yolo_iou <= 0.9 else Config.yolo_iou,
        )

    def for_camera(self, camera: str) -> Config:
        return replace(self, heat_threshold=CAMERA_HEAT.get(camera, self.heat_threshold))

    def exclusion_edges(self, width: int, height: int) -> tuple[int, int] | None:
        """Left and top edge of the excluded bottom-right corner. Sizes up to 1 are fractions of the image, larger ones pixels."""
        if not self.exclude_corner or self.exclude_width <= 0 or self.exclude_height <= 0:
            return None
        w = self.exclude_width * width if self.exclude_width <= 1 else self.exclude_width
        h = self.exclude_height * height if self.exclude_height <= 1 else self.exclude_height
        return width - int(w), height - int(h)

    def rows(self) -> list[tuple[str, str]]:
        """Ordered name and value pairs, as they are stored."""
        return [(f.name, str(getattr(self, f.name))) for f in fields(self)]

    @classmethod
    def from_rows(cls, rows) -> Config:
        """The inverse of rows(). Unknown names are ignored, missing or blank ones keep their defaults."""
        known = {f.name: f for f in fields(cls)}
        found = {}
        for name, value in rows:
            if name in known and value not in (None, ""):
                kind = type(known[name].default)
                found[name] = str(value).strip().lower() == "true" if kind is bool else kind(float(value)) if kind is int else kind(value)
        return cls(**found)
