"""Fixed schemas of the domain tables (never inferred)."""

from __future__ import annotations

IMAGES = "id bigint, file_name string, width int, height int, date_captured string, extra struct<name:string>"
ANNOTATIONS = (
    "id bigint, image_id bigint, category_id int, bbox array<double>, area double, "
    "segmentation array<array<double>>, iscrowd int"
)
CATEGORIES = "id int, name string, supercategory string"
PLANES = "image_id string, band int, h int, w int, px array<float>"
RASTERS = "path string, height int, width int, blue array<int>, green array<int>, red array<int>, reason string"
MODEL_META = "input_mode string, num_classes int, score_thresh_test double, class_names array<string>"
MANIFEST = "array<struct<file:string,overlay:string,thumb:string,n:int>>"
PREDICTIONS = (
    "file string, boxes array<array<double>>, scores array<double>, classes array<int>, reason string"
)
RATIONAL = "struct<num:bigint,den:bigint>"
GPS = (
    f"path string, lat_dms array<{RATIONAL}>, lat_ref string, lon_dms array<{RATIONAL}>, lon_ref string"
)
