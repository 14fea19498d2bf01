"""Fixed schemas, as DDL: null always means that nothing was claimed."""

from __future__ import annotations

EXPECTED = "struct<category string, subcategory string, color string, pattern string, style string, material string, secondary_colors array<string>, no_clothing boolean>"
IMAGE = f"id string, file string, split string, coarse_label string, notes string, expected {EXPECTED}"
ANNOTATIONS = f"version int, images array<struct<{IMAGE}>>"
PREDICTION = "struct<value string, confidence double, source string, scores map<string,double>, alternatives array<string>>"
COLOR = "struct<primary string, primary_hex string, secondary array<string>, distribution map<string,double>, is_multicolor boolean, pixel_count int, notes array<string>>"
ITEM = f"""struct<id string, bbox struct<x1 double, y1 double, x2 double, y2 double>, coarse_label string,
  attributes struct<category {PREDICTION}, subcategory {PREDICTION}, material {PREDICTION}, pattern {PREDICTION}, style {PREDICTION}, color {COLOR}>,
  confidence double, status string, needs_review boolean, review_reason array<string>, segmentation_quality double, embedding array<float>, attempts int>"""
ANALYSIS = f"success boolean, reason string, request_id string, image_quality struct<score double, usable boolean>, processing struct<total_ms double>, items array<{ITEM}>"
