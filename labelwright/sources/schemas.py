"""Schemas of the input tables."""

LABELS_IN = (
    "record_id string, text string, source_type string, product_name string, category string, platform string, "
    "created_at timestamp"
)
PAGES = "page_id string, url string, html string"
IMAGE_CANDIDATES = (
    "product_id string, ord int, url string, alt string, source string, score int, visual_score int, phash string, ocr_text string"
)
OCR_DETECTIONS = (
    "product_id string, image_id string, variant string, ord int, bbox array<array<double>>, text string, conf double"
)
IMAGES = (
    "image_id string, width_px int, height_px int, package_area_cm2 double, reference_width_mm double, "
    "total_surface_cm2 double, pdp_area_cm2 double"
)
BARCODES = "product_id string, image_ord int, ord int, type string, value string"
