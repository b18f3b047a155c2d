"""Corpora derived from the warehouse tables and the registry of runnable queries."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("q_scan", "q_text", "q_pages", "q_images", "q_ocr", "q_fusion")


def all_queries() -> dict:
    """Every registered query, by name."""
    out: dict = {}
    for family in FAMILIES:
        out.update(import_module(f"{__name__}.{family}").R)
    return out
