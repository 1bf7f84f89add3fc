"""All queries on experiment data, by name, with their SQL."""

from __future__ import annotations

import importlib

from trialframe.plans.base import ORACLES, QUERIES

for _name in ("bakeoffs", "pools", "journals", "tables", "training", "texts", "vectors", "pages", "costs", "lifecycle", "codecs", "guards", "sources", "composites", "reports"):
    importlib.import_module(f"trialframe.plans.{_name}")

__all__ = ["ORACLES", "QUERIES"]
