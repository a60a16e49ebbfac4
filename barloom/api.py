"""The loader surface in one place."""

from .operators.crosssection import factor_ic
from .operators.rows import wide
from .sources.release import (UnknownColumns, load_factors, load_fundamentals, load_panel, manifest,
                              universe)

__all__ = ["load_panel", "load_factors", "load_fundamentals", "universe", "manifest", "wide",
           "factor_ic", "UnknownColumns"]
