"""Query catalogue: Spark queries over the given tables with their SQL counterparts."""
from .registry import ORACLES, REGISTRY  # noqa: F401
from . import bars, bar_files, cross_section, history, scoring, uncertainty, calibration, isotonic, quality, models  # noqa: F401
