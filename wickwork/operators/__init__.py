"""All operators on bars; importing this package fills ``OPERATORS``."""

from . import averages, ichimoku, label, levels, momentum, pipelines, sessions, stats, volatility, volume  # noqa: F401
from .base import OPERATORS  # noqa: F401
