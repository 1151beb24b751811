"""Registered queries; importing this package fills the registry."""

from . import checks, files, joins, long_series, models, panels, quality, scalars, scoring, statistics, streams, summaries, texts, windows  # noqa: F401
