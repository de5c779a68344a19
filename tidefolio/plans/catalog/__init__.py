"""Importing this package registers every query."""

from . import backtests, construction, market, portfolios, risk  # noqa: F401
