"""Registered queries, with DuckDB SQL where it can express them."""

from . import actions, backtests, events, extras, factors, kernels, live, panel, risk, safety, streams, validation  # noqa: F401
