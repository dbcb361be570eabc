"""Compositions: scan, backtest, and the registry of user detectors."""
