"""Operators for training-data pipelines over web-scale text; nothing outside this folder imports it."""
