"""Meterlake: a Spark-first lakehouse engine for building telemetry.

Operators are pure ``DataFrame -> DataFrame`` functions; reading and writing
live in :mod:`meterlake.sources`, so every operator can be tested without a
lake on disk.
"""
