"""Spark-native analytics over typed trace / telemetry event logs.

Every operator is a function ``DataFrame -> DataFrame`` that carries
``session_key`` through, so one job analyses all sessions at once.
"""
