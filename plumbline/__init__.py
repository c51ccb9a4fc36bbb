"""Measurement-integrity analytics as Spark DataFrame jobs.

Observations (repository, source, metric, value, time) are cut into windows and
checked for distribution drift, correlation breakdown and threshold compression,
for every repository at once.
"""
