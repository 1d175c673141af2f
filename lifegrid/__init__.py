"""Time-to-event analytics on Spark: right-censored cohorts, estimators, tests and models."""
