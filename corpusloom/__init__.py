"""Corpus export on Spark: select, clean, measure, pack and write project texts."""
