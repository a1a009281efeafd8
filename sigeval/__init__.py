"""Audit of labelled corpora and evaluation of detectors, as Spark DataFrame jobs."""
