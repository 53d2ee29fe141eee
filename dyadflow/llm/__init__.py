"""Operators of a training-data pipeline, written for tables that hold whole documents."""
