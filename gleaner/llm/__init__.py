"""Operators of a training-data pipeline over ``documents``, ``pages`` and ``labels``.

Nothing else in the library imports this package. Per-row work is numpy over whole Arrow
batches inside Spark tasks; distribution, shuffles, joins and aggregation are Spark's.
"""
