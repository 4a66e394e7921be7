"""Starloom: catalogue labelling, profiling and classification as Spark jobs."""
