"""Touchline: head-to-head match analytics as Spark jobs.

Layers
------
functions   column expressions
operators   DataFrame -> DataFrame building blocks
sources     table, CSV snapshot, page and catalog readers, and the write modes
plans       composed jobs: cleaning, model-ready features, modelling, ledger, report
streaming   incremental page ingestion with Structured Streaming
"""
