"""Streaming.

The reference has no stream, watermark or stateful operator, so none is
built here. Fitted pipelines are MLlib Transformers, so
``operators.models.score`` and ``operators.act.at_risk`` apply to a frame read
with ``spark.readStream`` as they do to a table (tests/test_streaming.py).
"""
