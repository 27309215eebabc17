"""Structured values embedded in log text: detectors, overlap arbitration, extraction per record."""

from cairnlog.operators.embedded.engine import analyze, detections  # noqa: F401
