"""Fitted pipelines on shared storage."""

from __future__ import annotations

from pyspark.ml import PipelineModel


def save_model(model: PipelineModel, path: str, overwrite: bool = False) -> str:
    """Write every fitted stage under ``path``, so another process can score."""
    writer = model.write()
    (writer.overwrite() if overwrite else writer).save(path)
    return path


def load_model(path: str) -> PipelineModel:
    """Read back what ``save_model`` wrote."""
    return PipelineModel.load(path)
