"""tidelab — a PySpark workbench for taking tabular data from raw file to compared models.

Layout
------
sources/    CSV ingest, dataset catalog and append-only logs, synthetic demo tables
functions/  column expressions shared by the operators (trim, safe casts, hashing, names)
operators/  schema inference, profiling, data preparation, chart queries, experiment analytics
plans/      guarded SQL lab (logical-plan check, history) and skew-safe ranking helpers
ml/         model registry, splits, pipelines, metrics, benchmark runner
streaming/  file-stream variant of CSV ingest
"""

from tidelab.session import get_session, scratch_dir

__all__ = ["get_session", "scratch_dir"]
