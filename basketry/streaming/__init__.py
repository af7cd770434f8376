from basketry.streaming.exposures import exposures_stream, run_exposures_stream  # noqa: F401
