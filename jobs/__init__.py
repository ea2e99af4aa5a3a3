"""Runnable jobs: python -m jobs.scheme_benchmark --help, python -m jobs.text_compressibility --help."""
