"""Checks: every operator run over tables derived from the driver's parquet, each beside the
same question asked in plain SQL."""
