"""Ringside: build, publish, search, audit and validate a directory of sports venues on Spark."""
