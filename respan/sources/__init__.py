"""Scans and sinks: document folders, measurement CSVs, run logs, caches and artefacts."""
