"""Sources and sinks: CSV/TSV/text/.smi readers, writers, test-data fixtures."""
