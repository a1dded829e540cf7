"""Sources and sinks: CSV files, test-table adapters, report writers."""
