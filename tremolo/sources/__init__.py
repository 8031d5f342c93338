"""Sources and sinks of binary records, catalogues and reports."""
