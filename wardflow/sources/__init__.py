"""Sources and sinks: reading files, outcomes, predictions, driver-table stand-ins."""
