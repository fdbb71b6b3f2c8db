"""Reading ragged CSV, writing results, and the run-history table."""
