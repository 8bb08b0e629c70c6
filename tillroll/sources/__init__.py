"""Reading invoice lines and writing results."""
