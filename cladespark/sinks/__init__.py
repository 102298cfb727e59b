"""Writers of reports and state."""
