"""Writers of reports and comparisons."""
