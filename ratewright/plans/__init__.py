"""The three end-to-end jobs: population, records, analysis."""
