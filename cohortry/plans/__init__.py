"""End-to-end jobs, and the queries checked against SQL."""
