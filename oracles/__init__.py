"""The queries' meaning in plain SQL, for comparison in another engine."""
