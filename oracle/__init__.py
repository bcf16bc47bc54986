"""The same results in plain SQL, written independently for checking."""
