"""Jobs over data that keeps arriving."""
