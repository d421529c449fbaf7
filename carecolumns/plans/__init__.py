"""Order of evaluation."""
