"""The expression language and its values."""
