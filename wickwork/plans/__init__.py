"""Level plans of features."""
