"""DataFrame-to-DataFrame operators. Column names are always arguments."""
