"""DataFrame-to-DataFrame operators over flow tables."""
