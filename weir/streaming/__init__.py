"""The daily rollup kept up to date from a stream of new flow files."""
