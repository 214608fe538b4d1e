"""Ready-made questions and step lists built from the operators."""
