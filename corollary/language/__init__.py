"""The text language: claims in predicate-call syntax."""
