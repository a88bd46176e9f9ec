"""Query languages and the plans they compile to."""
