"""Training-data operators: one module per operator, their queries in :mod:`tremolo.llm.queries`."""
