"""The table operators, one module per subject."""
