"""Training-data operators: scans, filters, de-duplication, scoring and encoding of text tables."""
