"""Column functions: masking, severity, hour, MinHash."""
