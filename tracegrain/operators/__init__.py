"""DataFrame operators: numbering, templates, dedup, features, forest, explore, report."""
