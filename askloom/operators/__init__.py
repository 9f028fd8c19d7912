"""DataFrame operators: assembly, search, fusion, gates, evaluation, analytics."""
