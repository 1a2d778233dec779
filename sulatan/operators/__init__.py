"""Table operators: lexicon joins, box grouping, scoring, metrics, logs."""
