"""DataFrame -> DataFrame operators (corpus parsing, prompts, calls, pairs, scoring, reports)."""
