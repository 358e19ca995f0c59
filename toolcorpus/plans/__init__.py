"""End-to-end plans (corpus -> SFT text, corpus -> pairs, evaluation) and the query registry."""
