"""Sources and sinks: dialogue tables, parsed corpus, catalogue, pairs, reports, fixtures."""
