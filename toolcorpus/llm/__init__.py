"""Training-data operators: formatting, deduplication, filtering, classification and mixing.

Nothing else in the library imports this subpackage; ``queries`` registers one
query per operator and ``oracle`` holds the DuckDB SQL of those SQL can express.
"""
