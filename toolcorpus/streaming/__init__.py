"""Structured Streaming entry points for the stateless operators."""

from toolcorpus.streaming.scoring_stream import parse_dialogue_stream, score_prediction_stream

__all__ = ["parse_dialogue_stream", "score_prediction_stream"]
