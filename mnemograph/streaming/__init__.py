"""Structured Streaming over logs: windowed counts with late rows, and folds that keep a state."""
