"""Corpus, retrieval, fusion, prompt, evaluation and telemetry operators."""
