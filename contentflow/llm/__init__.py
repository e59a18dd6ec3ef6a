"""Operators that prepare text for training language models, over any DataFrame of documents."""
