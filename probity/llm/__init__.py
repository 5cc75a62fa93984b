"""Training-data operators: one module for each, and queries.py with the registered queries.

Nothing outside this folder (and corpus_pipeline.py) imports it.
"""
