"""Training-data pipeline operators. Nothing outside this folder (and corpus_pipeline.py) imports it."""
