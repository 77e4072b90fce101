"""Training-data operators: packing, PII, near-duplicates, sharding, BPE, quality, language, HTML, fingerprints.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
