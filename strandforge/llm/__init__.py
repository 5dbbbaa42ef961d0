"""Training-data operators: license scans, nearest neighbours, quotation linking, mixing,
near-dedup, decontamination, quality, HTML extraction, personal data and secrets.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
