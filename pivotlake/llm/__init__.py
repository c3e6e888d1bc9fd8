"""Operators of a training-data pipeline: rules, near duplicates, languages, mixing,
secrets, quality scores, chat formatting, nearest neighbours, packing, licences.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
