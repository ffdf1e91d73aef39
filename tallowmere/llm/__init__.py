"""Training-data operators: quality, media, licenses, URLs, toxicity, BPE, mixing, chat, dedup.

Nothing outside this package imports it.  Every operator takes and returns DataFrames; the thin
queries that fix columns and parameters are in :mod:`tallowmere.llm.queries`.
"""
