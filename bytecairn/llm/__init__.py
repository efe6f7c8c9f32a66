"""Training-data operators: WARC archives, scoring, chat formatting, dedup,
decontamination, media sequences and packing.

Nothing outside this subpackage imports it.
"""
