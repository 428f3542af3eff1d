"""Training-data operators: quality, deduplication, mixing, tokenisation, web archives.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries when it is present.
"""
