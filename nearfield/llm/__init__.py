"""Training-data operators: chat formatting, quality rules, mixing, near-duplicates, classifiers, archives, line
dedup, toxicity, byte-pair encoding and exact vector search.

Nothing outside this package imports it; ``nearfield.llm.registry`` lists its queries for the driver entry point.
"""
