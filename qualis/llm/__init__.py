"""Training-data operators: deduplication, decontamination, language-model scoring, search,
personal data, token output, BPE, toxicity and quality.

Nothing else in the library imports this subpackage; ``queries`` holds the registered queries.
"""
