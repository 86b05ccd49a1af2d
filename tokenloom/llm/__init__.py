"""Training-data operators: toxicity, deduplication, personal data, licences, tokens and packing.

Nothing else in the library imports this subpackage; removing the folder leaves the rest working.
"""
