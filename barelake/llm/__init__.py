"""Operators for preparing training data: near-duplicates, mixing, privacy,
language, packing, secrets, licences, fingerprints and quality.

Nothing else in the library imports this subpackage.
"""
