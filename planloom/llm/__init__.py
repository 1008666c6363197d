"""Training-data operators: packing, quality, sharding, link trust, decontamination, WARC, dedup, licences.

Nothing else in the library imports this subpackage.
"""
