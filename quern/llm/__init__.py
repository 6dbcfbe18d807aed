"""Training-data operators: fingerprints, classifiers, packing, archives, deduplication, scans.

Nothing outside this subpackage imports it; delete the folder and the rest still works.
"""
