"""Training-data operators: filters, classifiers, near-duplicate removal,
tokenisation, extraction, fingerprints and packing.

Nothing else in the package imports this subpackage."""
