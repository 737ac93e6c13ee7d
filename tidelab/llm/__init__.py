"""Operators for preparing language-model training data (packing, sharding, secret and licence
scans, near-duplicate search, classifiers, token files, decontamination). Nothing else in the
library imports this subpackage."""
