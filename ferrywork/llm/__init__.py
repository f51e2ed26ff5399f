"""Training-data operators for language-model corpora. Nothing else in the package imports this subpackage."""
