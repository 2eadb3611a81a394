"""PU algorithms, base classifiers, experiment grids and the registered queries."""
