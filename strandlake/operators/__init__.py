"""Analytics over curves and ensembles."""
