"""Column-level helpers (time arithmetic) and small DataFrame helpers
(quantile scores, histograms, polynomial fits, global row order)."""
