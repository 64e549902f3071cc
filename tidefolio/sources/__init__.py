"""Reading and writing panels, indices, alphas and risk tables."""
