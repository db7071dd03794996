"""Regression, mixed and hidden Markov models fitted from distributed sums."""
