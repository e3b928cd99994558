"""Complete analytic queries composed from the operators."""
