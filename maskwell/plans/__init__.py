"""Complete scans built from the operators."""
