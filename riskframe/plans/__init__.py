"""Complete studies composed from the operators."""
