"""DataFrame operators: keys in, keys out, order columns explicit."""
