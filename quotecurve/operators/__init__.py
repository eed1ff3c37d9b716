"""DataFrame operators: frames and parameters in, lazy frame out."""
