"""DataFrame operators: frames and explicit parameters in, a lazy frame out."""
