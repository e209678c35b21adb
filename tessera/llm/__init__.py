"""Training-data operators: independent of the rest of the library, which never imports them."""
