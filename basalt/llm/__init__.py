"""Training-data operators: each module is one operator over a DataFrame of texts."""
