"""Training-data operators: text, vector and packing stages over document tables."""
