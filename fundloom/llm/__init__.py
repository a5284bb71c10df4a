"""Training-data operators: text, URL, archive and packing jobs over document tables."""
