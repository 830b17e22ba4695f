"""Training-data preparation operators."""
