"""Training-data operators: language-model corpus cleaning, mixing and packing.

Nothing outside this package imports it; it may be deleted as a whole.
"""
