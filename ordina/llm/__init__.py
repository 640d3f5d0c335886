"""Training-data operators: extraction, tokens, models, duplicates, archives, packing.

Nothing outside this folder imports it; it may be deleted as a whole.
"""
