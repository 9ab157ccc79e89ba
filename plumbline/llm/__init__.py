"""Training-data operators: dedup, secrets, tokenising, quality, toxicity, language, fingerprints, mixing.

Every operator reads only the columns it is told to, so further columns of the input, whatever
their names, never matter. A missing (null) text counts as empty unless the docstring says otherwise.
"""
