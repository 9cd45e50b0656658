"""Training-data operators (quality, filtering, formatting, dedup, packing).

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its
queries only if it can be imported.
"""
