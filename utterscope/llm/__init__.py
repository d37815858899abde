"""Training-data pipeline operators (deduplication, token counting and
packing, secret scans, language identification, vector search).

Nothing else in the package imports this subpackage; its queries are
registered by ``__spark_entry__.py`` only when it can be imported.
"""
