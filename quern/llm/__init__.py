"""Training-data operators: language ID, deduplication, scanning, mixing, decontamination, token files.

Nothing outside this subpackage imports it; ``queries()`` and ``oracle_sql()`` of
``quern.llm.catalog`` are what the driver entry adds when the subpackage is present.
"""
