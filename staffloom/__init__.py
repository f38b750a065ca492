"""staffloom: human-resources analytics as PySpark DataFrame jobs.

Messy spreadsheet rows land as row-numbered bronze tables, become string-typed
silver tables and end as typed, flagged and enriched gold tables.  Everything
is a function from DataFrame to DataFrame, so Catalyst and AQE see whole plans.
"""

__version__ = "0.1.0"
