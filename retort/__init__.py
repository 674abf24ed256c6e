"""retort: reaction-table preparation and evaluation on PySpark.

Every operator takes and returns DataFrames (or Columns, for the
expression helpers in ``retort.functions``).  Heavy per-compound
functions run through ``retort.plans.dictionary.dictionary_apply``
(distinct -> batch function -> join back) so they run once per distinct
compound rather than once per row.
"""

__version__ = "0.1.0"
