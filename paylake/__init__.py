"""paylake: payment-event medallion analytics on Spark.

Raw JSON payment events are gated, landed in two bronze lanes, cleaned into
silver, rolled up into gold and checked by data-quality queries.  Everything
is DataFrame / Spark SQL code; see README.md for the module map.
"""

__version__ = "0.1.0"
