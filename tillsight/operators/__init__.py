"""The analyses: functions from DataFrames and parameters to a DataFrame.

Operators are lazy and never collect.  Two habits recur:

* A fact table is aggregated on a foreign key before the dimension is
  joined.  The map side folds a key that holds a third of all rows, so no
  task sees more than one row per key and map task, and the join input is
  as small as the dimension.
* Joins carry no size hints.  The planner broadcasts a side whose size it
  knows to be below the threshold and shuffles otherwise, and adaptive
  execution splits skewed shuffle partitions.  Only sides with a bound
  that follows from the code are broadcast by hand.
"""
