"""tidewell: device, experiment and data-export analytics on Apache Spark.

Every operator takes DataFrames and returns a DataFrame.  Nothing here reads
the clock, keeps a table on the driver or runs a row-at-a-time Python
function: "now" is an argument (``as_of``), and the work is expressed with
built-in column functions so that Catalyst can plan it.
"""

__version__ = "0.1.0"
