"""grantmill: research-grant analytics as Spark DataFrame jobs.

Every operator is a function from DataFrames (or Columns) to DataFrames (or
Columns).  Nothing here starts a session, collects data to the driver, or
writes outside the paths it is given.
"""

__version__ = "0.1.0"
