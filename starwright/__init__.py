"""Star-schema analytics on Spark DataFrames.

Every operator takes and returns a ``DataFrame`` (or builds a ``Column``), so
Catalyst plans the whole job; nothing here runs data through the driver.
"""
