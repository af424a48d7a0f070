"""Text-leakage audit on Spark: does a model repeat what it was trained on?

Every operator takes DataFrames (or Columns) and returns DataFrames (or
Columns); nothing here holds a session or loops over data on the driver.
"""
