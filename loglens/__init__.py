"""Message-log and consumer-group analytics on PySpark.

Every operator takes DataFrames and returns DataFrames; nothing is collected to the driver.
"""
