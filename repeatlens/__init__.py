"""repeatlens: dispensing, adherence and refill analytics on PySpark DataFrames.

Every operator takes DataFrames (and, where time matters, an explicit ``as_of``)
and returns one lazy DataFrame. Nothing here starts a job unless it says so.
"""
