"""Point-in-time panel analytics on Spark: DataFrame-in, DataFrame-out operators.

sources    landed feeds to tidy tables
functions  quarter arithmetic, guarded windows, statistics as Column expressions
operators  the panel, evaluation and calibration operators
plans      whole questions built from operators
streaming  incremental forms of the event operators
llm        training-data operators (optional; nothing else imports it)
"""
