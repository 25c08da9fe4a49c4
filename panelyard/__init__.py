"""panelyard: yearly indicator panels on Spark.

Every operator takes DataFrames and returns DataFrames; Catalyst plans the
work.  Sub-packages: ``sources`` (scans and sinks), ``operators`` (trend,
rules, measures, analysis, risk, evidence, reports, text), ``plans``
(registered queries and their SQL), ``streaming`` (Structured Streaming).
"""
