"""flowscope: communication telemetry analysis on Spark DataFrames.

Every public operator takes DataFrames (and plain parameters) and returns a
DataFrame; nothing collects rows to the driver.  Batch operators live in
``flowscope.operators``, column helpers in ``flowscope.functions``, readers and
change logs in ``flowscope.sources``, stream twins in ``flowscope.streaming``
and multi-operator reports in ``flowscope.plans``.
"""

__version__ = "0.1.0"
